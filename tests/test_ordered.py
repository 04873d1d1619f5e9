"""Documents in strict order: every kind of fault is named, and digests see every change."""

import random

from pyspark.sql import functions as F

from scorelattice.operators import audit as A


def brute(rows):
    places = {}
    for place, key in rows:
        places.setdefault(place, []).append(key)
    out, ordered = [], sorted(places)
    if ordered and ordered[0] != 1:
        out.append((0, "PLACE_MISSING"))
    least = lambda ks: min(ks, key=lambda k: (k is not None, k or 0))
    most = lambda ks: max(ks, key=lambda k: (k is not None, k or 0))
    rank = lambda k: (k is not None, k or 0)
    for i, p in enumerate(ordered):
        if len(places[p]) > 1:
            out.append((p, "PLACE_REPEATED"))
        if i + 1 < len(ordered):
            high, low = most(places[p]), least(places[ordered[i + 1]])
            if ordered[i + 1] > p + 1:
                out.append((p, "PLACE_MISSING"))
            if rank(high) == rank(low):
                out.append((p, "KEY_REPEATED"))
            elif rank(high) > rank(low):
                out.append((p, "KEY_REVERSED"))
    return sorted(out)


def test_problems_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    good = [(i, i * 3) for i in range(1, 400)]
    cases = [good, [], [(1, 5)], [(2, 5), (3, None)], good[:100] + good[150:], good + [good[7]], [(p, -k) for p, k in good]]
    mixed = [(p + (p % 37 == 0), k - 3 * (p % 41 == 1)) for p, k in good if p % 53]
    swapped = [(p, {30: 33, 33: 30}.get(k, k)) for p, k in good]
    cases += [mixed, swapped, [(rng.randrange(1, 60), rng.randrange(20)) for _ in range(80)]]
    for fan in (4,):
        monkeypatch.setattr(A, "FAN", fan)
        for rows in cases:
            df = spark.createDataFrame(rows, "place long, key long")
            got = sorted((r["place"], r["problem"]) for r in A.ordered_problems(df, "place", ["key"]).collect())
            assert got == brute(rows), (fan, rows[:5])


def test_digest_sees_every_change(spark, monkeypatch):
    monkeypatch.setattr(A, "FAN", 8)
    rows = [(i, f"row {i}") for i in range(1, 101)]

    def digest(changed, parts=3):
        df = spark.createDataFrame(changed, "place long, t string").repartition(parts)
        return tuple(A.ordered_digest(df, "place", F.col("t")).first())

    whole = digest(rows)
    assert whole[:2] == (100, 3) and digest(rows, 11) == whole
    others = [rows[:-1], rows + [(101, "row 101")], [(p, "row 3" if p == 4 else "row 4" if p == 3 else t) for p, t in rows], [(p, t + " " * (p == 50)) for p, t in rows]]
    assert len({digest(o)[2] for o in others} | {whole[2]}) == 5


def test_referenced_key_without_digest_is_no_orphan(spark, rows):
    listed = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], "key long, digest string")
    referenced = spark.createDataFrame([(1, "a"), (2, "x"), (4, None), (5, "e"), (6, "f")], "key long, digest string")
    got = rows(A.reconcile_references(listed, referenced))
    assert got == [(1, "present"), (2, "substituted"), (3, "orphan"), (4, "missing"), (5, "present"), (6, "missing")]


def test_query_stops_at_two_levels_as_its_sql(spark, monkeypatch, tmp_path):
    import hashlib

    from scorelattice.plans import audits

    monkeypatch.setattr(A, "FAN", 4)
    for n, levels in ((3, 1), (16, 2), (100, 2)):
        orders = spark.range(n).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus", "id + 0.5D AS o_totalprice")
        orders.write.parquet(f"{tmp_path}/{n}/orders.parquet")
        nodes = [hashlib.sha256(f"{i}|O|{i}.50".encode()).hexdigest() for i in range(n)]
        for _ in range(levels):
            nodes = [hashlib.sha256("".join(nodes[i : i + 4]).encode()).hexdigest() for i in range(0, len(nodes), 4)]
        assert tuple(audits.ordered_digest(spark, f"{tmp_path}/{n}").first()) == (n, levels, min(nodes))


def test_query_digest_is_the_root_over_all_orders(spark, monkeypatch, tmp_path):
    import hashlib

    import duckdb

    from scorelattice.plans import audits
    from scorelattice.plans.registry import CHECK_SQL

    monkeypatch.setattr(A, "FAN", 4)
    con = duckdb.connect()

    def digests(name, n, changed=None):
        """Of the query and of its SQL, both with four digests under a node."""
        orders = spark.range(n).selectExpr("id AS o_orderkey", "'O' AS o_orderstatus", f"id + if(id = {-1 if changed is None else changed}, 1.5D, 0.5D) AS o_totalprice")
        orders.write.parquet(f"{tmp_path}/{name}/orders.parquet")
        con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{tmp_path}/{name}/orders.parquet/*.parquet'")
        cursor = con.execute(CHECK_SQL["ordered_digest"].replace("1024", "4"))
        df = audits.ordered_digest(spark, f"{tmp_path}/{name}")
        assert df.columns == [c[0] for c in cursor.description]
        return tuple(df.first()), cursor.fetchone()

    for n, levels in ((0, 1), (5, 2), (70, 4)):
        nodes = [hashlib.sha256(f"{i}|O|{i}.50".encode()).hexdigest() for i in range(n)]
        for _ in range(levels):
            nodes = [hashlib.sha256("".join(nodes[i : i + 4]).encode()).hexdigest() for i in range(0, len(nodes), 4)]
        assert len(nodes) == (n > 0)
        assert digests(f"all{n}", n) == ((n, levels, nodes[0] if n else None),) * 2
    # Whichever order changes, the digest does.
    changed = [digests(f"changed{i}", 70, i)[0] for i in (0, 33, 69)]
    assert len({nodes[0], *(d[2] for d in changed)}) == 4
