"""Resolution tiers, chains, inserts and folds on hand tables."""

import random

import pytest
from pyspark.sql import functions as F

from scorelattice.operators import audit as A, history as H, lineage as L, ops as O, resolve as R, summary as S


def test_resolution_tiers(spark):
    entities = spark.createDataFrame(
        [("e1", "Alpha One", "A1"), ("e2", "Beta", "B"), ("e3", "Gamma-3", "G")],
        "entity_id string, canonical_name string, display_name string",
    )
    aliases = spark.createDataFrame(
        [("e1", "al"), ("e2", "AL"), ("e1", "shared"), ("e2", "shared"), ("gone", "ghost"), ("e3", "x y")],
        "entity_id string, alias_text string",
    )
    raws = ["al", "Al", "shared", "ghost", "X-Y", "e2", "beta", "gamma 3", "", "none"]
    mentions = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    got = {r.raw: (r.tier, r.status, r.entity_id) for r in R.resolve(mentions, R.tier_index(entities, aliases)).collect()}
    assert got == {
        "al": (1, "matched", "e1"), "Al": (2, "ambiguous", None), "shared": (1, "ambiguous", None),
        "ghost": (None, "unmatched", None), "X-Y": (3, "matched", "e3"), "e2": (4, "matched", "e2"),
        "beta": (5, "matched", "e2"), "gamma 3": (6, "matched", "e3"), "": (None, "unmatched", None),
        "none": (None, "unmatched", None),
    }


def chain_rows():
    return [
        ("ok1", "ok", None), ("ok2", "ok", "ok1"), ("ok3", "ok", "ok2"),
        ("br1", "branch", None), ("br2", "branch", "br1"), ("br3", "branch", "br1"),
        ("m1", "missing", "nowhere"), ("f1", "foreign", "ok1"),
        ("c1", "ring", "c2"), ("c2", "ring", "c1"),
        ("r1", "rho", "r2"), ("r2", "rho", "r1"), ("r3", "rho", "r2"),
        ("one", "single", None),
    ]


def test_leaves_and_chain_errors(spark):
    rows = spark.createDataFrame(chain_rows(), "id string, entity string, parent string")
    got = {r.entity: (r.leaf_id, r.chain_error) for r in L.effective_leaves(rows).collect()}
    assert got == {
        "ok": ("ok3", None), "branch": (None, "CHAIN_AMBIGUOUS"), "missing": (None, "CHAIN_INVALID"),
        "foreign": (None, "CHAIN_INVALID"), "ring": (None, "CHAIN_AMBIGUOUS"), "rho": (None, "CHAIN_CYCLE"),
        "single": ("one", None),
    }


def test_depths_of_long_and_cyclic_chains(spark):
    long_chain = [(i, 0, i - 1 if i else None) for i in range(300)]
    ring = [(1000, 1, 1002), (1001, 1, 1000), (1002, 1, 1001), (1003, 1, 1002)]
    rows = spark.createDataFrame(long_chain + ring, "id long, entity long, parent long")
    got = {r.id: (r.root, r.depth) for r in L.chain_depths(rows).collect()}
    assert got == {i: (0, i) for i in range(300)}


def test_sparse_projection(spark):
    decisions = spark.createDataFrame(
        [(1, 9, None, "a", None), (2, 9, 1, None, "s"), (3, 9, 2, "b", None)],
        "id long, entity long, parent long, metric string, split string",
    )
    claims = spark.createDataFrame([(9, "raw", "raw"), (8, "raw", None)], "claim_id long, metric string, split string")
    got = L.project_identity(claims, decisions, L.chain_depths(decisions), L.effective_leaves(decisions), ["metric", "split"])
    assert {tuple(r)[:4] for r in got.collect()} == {(9, "b", "s", 3), (8, "raw", None, None)}


def test_lineage_audit_counts(spark):
    rows = spark.createDataFrame(
        [(1, "a", None, 1, 10, None, "O"), (2, "a", 1, 2, 9, "O", "C"), (3, "a", 1, 4, 11, "X", "C"), (4, "b", 2, 3, 12, "C", "C"), (5, "b", 99, 1, 1, None, "O")],
        "id long, entity string, parent long, seq long, at long, f string, t string",
    )
    r = L.lineage_audit(rows, "x", "seq", "at", ("f", "t")).first()
    assert (r.n_rows, r.roots, r.leaves, r.branches, r.missing_parents, r.crossed_entities) == (5, 1, 3, 1, 1, 1)
    assert (r.sequence_gaps, r.time_reversals, r.state_breaks, r.bad_roots, r.bad_leaves) == (1, 1, 1, 1, 1)


def brute_cyclic(edges):
    live = set(edges)
    while True:
        sources = {s for s, _ in live}
        kept = {(s, d) for s, d in live if d in sources}
        if kept == live:
            return live
        live = kept


@pytest.mark.parametrize("seed", [1, 2])
def test_cyclic_edges_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(900 + i, 901 + i) for i in range(20)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {tuple(r) for r in L.cyclic_edges(df).collect()} == brute_cyclic(edges)
    assert L.cyclic_edges(df.where("src >= 900")).count() == 0


def test_insert_if_new_is_idempotent(spark):
    incoming = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "s long, h string")
    empty = incoming.where("false")
    first = H.insert_if_new(incoming, empty, ["s", "h"])
    assert first.count() == 2
    assert H.insert_if_new(incoming, first, ["s", "h"]).count() == 0


def test_reconcile_dispositions(spark):
    current = spark.createDataFrame(
        [("keep", "b", "u1", "h", "active", True), ("edit", "b", "u2", "h", "active", True), ("back", "b", "u3", "h", "retired", True),
         ("gone", "b", "u4", "h", "active", True), ("hand", "b", "u5", "h", "active", False), ("moved", "b", "u6", "h", "active", True)],
        "source_id string, owner_id string, url string, definition_hash string, status string, managed boolean",
    )
    manifest = spark.createDataFrame(
        [("keep", "b", "u1", "h"), ("edit", "b", "u2", "h2"), ("back", "b", "u3", "h2"), ("new", "b", "u9", "h"),
         ("thief", "b", "u1", "h"), ("moved", "c", "u6", "h")],
        "source_id string, owner_id string, url string, definition_hash string",
    )
    ordinals = spark.createDataFrame([("edit", 4)], "source_id string, last_ordinal long")
    got = {r.source_id: (r.disposition, r.ordinal, r.error) for r in H.reconcile_definitions(manifest, current, ordinals).collect()}
    assert got == {
        "keep": ("unchanged", 0, None), "edit": ("revised", 5, None), "back": ("reactivated", 1, None),
        "gone": ("retired", 1, None), "hand": ("untouched", 0, None), "new": ("created", 1, None),
        "thief": ("refused", 0, "URL_ALREADY_OWNED"), "moved": ("refused", 0, "BENCHMARK_CHANGED"),
    }


def incident(spark, steps):
    leaves = {"ACKNOWLEDGED": "OPEN", "INVESTIGATION_STARTED": "ACKNOWLEDGED", "MITIGATED": "INVESTIGATING", "RESOLVED": "MITIGATED", "CLOSED": "RESOLVED"}
    state, rows = None, []
    for i, (kind, at) in enumerate(steps, 1):
        frm = state if kind in ("REOPENED", "OCCURRENCE_RECORDED") else leaves.get(kind)
        to = state if kind == "OCCURRENCE_RECORDED" else O.INCIDENT_STEPS[kind][1]
        rows.append(("i", i, i, i - 1 if i > 1 else None, kind, frm, to, at))
        state = to
    return spark.createDataFrame(rows, "entity string, ordinal long, event_id long, prior_event_id long, event_type string, from_state string, to_state string, occurred_at long")


def test_incident_path_with_reopening(spark):
    steps = [("OPENED", 0), ("ACKNOWLEDGED", 5), ("INVESTIGATION_STARTED", 6), ("OCCURRENCE_RECORDED", 7), ("MITIGATED", 8),
             ("RESOLVED", 9), ("REOPENED", 20), ("ACKNOWLEDGED", 25)]
    events = incident(spark, steps)
    assert O.step_issues(events, O.INCIDENT_STEPS, "OCCURRENCE_RECORDED").where("issue is not null").count() == 0
    r = O.incident_fold(events).first()
    assert (r.state, r.occurrences, r.first_at, r.last_at, r.episode_at, r.acknowledged_at, r.mitigated_at) == ("ACKNOWLEDGED", 3, 0, 20, 20, 25, None)
    sla = O.sla_assessment(O.incident_fold(events).withColumn("severity", F.lit("SEV0"))).first()
    assert (sla.acknowledge_due, sla.acknowledged_on_time, sla.mitigate_due, sla.mitigated_on_time) == (920, True, 3620, None)


def test_incident_violations(spark):
    events = incident(spark, [("OPENED", 0), ("ACKNOWLEDGED", 5), ("CLOSED", 6)])
    bad = O.step_issues(events, O.INCIDENT_STEPS, "OCCURRENCE_RECORDED").where("issue is not null").collect()
    assert [(r.ordinal, r.issue) for r in bad] == [(3, "STATE_DISCONTINUITY")]
    gap = O.step_issues(events.where("ordinal <> 2"), O.INCIDENT_STEPS).where("ordinal = 3").first()
    assert gap.issue == "ORDINAL_GAP"
    back = O.step_issues(events.withColumn("occurred_at", -F.col("occurred_at")), O.INCIDENT_STEPS).where("ordinal = 2").first()
    assert back.issue == "TIME_REVERSED"


def test_due_plan(spark):
    targets = spark.createDataFrame([("t", "P1D", "configured"), ("p", "P1D", "paused"), ("r", "P1D", "retired")], "target_id string, cadence string, status string")
    got = {(r.target_id, r.slot): (r.disposition, r.reason_code) for r in O.due_plan(targets, 0, 1, 43200).collect()}
    assert got[("t", 0)] == ("due", "DUE_BY_SCHEDULE") and got[("t", 1)] == ("not_due", "NOT_DUE_BY_POLICY")
    assert got[("p", 0)] == ("blocked", "OPERATOR_PAUSED") and got[("r", 0)] == ("not_due", "NOT_DUE_BY_POLICY")


def test_digest_ignores_order_and_keeps_multiplicity(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i long, s string")
    def digest(d):
        return A.table_inventory({"t": d}).first().digest

    assert digest(df) == digest(df.orderBy(F.desc("i")).repartition(3))
    assert digest(df) != digest(df.distinct()) != digest(df.withColumn("s", F.lit("1")))
    as_text = df.withColumn("i", F.col("i").cast("string"))
    assert digest(df) != digest(as_text)


def test_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(t // 3, i) for i, t in enumerate(range(20))], "created long, id long")
    seen, after = [], None
    while True:
        page = S.keyset_page(df, "created", "id", 6, after).collect()
        seen += [r.id for r in page]
        if len(page) < 6:
            break
        after = (page[-1].created, page[-1].id)
    assert seen == sorted(range(20), reverse=True)


def test_guard_refuses_rather_than_truncates(spark):
    assert S.guarded(spark.range(5), 5).count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        S.guarded(spark.range(5), 4).collect()


def _leading_to_cycles(edges):
    edges = {(a, b) for a, b in edges if a is not None and b is not None}
    while True:
        starts = {a for a, _ in edges}
        left = {(a, b) for a, b in edges if b in starts}
        if left == edges:
            return sorted(edges)
        edges = left


def test_cyclic_edges_against_peeling(spark):
    rng = random.Random(7)
    graphs = [[(1, 1)], [(1, 2), (2, 1), (2, 3), (3, 4), (0, 1), (None, 1), (1, None), (0, 1)], [(1, 2), (2, 3)], []]
    for n, m in ((12, 12), (40, 44), (200, 230)):
        graphs.append([(rng.randrange(n), rng.randrange(n)) for _ in range(m)])
    # Circles of one edge per node, of lengths that are no powers of two, with tails; a ladder of branching nodes.
    graphs.append([(i, (i + 1) % 7) for i in range(7)] + [(100 + i, 101 + i) for i in range(20)] + [(120, 3)] + [(50 + i, 51 + i) for i in range(9)])
    graphs.append([(2 * i + a, 2 * i + 2 + b) for i in range(6) for a in (0, 1) for b in (0, 1)])
    for edges in graphs:
        df = spark.createDataFrame(edges, "src long, dst long")
        assert sorted(tuple(r) for r in L.cyclic_edges(df).collect()) == _leading_to_cycles(edges), edges


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 nodes, alone and into a circle: as many rounds as its length has bits."""
    stored = []
    monkeypatch.setattr(L, "staged", lambda df, real=L.staged: stored.append(1) or real(df))
    chain = spark.range(10_000).selectExpr("id src", "id + 1 dst")
    assert L.cyclic_edges(chain).count() == 0 and len(stored) < 25
    stored.clear()
    assert L.cyclic_edges(chain.unionByName(spark.createDataFrame([(10_000, 9_000)], "src long, dst long"))).count() == 10_001
    assert len(stored) < 25


def test_chain_depths_write_each_row_once(spark, monkeypatch):
    """Rows that reached a root are not stored again in later rounds."""
    rows = spark.range(1, 65).selectExpr("id", "CASE WHEN id > 1 THEN id - 1 END AS parent").unionByName(
        spark.createDataFrame([(101, 102), (102, 101), (103, 999), (104, 64), (104, 1)], "id long, parent long")
    )
    written = []
    monkeypatch.setattr(L, "staged", lambda df, kept=L.staged: (lambda out: (written.append([r.id for r in out.where("done").collect()]), out)[1])(kept(df)))
    got = {r.id: (r.root, r.depth) for r in L.chain_depths(rows).collect()}
    assert got == {**{i: (1, i - 1) for i in range(1, 65)}, 104: (1, 1)}
    assert sorted(i for ids in written for i in ids) == sorted(got)


def test_the_verdict_on_sources_travels_alone(spark):
    """Hashes and ids of sources are judged before the joins by claim."""
    from scorelattice.operators import feed as E

    def frame(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    h = "a" * 64
    claims = frame(
        "claim_id long, source_id long, snapshot_id long, decision_id long, benchmark_raw string, model_raw string, score_raw string, "
        "capture_method string, score_numeric double, locator_type string, locator_ok boolean",
        *[(i, 1, i, d, "b", "m", "1", "c", 1.0, "j", True) for i, d in ((1, 7), (2, 7), (3, 7), (4, None))],
    )
    leaf = "entity long, leaf_id long, chain_error string"
    context = E.claim_context(
        claims, frame("snapshot_id long, source_id long, revision_id long, content_hash string, captured_at double", (1, 1, 5, h, 1.0), (2, 1, 5, "", 1.0), (4, 1, 5, h, 1.0)),
        frame("revision_id long, source_id long, definition_hash string", (5, 1, h)), frame("source_id long", (1,)),
        frame("id long, entity long, outcome string, policy_complete boolean", (7, 5, "certified", True)), frame(leaf, (5, 7, None)),
        frame("claim_id long, outcome string", *[(i, "pass") for i in range(1, 5)]),
        frame("id long, outcome string", *[(10 + i, "validation_reviewed") for i in range(1, 5)]), frame(leaf, *[(i, 10 + i, None) for i in range(1, 5)]),
        frame("id long, outcome string, review_id long", *[(20 + i, "approved", 10 + i) for i in range(1, 5)]), frame(leaf, *[(i, 20 + i, None) for i in range(1, 5)]),
        frame("claim_id long, " + ", ".join(f"{c} string" for c in E.CELL), *[(i, "x", "y", "z", "s", "t", "v") for i in range(1, 5)]),
        frame("model_id string", ("x",)), frame("benchmark_id string", ("y",)),
    )
    assert not {"content_hash", "definition_hash", "snapshot_revision_id"} & set(context.columns)
    got = {r.claim_id: r.reason for r in E.eligibility(context).collect()}
    assert got == {1: None, 2: "SNAPSHOT_HASH_INVALID", 3: "SOURCE_PROVENANCE_MISSING", 4: "SOURCE_DECISION_MISSING"}


def test_insert_if_new_of_bare_keys_needs_no_join(spark):
    incoming = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, None), (3, None)], "s int, h string")
    stored = spark.createDataFrame([("x", 2, "b"), ("y", 3, None), ("z", 9, "q")], "other string, s int, h string")
    fresh = H.insert_if_new(incoming, stored, ["s", "h"])
    assert sorted(map(tuple, fresh.collect()), key=repr) == [(1, "a"), (3, None)]
    assert "Join" not in fresh._jdf.queryExecution().optimizedPlan().toString()
