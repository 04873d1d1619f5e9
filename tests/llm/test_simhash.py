import random

import xxhash
from pyspark.sql import functions as F

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import components, simhash


def brute_print(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint) rows."""
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for d, p in prints:
        if d is not None:
            least[find(p)] = min(d, least.get(find(p), d))
    return sorted(((d, f"{p:016x}", least.get(find(p))) for d, p in prints), key=repr)


def got(docs, **settings):
    out = simhash.near_duplicates(docs, **settings).select("doc_id", simhash.hex_print().alias("f"), "component_id")
    return as_multiset(out, "doc_id", "f", "component_id")


def test_fingerprint_matches_spark_hash(spark):
    text = "Größe und\tfoo BAR baz"
    shingle = "größe und foo"  # only A-Z is lowered, as bytes
    value = spark.range(1).select(F.xxhash64(F.lit(shingle))).first()[0]
    assert value % 2**64 == xxhash.xxh64_intdigest(shingle.encode(), 42)
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def test_against_brute_force(small):
    docs = small("documents")
    want = brute_components([(i, brute_print(t)) for i, t in texts_of(docs)])
    assert len({w[2] for w in want}) < len(want)
    assert got(docs) == want


def test_odd_rows(odd, none):
    rows = texts_of(odd)
    assert got(odd) == brute_components([(i, brute_print(t)) for i, t in rows])
    assert got(none) == []
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and simhash.one_of_each(none).collect() == []


def test_links_of_clusters_sparse_and_dense(spark):
    """Every choice of buckets to pair up or to link by masks gives the same components."""
    r = random.Random(1)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(60):
            base ^= (1 << r.randrange(64)) ^ (1 << r.randrange(64) if r.random() < 0.7 else 0)
            prints.add(base)
    centre = r.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 40) for j in range(0, i)}
    listed = sorted(prints)
    df = spark.createDataFrame([(i, simhash._signed(p)) for i, p in enumerate(listed)], "doc_id long, print long")
    want = {i: c for i, _, c in brute_components(list(enumerate(listed)))}
    for dense in (1, 64, 10_000):
        found = components.components(simhash.links(df.select("print"), dense), "a", "b")
        groups = {}
        by_print = {r["print"]: r["doc_id"] for r in df.collect()}
        for row in found.collect():
            groups.setdefault(row["root"], set()).add(by_print[row["node"]])
        have = {i: i for i in want}
        for members in groups.values():
            have.update(dict.fromkeys(members, min(members)))
        assert have == want


def test_components_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(5, 5), (None, 3)]
    out = components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    roots = {r["node"]: r["root"] for r in out.collect()}
    assert roots == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(400)}}
