"""The pipeline's stages next to brute-force versions of each on the same input."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P  # noqa: E402
from conftest_llm import texts_of  # noqa: E402
from test_decontam import brute as brute_contamination, pairs  # noqa: E402
from test_lines import key  # noqa: E402
from test_simhash import brute_components, brute_print  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Each stage's result, written and read again as the next one's input."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for number, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("pipeline") / str(number))
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names_and_columns(stored):
    assert [name for name, _ in P.STAGES] == [
        "quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "byte-level BPE",
    ]
    assert all(df.columns == COLUMNS for df in stored[:-1])
    assert stored[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality_rejects_junk_and_keeps_the_rest(spark, stored):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stored[0].collect()}
    right = sum((labels[i] == 1) == (i in kept) for i in labels)
    assert right / len(labels) > 0.9


def test_lines(stored):
    before, after = texts_of(stored[0]), dict(texts_of(stored[1]))
    holders = {}
    for i, text in before:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert after == {i: "\n".join(x for x in t.split("\n") if last.get(key(x), i) == i) for i, t in before}


def test_near_duplicates(stored):
    rows = texts_of(stored[1])
    components = brute_components([(i, brute_print(t)) for i, t in rows])
    assert sorted(r["doc_id"] for r in stored[2].collect()) == sorted(i for i, _, c in components if i == c)


def test_decontamination(spark, stored):
    items = pairs(spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    judged = brute_contamination(texts_of(stored[2]), items)
    assert sorted(r["doc_id"] for r in stored[3].collect()) == sorted(x[0] for x in judged if not x[5])


def test_encoding(stored):
    import hashlib

    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts_of(stored[3])}
    assert {r["doc_id"]: r["decoded_sha256"] for r in stored[4].collect()} == want


def test_run_gives_the_last_stage(spark, stored):
    assert sorted(map(tuple, P.run(spark, FOLDER).collect())) == sorted(map(tuple, stored[4].collect()))


def test_stages_take_odd_rows(spark, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd, none):
        given = docs.select("doc_id", "text").selectExpr("doc_id", "text", "'en' AS lang", "CAST(NULL AS string) AS source", "CAST(1 AS long) AS n_chars")
        for _, stage in P.STAGES[:-1]:
            out = stage(spark, given, FOLDER)
            assert out.columns == columns and out.count() <= given.count()
        assert P.STAGES[-1][1](spark, given, FOLDER).count() == given.count()
