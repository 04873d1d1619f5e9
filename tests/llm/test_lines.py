import hashlib

import pytest
from pyspark.sql import functions as F

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import lines

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(ASCII_LOWER)


def brute(rows):
    holders = {}
    for i, text in rows:
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(-(2**63) if i is None else i)
    last = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = []
    for i, text in rows:
        own = -(2**63) if i is None else i
        parts = text.split("\n")
        kept = [x for x in parts if not (key(x) in last and last[key(x)] != own)]
        out.append((i, len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(docs, **settings):
    marked = lines.mark_lines(docs, **settings)
    shown = marked.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(lines.kept_text().cast("binary"), 256).alias("h"))
    return as_multiset(shown, "doc_id", "n_lines", "n_dropped", "h")


def test_against_brute_force(small):
    docs = small("documents")
    want = brute(texts_of(docs))
    assert sum(w[2] for w in want) > 100
    assert got(docs) == want


@pytest.mark.parametrize("salts", [1, 64])
def test_odd_rows(odd, salts):
    assert got(odd, salts=salts) == brute(texts_of(odd))
    assert sum(x[2] for x in got(odd)) == 6  # one line of seven texts repeats often enough; the largest id keeps it


def test_stage_keeps_rows_and_columns(odd, none):
    out = lines.drop_repeated_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert lines.drop_repeated_lines(none).collect() == []


def test_keep_runs(spark):
    df = spark.sql("select array(0, 3, 4) d, 6 n union all select array(), 2 union all select array(0), 1")
    runs = [[tuple(x) for x in r[0]] for r in df.select(lines.keep_runs(F.col("d").cast("array<int>"), F.col("n"))).collect()]
    assert runs == [[(1, 2), (5, 1)], [(0, 2)], []]


def test_hot_line_is_split(spark):
    """A line in every document, over many salted ranges, is still counted as one."""
    hot = "the one line that every single document of this test repeats"
    df = spark.range(500).selectExpr("id doc_id", f"concat('own ', id, '\\n{hot}') text")
    assert got(df) == brute(texts_of(df))
