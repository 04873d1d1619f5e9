"""Base measures next to plain Python; estimates next to sorted concentration steps in numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelattice.llm import outliers


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {p for i, x in enumerate(zip(w, w[1:], w[2:])) if windows[x] > 1 for p in range(i, i + 3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_measures(spark, odd, small):
    r = random.Random(2)
    made = [
        (100 + i, "".join(r.choice(["a", "b", "é", " ", "\xa0", "|", "#", "A", " ", " ", "\n", "\t", "\x0b", "a b a "]) for _ in range(r.randrange(200))))
        for i in range(300)
    ]
    more = spark.createDataFrame(made, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source")
    for docs in (odd.selectExpr("doc_id", "text", "null lang", "doc source", "1 x", "2 n", "3 kept"), more, small("documents", "/root/testdata/sf0.001")):
        want = sorted(((d["doc_id"], *brute(d["text"])) for d in docs.select("doc_id", "text").collect()), key=repr)
        out = outliers.judged(docs)
        assert sorted((tuple(r) for r in out.select("doc_id", *BASE).collect()), key=repr) == want
        assert out.where("base_failed AND kept").count() == 0


def test_empty_table(none):
    assert outliers.judged(none.selectExpr("doc_id", "text", "doc lang", "doc source")).collect() == []


def plain_mcd(x):
    """The same estimate with sorted distances."""
    own = np.diag(np.square(outliers.SCALES))
    low, mid, high = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    best = None
    for mean, cov in ((x.mean(0), outliers.CONSISTENT * np.cov(x.T, bias=True)), (mid, np.diag(((high - low) / 1.349) ** 2))):
        for _ in range(50):
            y = x - mean
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(cov + own), y)
            near = x[np.argsort(d, kind="stable")[: int(np.ceil(outliers.HALF * len(x)))]]
            mean, cov = near.mean(0), outliers.CONSISTENT * np.cov(near.T, bias=True)
        size = np.linalg.slogdet(cov + own)[1]
        if best is None or size < best[0]:
            best = (size, mean, cov + own)
    return best


@pytest.fixture(scope="module")
def planted(spark):
    """A hot source with a cluster of one in five outliers, a plain source, two small sources, a small language."""
    r = np.random.default_rng(4)
    mix = r.normal(size=(6, 6)) * 0.12
    rows = []
    for lang, source, n in (("en", "hot", 3000), ("en", "plain", 400), ("en", "few", 150), ("en", "fewer", 90), ("xx", "lone", 40)):
        x = r.normal(size=(n, 6)) @ mix + (5, 5, 0, 0, 0, 0)
        bad = np.arange(n) % 5 == 0
        x[bad] = r.normal(size=(bad.sum(), 6)) * 0.05 + (5, 8, 3, 0, 0, 0)
        rows += [(lang, source, k, v.tolist()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "lang string, source string, k long, x array<double>")


def test_estimates_follow_sorted_steps(spark, planted):
    vectors = outliers.grouped(planted).cache()
    levels = {(r["level"], r["lang"], r["source"]): r["n"] for r in vectors.groupBy(*outliers.GROUP).agg(F.count("x").alias("n")).collect()}
    assert levels == {(0, "en", "hot"): 3000, (0, "en", "plain"): 400, (1, "en", ""): 240, (2, "", ""): 40}
    known = {(r["level"], r["lang"], r["source"]): r for r in outliers.estimates(vectors).collect()}
    assert set(known) == set(levels) - {(2, "", "")}
    for key, e in known.items():
        x = np.array([r["x"] for r in vectors.where((F.col("level") == key[0]) & (F.col("source") == key[2])).collect()])
        size, mean, cov = plain_mcd(x)
        assert np.allclose(e["mean"], mean, atol=0.1) and abs(e["size"] - size) < 0.3
        inverse = np.array(e["inverse"]).reshape(6, 6)
        y = x - np.array(e["mean"])
        far = np.einsum("ij,jk,ik->i", y, inverse, y) > outliers.CUTOFF
        bad = np.abs(x[:, 2] - 3) < 0.5
        assert far[bad].mean() > 0.99 and far[~bad].mean() < 0.02  # a plain mean and covariance would hide the cluster


def test_rows_dealt_otherwise_give_the_same(planted):
    once = outliers.estimates(outliers.grouped(planted.repartition(1)))
    again = outliers.estimates(outliers.grouped(planted.repartition(13, "k")))
    ordered = lambda df: sorted((r["level"], r["source"], r["mean"], r["size"]) for r in df.collect())
    assert ordered(once) == ordered(again)


def test_junk_goes_and_clean_stays(small):
    docs, labels = small("documents", "/root/testdata/sf0.1"), small("labels", "/root/testdata/sf0.1")
    kept = outliers.judged(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("p"))
    share = {r["quality"]: r["p"] for r in kept.collect()}
    assert share[1] > 0.99 and share[0] < 0.05  # labels are never looked at
