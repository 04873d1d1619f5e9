"""Collocations next to a count of all phrases in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import texts_of
from scorelattice.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spoken(rows):
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            yield "und" if lang is None else lang, re.findall(r"[^\x20\x09]+", piece)


def brute(rows, least, top=2000, covered=100):
    f, n = defaultdict(Counter), Counter()
    for lang, words in spoken(rows):
        n[lang] += len(words)
        for k in range(1, 6):
            f[lang].update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        known = {p: a for p, a in own.items() if a >= least and " " in p}
        inside = defaultdict(int)
        for p, a in known.items():
            w = p.split(" ")
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w):
                        inside[" ".join(w[i:j])] = max(a, inside[" ".join(w[i:j])])
        listed = []
        for p, a in known.items():
            if 100 * inside[p] >= covered * a:
                continue
            w = p.split(" ")
            cuts = []
            for k in range(1, len(w)):
                left, right = own[" ".join(w[:k])], own[" ".join(w[k:])]
                cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            listed.append((-score, -a, p.encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(docs, **settings):
    return sorted(tuple(r)[:8] for r in phrases.collocations(docs, **settings).collect())


@pytest.fixture(scope="module")
def spoken_rows():
    r = random.Random(3)
    words = ["a", "b", "a\x01", "a\x00b", "Été", "été", "\U0001F600", "x-y", "zz", "the", "of"]
    rows = [(None, None), ("en", ""), ("en", " \t\n "), ("und", "a b. a b. a b. a b"), ("fr", "a " * 3000), ("en", "no-blank" * 9000)]
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "! "]) for _ in range(r.randrange(30)))
        rows.append((r.choice(["en", "en", "fr", None]), text))
    return rows + [("en", "one passage that is always the same in every copy, and so on")] * 300


@pytest.mark.parametrize("least, ranges", [(3, 1), (5, 7), (20, 40)])
def test_against_brute_force(spark, spoken_rows, least, ranges):
    docs = spark.createDataFrame(spoken_rows, "lang string, text string").selectExpr("*", "1 phrase", "2 a", "'k' key").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = brute(spoken_rows, least)
        assert len(want) > 10 and got(docs, least=least) == want
        if least == 5:
            assert got(docs, least=least, covered=60, top=7) == brute(spoken_rows, least, 7, 60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_shipped_texts(small):
    docs = small("documents", "/root/testdata/sf0.001")
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    want = brute(rows, 8)
    assert len(want) > 20 and got(docs, least=8) == want


def test_blocks_start_every_position_once():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefg") * r.randrange(1, 3) for _ in range(r.randrange(200))).encode() for _ in range(30)]
    for bound in (1, 10, 10**6):
        seen = Counter()
        for _, names, ids in phrases.blocks((("en", t) for t in texts), bound=bound):
            for i in range(len(ids) - 4):
                if ids[i]:
                    cut = ids[i : i + 5].tolist()
                    cut = cut[: cut.index(0)] if 0 in cut else cut
                    seen[tuple(names[x] for x in cut)] += 1
        want = Counter()
        for text in texts:
            w = text.split()
            want.update(tuple(w[i : i + 5]) for i in range(len(w)))
        assert seen == want


def test_long_text_is_cut_between_words(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE", 50)
    text = b"one two, three\tfour\nfive six " * 40
    (_, names, ids), = phrases.blocks([("en", text)])
    monkeypatch.undo()
    (_, names2, ids2), = phrases.blocks([("en", text)])
    assert [names[i] for i in ids] == [names2[i] for i in ids2]


def test_scores_beyond_64_bits(spark):
    rows = [(10**13, 10**14, 2 * 10**13, 3 * 10**13), (1, 1, 1, 1), (2999999, 10**6, 3 * 10**6, 10**6), (100, 3, 1001, 299), (999, 1, 1000, 999)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    out = [r[0] for r in df.select(phrases.cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert out == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_full_map_loses_nothing(spark, spoken_rows, monkeypatch):
    """A map too small for its words lets more through, no less."""
    monkeypatch.setattr(phrases, "MAP_BITS", 64)
    docs = spark.createDataFrame(spoken_rows, "lang string, text string")
    assert got(docs, least=5) == brute(spoken_rows, 5)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert got(docs) == [] and got(spark.createDataFrame([("en", None)], "lang string, text string")) == []


def test_distinct_rows_of_wide_columns():
    r = np.random.default_rng(0)
    for size in (3, 1 << 22, 1 << 40):
        columns = [r.integers(0, min(size, 4), 500) * (size // 4) for _ in range(5)]
        rows, counts = phrases._distinct(columns, size)
        assert dict(zip(zip(*(c.tolist() for c in rows)), counts.tolist())) == Counter(zip(*(c.tolist() for c in columns)))
