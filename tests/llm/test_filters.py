"""Filter interactions next to a count over all orders in plain Python."""

import re
from itertools import permutations

from pyspark.sql import functions as F

from scorelattice.llm import filters

LABELS = "doc_id long, quality int, toxic int"


def failed(rows):
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        out.append((i, part or "", {k for k, v in bad.items() if v}))
    return out


def brute(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    out, own = {}, failed(rows)
    for part in {p for _, p, _ in own}:
        docs = [(i, bad) for i, p, bad in own if p == part]
        worth = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [i for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                worth[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f in bad for _, bad in docs) - len(gone), sum(bad == {f} for _, bad in docs),
                    sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
        for key, row in out.items():
            if key[0] == part:
                row.append(worth[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(docs, labels, **settings):
    rows = filters.interactions(docs, labels, **settings).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_odd_rows(spark, odd):
    langs = ["en", None, "", "fr"]
    rows = [(r[0], r[1], langs[k % 4]) for k, r in enumerate(odd.collect())]
    words = " ".join(f"w{k}" for k in range(120))
    rows += [(50, "SHOUT$ " * 130, "en"), (51, "SHOUT$ " * 130, "fr"), (49, words, "en"), (48, words, "en"), (48, words, "en"), (None, words, "en")]
    labels = [(5, 1, 1), (51, 0, 1), (49, 1, 0), (49, 0, 1), (None, 1, 1), (24, None, 1), (1, 1, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, filter int")
    want = brute(rows, labels)
    assert len(want) == 3 * 600 and any(v[-1] for v in want.values())
    assert got(docs, spark.createDataFrame(labels, LABELS)) == want


def test_hot_and_other_copies(spark):
    """One text in a third of all rows, many texts in a few."""
    rows = [(i, "one text" if i % 3 == 0 else f"text {i // 7}", "en") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for share in (1, 1000):
        filters.HOT_SHARE, old = share, filters.HOT_SHARE
        try:
            fails, _ = filters.failing_ids(docs)
        finally:
            filters.HOT_SHARE = old
        copies = {r["id"] for r in fails.where("filter = 'E'").collect()}
        assert copies == {i for i, _, bad in failed(rows) if "E" in bad}


def test_own_filters_and_empty_table(spark):
    docs = spark.range(20).selectExpr("id doc_id", "repeat('x', cast(id as int)) text", "'p' lang")
    labels = spark.createDataFrame([(19, 1, 0)], LABELS)
    short = lambda text: {"A": F.char_length(text) < 5, "B": F.char_length(text) > 15}
    out = got(docs, labels, filters=short)
    assert len(out) == 6 * 3  # orders of A, B and copies
    assert out["p", "ABE", 1] == (15, 5, 0, 5, 0, 0, 30) and out["p", "ABE", 2] == (11, 4, 0, 4, 1, 0, 24)
    assert got(docs.where("false"), labels) == {}
