import hashlib
import re

import pytest
from pyspark.sql import functions as F

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text.translate(LOWER))


def brute(docs, items, size=13):
    owners = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            owners.setdefault(tuple(w[i : i + size]), set()).add("" if name is None else str(name))
    lengths = sorted({len(w) for w in owners})
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (own := owners.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    found |= own
        names = sorted(found)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(docs, items, **settings):
    out = decontam.contamination(docs, items, **settings)
    shown = out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("h"), "contaminated")
    return as_multiset(shown, "doc_id", "n_words", "n_hit", "n", "h", "contaminated")


def pairs(df):
    return [(r["item_id"], r["text"] or "") for r in df.collect()]


def test_against_brute_force(small):
    docs, items = small("documents"), small("benchmark")
    want = brute(texts_of(docs), pairs(items))
    assert sum(w[5] for w in want) > 3 and sum(w[2] > 0 and not w[5] for w in want) >= 0
    assert got(docs, items) == want


@pytest.mark.parametrize("slice_words", [10, 2_000_000])
def test_odd_rows_and_slices(spark, odd, none, slice_words):
    items = spark.createDataFrame(
        [(1, "plain text of a few words"), (2, "Word and other 12 word AND other, 12 word and other 12 word and other 12 word"), (3, None),
         (4, "..."), (None, "unicode"), (5, "ünïcödé \U0001F600"), (1, "some text"), (6, "repeats its id"), (6, "repeats its id")],
        "item_id int, text string",
    )
    assert got(odd, items, slice_words=slice_words) == brute(texts_of(odd), pairs(items))
    assert got(none, items) == [] and len(got(odd, items.where("false"))) == odd.count()
    kept = decontam.decontaminated(odd, items)
    assert kept.columns == odd.columns
    assert kept.count() == sum(not x[5] for x in brute(texts_of(odd), pairs(items)))


def test_proximity(spark):
    item = " ".join(f"term{i}" for i in range(13))
    broken = item.replace("term6", "another")  # the rarest terms stand as in the phrase, the phrase is broken
    docs = spark.createDataFrame([(1, item), (2, broken), (3, "term1 term2")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id int, text string")
    out = {r["doc_id"]: (r["n_hit"], r["items"], r["n_near"]) for r in decontam.contamination(docs, items).collect()}
    assert out[1] == (13, ["7"], 0) and out[3] == (0, [], 0) and out[2][0] == 0
    words_, found = decontam.matches(docs.where("doc_id = 2"), spark.createDataFrame([(7, "term1 term2 term8")], "item_id int, text string"), window=3, slop=6)
    assert [(r["item"], r["spans"]) for r in found.collect()] == [("7", [])]
