"""Nearest neighbours, chunk dedup, license scan."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import as_multiset, texts_of
from scorelattice.llm import chunks, licenses, neighbours

VECTORS = "vec_id long, embedding array<float>, label int, v string, list int, ids int"


def exact(rows, k=10, every=100):
    """rows: (vec_id, vector) of usable rows."""
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for a in (v for i, v in rows if i == q):
            for i, b in rows:
                if i != q:
                    d = math.sqrt(sum((x - y) ** 2 for x, y in zip(a, b)))
                    best[i] = min(d, best.get(i, d))
        for rank, (i, d) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:k], 1):
            out.append((q, rank, i, d))
    return out


def test_recall(small):
    vectors = small("embeddings", "/root/testdata/sf0.1")
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    ids, v = np.array(sorted(rows)), np.array([rows[i] for i in sorted(rows)])
    found = {}
    for r in neighbours.nearest(vectors, list_size=16, probes=40).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = total = 0
    for q in [i for i in ids.tolist() if i % 100 == 0]:
        d = np.sqrt(((v - rows[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        hit, total = hit + len(best & found[q].keys()), total + 10
        assert len(found[q]) == 10
        assert all(s == pytest.approx(np.sqrt(((rows[i] - rows[q]) ** 2).sum()), abs=1e-12) for i, s in found[q].items())
    assert hit / total >= 0.9


def test_recall_holds_with_many_lists(spark):
    """A thousand lists of vectors without clusters: a fixed number of lists searched finds too little."""
    v = np.random.default_rng(7).normal(size=(8_000, 32))
    df = spark.createDataFrame([(i, x, 0, "", 1, 2) for i, x in enumerate(v.tolist())], VECTORS)
    v = v.astype(np.float32).astype(float)
    found = {}
    for r in neighbours.nearest(df, list_size=8).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 8_000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found[q] & set(np.argsort(d)[:10].tolist()))
    assert hit / 800 >= 0.95


@pytest.mark.parametrize("block", [2, 4096])
def test_odd_vectors_exactly(spark, block):
    """One list holds all, so the result is exact: ties, copies, hot vectors, bad rows."""
    r = random.Random(2)
    good = [(i, [float(r.randrange(3)), float(r.randrange(3)), 1.0]) for i in range(0, 300, 5)]
    good += [(i, [1.0, 1.0, 1.0]) for i in range(1, 100, 3)] + [(400, [1.0, 1.0, 1.0]), (500, [1.0, 1.0, -0.0]), (500, [1.0, 1.0, -0.0])]
    good += [(300, [0.0, 2.0, 1.0]), (300, [2.0, 0.0, 5.0])]
    bad = [(600, None), (700, [0.0, 0.0, 0.0]), (800, [1.0, None, 2.0]), (900, [float("nan"), 1.0, 1.0]), (1000, [float("inf"), 1.0, 1.0]),
           (1100, [1.0, 2.0]), (1200, []), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0, "x", 1, 2) for i, v in good + bad], VECTORS)
    out = neighbours.nearest(df, list_size=10_000, block=block)
    assert as_multiset(out, "query_id", "rank", "vec_id", "score") == sorted(exact(list(dict.fromkeys((i, tuple(v)) for i, v in good))), key=repr)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0, "", 1, 2), (7, [0.0, 1.0], 0, "", 1, 2)], VECTORS)
    assert as_multiset(neighbours.nearest(df), "query_id", "rank", "vec_id") == [(0, 1, 7)]
    assert neighbours.nearest(df.where("vec_id = 0")).collect() == []
    assert neighbours.nearest(df.where("false")).collect() == []


def test_graph_walk_finds_the_nearest():
    r = np.random.default_rng(3)
    centres = r.normal(size=(300, 8))
    graph = neighbours.Graph(centres, 16)
    hit = 0
    for q in r.normal(size=(50, 8)):
        ids, d = graph.nearest(q, 60)
        assert (np.diff(d) >= 0).all()
        hit += len(set(ids[:10]) & set(np.argsort(((centres - q) ** 2).sum(1))[:10]))
    assert hit >= 475


def test_cuts_resist_insertions():
    r = random.Random(4)
    data = bytes(r.randrange(97, 123) for _ in range(20_000))
    ends = chunks.cuts(data)
    assert ends[-1] == len(data) and all(0 < b - a <= chunks.LONGEST for a, b in zip([0, *ends], ends))
    moved = data[:9_000] + b"inserted" + data[9_000:]
    shifted = {e if e < 9_000 else e - 8 for e in chunks.cuts(moved)}
    assert len(set(ends) - shifted) <= 12
    assert chunks.cuts(b"") == [] and chunks.cuts(b"a" * 5000)[-1] == 5000


def test_gear_is_the_rolling_sum():
    data = np.frombuffer(b"some bytes that roll over the window of sixteen", np.uint8)
    h = 0
    for i, value in enumerate(chunks.gear(data).tolist()):
        h = ((h << 1) + int(chunks.GEAR[data[i]])) % 2**32
        if i < chunks.REACH:
            assert value == h


def passage(r, words):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(words))


def test_repeated_passages_are_found_and_clean_texts_left_alone(spark):
    r = random.Random(5)
    shared = [passage(r, 51) for _ in range(40)]
    rows = [(i, passage(r, 120)) for i in range(100)]
    for i, text in enumerate(shared):
        rows += [(1000 + 2 * i, f"{passage(r, 60)} {text} {passage(r, 70)}"), (1001 + 2 * i, f"{passage(r, 33)} {text} {passage(r, 20)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = chunks.repeated_passages(df).collect()
    found = {x["doc_id"] for x in out}
    assert not found & set(range(100)) and len(found) >= 78
    texts = dict(rows)
    for x in out:
        other = next(t for t in shared if t in texts[x["doc_id"]])
        assert texts[x["doc_id"]][x["start"] : x["end"]].strip() in other
        assert x["keep"] == (x["doc_id"] % 2 == 0)


@pytest.mark.parametrize("block_bytes", [1, 200, 16_000_000])
def test_blocks_agree(odd, block_bytes):
    def got(size):
        return as_multiset(chunks.repeated_passages(odd, 4, size), "doc_id", "start", "end", "n_words", "first_doc_id", "keep")

    assert got(block_bytes) == got(5_000) != []


def test_chunks_odd_rows(odd, none):
    out = chunks.repeated_passages(odd).collect()
    texts = {}
    for i, t in texts_of(odd):
        texts.setdefault(i, []).append(t)
    assert out == [x for x in out if any(x["end"] <= len(t) for t in texts[x["doc_id"]])]
    assert chunks.repeated_passages(none).collect() == []
    kept = chunks.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_passages_are_cut_out_once(spark):
    r = random.Random(6)
    text = passage(r, 80)
    rows = [(i, f"{passage(r, 30)}\n{text}\n{passage(r, 30)} é") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = dict(texts_of(chunks.without_repeats(df)))
    assert out[0] == dict(rows)[0]
    assert all(len(out[i]) < len(dict(rows)[i]) - 200 for i in range(1, 5))


def brute_passages(rows, n):
    """(doc, start, end, n_words, first, keep) from all runs of n words, as the text spells them."""
    holders, places = {}, {}
    for i, t in rows:
        words = [m.span() for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", t)]
        places[i] = [(words[k][0], words[k + n - 1][1]) for k in range(len(words) - n + 1)]
        for a, b in places[i]:
            holders.setdefault(t[a:b], set()).add(i)
    out = []
    for i, t in rows:
        last = None
        for k, (a, b) in enumerate(places[i]):
            own = holders[t[a:b]]
            key = (k, min(own) if min(own) != i else max(own)) if len(own) > 1 else None
            if key and last and last == (k - 1, key[1]):
                out[-1][2:4] = [b, out[-1][3] + 1]
            elif key:
                out.append([i, a, b, n, min(own), min(own) == i])
            last = key
    return sorted(map(tuple, out))


def test_passages_against_brute_force(spark):
    """Everyday chunks, short words, cut-less text, passages of several holders: every run of words that one other document holds, and no other."""
    r = random.Random(8)
    common = [passage(r, 5) for _ in range(60)]
    chained = [(i, " ".join(r.choice(common) for _ in range(60))) for i in range(40)]
    short = [" ".join("".join(r.choice("etaoin") for _ in range(r.randrange(1, 4))) for _ in range(51)) for _ in range(60)]
    rows = chained + [(100 + 2 * i + k, f"{passage(r, 9 + k)} {t} {passage(r, 7)}") for i, t in enumerate(short) for k in range(2)]
    rows += [(300, passage(r, 20) + " la" * 90), (301, "é " + "la " * 70 + passage(r, 20))]
    first, second = passage(r, 60), passage(r, 60)
    rows += [(400, first), (401, f"{first} {second} {passage(r, 9)}"), (402, f"x {second}\n{first}"), (403, f"{passage(r, 4)} {first} {second}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = chunks.repeated_passages(df, block_bytes=9_000)
    expected = brute_passages(rows, chunks.PASSAGE_WORDS)
    assert as_multiset(out, "doc_id", "start", "end", "n_words", "first_doc_id", "keep") == sorted(expected, key=repr)
    assert {i for i, *_ in expected} >= {100, 219, 300, 301, 400, 401, 402, 403} and not {i for i, *_ in expected} & set(range(40))
    assert {x[5] for x in expected if x[0] == 401} == {True, False}


def test_only_what_smaller_ids_hold_is_cut_out(spark):
    """A copy goes even where text that first occurs here follows it."""
    r = random.Random(9)
    copied, own = passage(r, 70), passage(r, 70)
    rows = [(1, copied), (2, f"{copied} {own}"), (3, f"{passage(r, 5)} {own}"), (4, f"{own} end")]
    out = dict(texts_of(chunks.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))))
    assert out == {1: copied, 2: f" {own}", 3: rows[2][1][: -len(own)], 4: " end"}


def brute_header(lines, templates, held, total):
    def unit(words):
        raw = {w: words.count(w) * (math.log((1 + total) / (1 + held.get(w, 0))) + 1 if w in vocabulary else math.log(1 + max(total, 1)) + 1) for w in set(words)}
        size = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / size for w, x in raw.items()}

    vocabulary = {w for forms in templates.values() for f in forms for w in licenses.words_of(f.encode())}
    best = (None, 0.0)
    for words in lines:
        own = unit(words)
        for name in sorted(templates):
            for form in templates[name]:
                score = sum(x * own.get(w, 0.0) for w, x in unit(licenses.words_of(form.encode())).items())
                if score >= licenses.HEADER and score > best[1] + 1e-12:
                    best = (name, score)
    return best


def test_headers_against_brute_force(small):
    docs = small("documents", "/root/testdata/sf0.001")
    texts = texts_of(docs)
    lines = {i: [w for line in t.encode().split(b"\n") if (w := licenses.words_of(line))] for i, t in texts}
    every = [set(w) for own in lines.values() for w in own]
    held = {}
    for words in every:
        for w in words:
            held[w] = held.get(w, 0) + 1
    out = {r["doc_id"]: (r["header"], r["header_score"]) for r in licenses.scan(docs, F.lit("a/b.txt")).collect()}
    for i in lines:
        name, score = brute_header(lines[i], licenses.TEMPLATES, held, len(every))
        assert out[i][0] == name and out[i][1] == pytest.approx(score)
    assert any(n for n, _ in out.values())


def test_inheritance_by_nearest_directory(spark):
    notice = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "no": "just words of a text"}
    rows = [(1, "LICENSE", "mit"), (2, "a/b/LICENSE", "gpl"), (3, "a/x.c", "no"), (4, "a/b/c/d/y.c", "no"), (5, "a/b/z.c", "no"), (6, "top.c", "no"), (7, None, "no"), (8, "ab/w.c", "no")]
    df = spark.createDataFrame([(i, p, notice[n]) for i, p, n in rows] + [(9, "a/b/h.c", notice["mit"] + "\n" + " and other words of code" * 40)], "doc_id long, path string, text string")
    out = {r["doc_id"]: (r["license"], r["via"], r["from_directory"]) for r in licenses.inherited(licenses.scan(df, F.col("path"))).collect()}
    assert out == {
        1: ("MIT", "header", None), 2: ("GPL-3.0", "header", None), 3: ("MIT", "inherited", ""), 4: ("GPL-3.0", "inherited", "a/b"),
        5: ("GPL-3.0", "inherited", "a/b"), 6: ("MIT", "inherited", ""), 7: (None, None, None), 8: ("MIT", "inherited", ""), 9: ("MIT", "header", None),
    }


def test_full_licenses_and_wrapped_notices(spark):
    """A full MIT text and the full GPL's beginning pass their license on; notices count over line ends and inside long lines."""
    mit = "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + "\n".join(licenses.FULL["MIT"][0].split("copyright c ")[1][i : i + 70] for i in range(0, 1100, 70))
    gpl = "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n"
    r = random.Random(10)
    gpl += "\n".join(passage(r, 12) for _ in range(400))
    code = "\n".join(passage(r, 9) for _ in range(30))
    wrapped = "# This work is licensed\n# under the GNU General\n# Public License,\n# version 3.\n" + code
    inside = passage(r, 60) + " Licensed under the Mozilla words. This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. " + passage(r, 60)
    rows = [(1, "m/LICENSE", mit), (2, "m/a.c", code), (3, "g/COPYING", gpl), (4, "g/b/c.c", code), (5, "w.c", wrapped), (6, "i.c", inside), (7, "n.c", code)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    out = {x["doc_id"]: (x["license"], x["from_directory"]) for x in licenses.inherited(licenses.scan(df, F.col("path"))).collect()}
    assert out[2] == ("MIT", "m") and out[4] == ("GPL-3.0", "g") and out[5] == ("GPL-3.0", None) and out[6] == ("MPL-2.0", None) and out[7] == (None, None)
    assert out[1][0] == "MIT" and out[3][0] == "GPL-3.0"


def test_licenses_odd_rows(odd, none):
    assert licenses.inherited(licenses.scan(odd, F.col("doc"))).count() == odd.count()
    assert licenses.inherited(licenses.scan(none, F.col("doc"))).collect() == []
