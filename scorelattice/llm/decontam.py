"""Benchmark decontamination with a positional inverted index (operator 7).

The index is sharded by document and stored: for each document the terms of the
benchmark that occur in it, sorted, each with its positions.  The number of
documents that hold a term is counted over the whole index.  For each window of
a benchmark item the two terms that the fewest documents hold are its anchors;
a document's posting lists of these, each shifted by the term's offset in the
window, are intersected, and only where they meet the whole phrase is checked.
Anchors that come close without meeting give proximity matches.

Nothing is shuffled but the counts and the rows of documents with a match, so
a passage that a third of all documents share makes no hot key.  Terms and
windows are broadcast in slices of at most ``SLICE_WORDS`` benchmark words; a
larger benchmark takes several passes.

Defined results: null text has no words; a null id is carried along; rows that
repeat an id are judged each by their own text; items without words have no
window; rows that repeat an item id are one item; a null item id is the item
with the empty name; empty tables give no hits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import fresh, whole_text

WINDOW = 13
#: Rarest terms of a window whose lists are intersected.
ANCHORS = 2
#: Words by which anchors may miss each other in a proximity match.
SLOP = 3
#: Benchmark words whose terms and windows are broadcast at a time.
SLICE_WORDS = 2_000_000
#: A-Z lower-cased; 0-9, a-z and every byte of a non-ASCII character are word bytes, all else blanks.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) <= size:
        return [tuple(words)]
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class Phrases:
    """Terms and windows of some items; small enough to broadcast."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int) -> None:
        self.terms: dict[bytes, int] = {}
        number = self.terms.setdefault
        owners: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            for w in windows_of(words, size):
                owners.setdefault(tuple(number(t, len(self.terms)) for t in w), set()).add(name)
        self.windows = [(np.array(w, np.int32), sorted(names)) for w, names in owners.items()]
        self.anchored: dict[int, list[tuple[int, int, int, int]]] = {}

    def anchor(self, held: dict[int, int]) -> None:
        """Index the windows by their rarest terms; one with a term that nothing holds cannot occur."""
        for w, (terms, _) in enumerate(self.windows):
            listed = terms.tolist()
            if any(t not in held for t in listed):
                continue
            order = sorted(range(len(listed)), key=lambda i: (held[listed[i]], i))
            first = order[0]
            second = next((i for i in order if listed[i] != listed[first]), first)
            self.anchored.setdefault(listed[first], []).append((w, first, listed[second], second))


def _slices(benchmark: DataFrame, size: int, bound: int) -> Iterator[Phrases]:
    items, held = [], 0
    listed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), whole_text().alias("text"))
    for row in listed.toLocalIterator():
        words = words_of(row["text"].encode())
        if held and held + len(words) > bound:
            yield Phrases(items, size)
            items, held = [], 0
        items.append((row["item"], words))
        held += len(words)
    yield Phrases(items, size)


def _indexer(phrases):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = phrases.value.terms.get
        for batch in batches:
            counts, found = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = words_of(text)
                found.append(np.fromiter(map(get, words, repeat(-1)), np.int32, len(words)))
                counts.append(len(words))
            n = np.array(counts, np.int64)
            every = np.concatenate(found) if found else np.empty(0, np.int32)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            starts = np.cumsum(n) - n
            at = np.flatnonzero(every >= 0)
            term, doc = every[at], doc[at]
            at = (at - starts[doc]).astype(np.int32)
            order = np.lexsort((term, doc))  # stable: positions stay ascending
            term, at = term[order], at[order]
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n))))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(term)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(at)),
                ],
                names=["doc_id", "body", "n_words", "terms", "positions"],
            )

    return index


def build_index(docs: DataFrame, phrases) -> DataFrame:
    """(doc_id, body, n_words, terms, positions): postings of each document, by term and position.

    ``body`` is a hash of the text, so that rows that repeat an id stay apart.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("body"), whole_text().alias("text")
    )
    return texts.mapInArrow(
        _indexer(phrases), "doc_id long, body long, n_words long, terms array<int>, positions array<int>"
    )


def _match(terms: np.ndarray, positions: np.ndarray, phrases: Phrases, anchors: np.ndarray, slop: int):
    """Windows of one document: (window, starts of the phrase, whether its anchors at least come close)."""
    edges = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1]))) if len(terms) else np.empty(0, np.int64)
    present = terms[edges]
    wanted = present[anchors[present]]
    if not len(wanted):
        return
    ends = np.append(edges[1:], len(terms))
    lists = dict(zip(present.tolist(), zip(edges.tolist(), ends.tolist())))
    sequence = None
    for term in wanted.tolist():
        a, b = lists[term]
        for w, first, other, second in phrases.anchored[term]:
            if other not in lists:
                continue
            c, d = lists[other]
            left, right = positions[a:b] - first, positions[c:d] - second
            near = np.searchsorted(right, left)
            gap = np.minimum(
                np.abs(right[np.minimum(near, len(right) - 1)] - left), np.abs(right[np.maximum(near - 1, 0)] - left)
            )
            if not (gap <= slop).any():
                continue
            phrase = phrases.windows[w][0]
            if sequence is None:
                sequence = np.full(int(positions.max()) + 1, -1, np.int32)
                sequence[positions] = terms
            starts = left[(gap == 0) & (left >= 0) & (left + len(phrase) <= len(sequence))]
            starts = [s for s in starts.tolist() if np.array_equal(sequence[s : s + len(phrase)], phrase)]
            yield w, len(phrase), starts


def _searcher(phrases, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Phrases = phrases.value
        anchors = np.zeros(max(len(known.terms), 1), bool)
        anchors[list(known.anchored)] = True
        for batch in batches:
            out = []
            own, body = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            terms, positions = batch.column(3), batch.column(4)
            every, places, ends = terms.values.to_numpy(), positions.values.to_numpy(), terms.offsets.to_numpy()
            for k in range(batch.num_rows):
                a, b = ends[k], ends[k + 1]
                exact: dict[str, set[tuple[int, int]]] = {}
                close: set[str] = set()
                for w, length, starts in _match(every[a:b], places[a:b], known, anchors, slop):
                    for item in known.windows[w][1]:
                        if starts:
                            exact.setdefault(item, set()).update((s, s + length) for s in starts)
                        else:
                            close.add(item)
                out += [(own[k], body[k], item, _merged(spans)) for item, spans in exact.items()]
                out += [(own[k], body[k], item, []) for item in close - exact.keys()]
            spans = pa.array([x[3] for x in out], pa.list_(pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string()), spans],
                names=["doc_id", "body", "item", "spans"],
            )

    return search


def _merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = SLOP, slice_words: int = SLICE_WORDS):
    """Two frames: words (doc_id, body, n_words) of all rows, and matches (doc_id, body, item, spans).

    A match with spans (start, end of covered words) is exact; one without is a proximity match.
    """
    context = docs.sparkSession.sparkContext
    words, found = None, []
    for phrases in _slices(benchmark, window, slice_words):
        index = staged(build_index(docs, context.broadcast(phrases)))
        held = index.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        phrases.anchor({r["term"]: r["n"] for r in held.collect()})  # at most the slice's terms
        found.append(
            index.mapInArrow(
                _searcher(context.broadcast(phrases), slop), "doc_id long, body long, item string, spans array<array<int>>"
            )
        )
        words = index.select("doc_id", "body", "n_words") if words is None else words
    return words, reduce(DataFrame.unionAll, found)


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = F.aggregate(
        spans,
        zero,
        lambda s, x: F.struct(
            (s["n"] + F.greatest(x[1] - F.greatest(x[0], s["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], x[1]).alias("end")
        ),
    )
    return step["n"].cast("long")


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, body, n_words, n_hit, items, n_near, contaminated) for every row of ``docs``.

    Contaminated: words in exact matches make up at least one word in twenty.
    """
    words, found = matches(docs, benchmark, **settings)
    exact = F.size("spans") > 0
    merged = (
        found.groupBy("doc_id", "body")
        .agg(
            F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
            F.array_sort(F.collect_set(F.when(exact, F.col("item")))).alias("items"),
            F.array_sort(F.collect_set(F.when(~exact, F.col("item")))).alias("near"),
        )
        .select(
            F.col("doc_id").alias("_d"), F.col("body").alias("_b"), covered(F.col("spans")).alias("n_hit"), "items",
            F.size(F.array_except("near", "items")).cast("long").alias("n_near"),
        )
    )
    joined = words.join(merged, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("body") == F.col("_b")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return joined.select(
        "doc_id", "body", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that are contaminated."""
    own, body, key = (fresh(docs, x) for x in ("_own", "_body", "_key"))
    bad = contamination(docs, benchmark, **settings).where("contaminated").select(F.col("doc_id").alias(own), F.col("body").alias(body)).distinct()
    named = docs.withColumn(key, F.xxhash64(whole_text()))
    kept = named.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(key) == F.col(body)), "left_anti")
    return kept.select(*docs.columns)
