"""Substring dedup by content-defined chunks (operator 5).

A passage is text of at least ``PASSAGE_WORDS`` words that one other document
holds too, byte for byte.  It is found through its windows: every run of so many
words, known by digest, is looked up over all documents, so none is missed and
none is put together from pieces of several documents.

Chunks say which windows are worth looking up.  A gear hash rolls over the bytes
of every text; where it falls below a bound a chunk ends, as its last ``SEEN``
bytes alone decide.  Neighbouring chunks, joined, are anchors.  An anchor inside a
window is one in every document that holds the window, so a window with an anchor
that no other document holds is no repeat.  All other windows are looked up.

A task takes its documents in blocks.  The distinct digests of a block, each
with the smallest and largest document that holds it there, travel packed: one
row for each bucket of digests.  A bucket merges the blocks' entries and sends
back to each block the numbers of those that two documents hold.  A digest that
a third of all documents share is one entry per block.  Anchors go this way
first, then the windows that they leave.  What else belongs to a block, at first
its texts and then the places of its windows, stays with it in stored rows and
meets the answers in a second shuffle.

Where the holder changes, a new passage begins; it may overlap the last one by
less than a window.  In text that repeats within itself (one word over and over)
the holder has every window of the passage, but maybe fewer in a row.

Defined results: null text is the empty text, which has no word; null ids are
one document with no id; rows that repeat an id are one document, so text that
recurs only among them is no repeat; a passage within one document alone is no
repeat; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import staged
from .common import NO_ID, PACKED, bucket_count, fresh, packed_rows, squeeze, unsqueeze, whole_text

#: Bytes that a cut depends on, bytes per cut on average, and the shortest and longest chunk.
REACH, EVERY, SHORTEST, LONGEST = 16, 16, 6, 1024
#: Bytes that decide a natural cut, and chunks that an anchor joins.
SEEN, JOINED = REACH + SHORTEST - 1, 3
#: Words that a repeated passage has at least, and that a window has.
PASSAGE_WORDS = 50
#: Bytes of text in a block, or one document if that is larger.
BLOCK_BYTES = 16_000_000
#: Digests of anchors are sums of byte values by powers of the base; equal digests of unlike anchors only let a window pass.
BASE = 0x2545F4914F6CDD1D
VALUE = np.array([Random(f"value {b}").getrandbits(64) for b in range(256)], np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
GEAR = np.array([Random(f"gear {b}").getrandbits(32) for b in range(256)], np.uint32)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The rolling hash after each byte: each byte's gear, shifted by its age, summed up."""
    h, span = GEAR[data], 1
    while span < reach:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint32(span)
        h, span = h + older, 2 * span
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks, the last one being the end of the text."""
    n = len(data)
    if not n:
        return []
    # The high bits of the reach see all of its bytes.
    h = gear(np.frombuffer(data, np.uint8)) & np.uint32((1 << REACH) - 1)
    ends = (np.flatnonzero(h < (1 << REACH) // EVERY) + 1).tolist()
    out, last = [], 0
    for end in ends:
        while end - last > LONGEST:
            last += LONGEST
            out.append(last)
        if end - last >= SHORTEST:
            out.append(end)
            last = end
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def natural_cuts(raw: np.ndarray) -> np.ndarray:
    """Ends of chunks, each decided by the ``SEEN`` bytes before it."""
    h = gear(raw) & np.uint32((1 << REACH) - 1)
    ends = np.flatnonzero(h < (1 << REACH) // EVERY) + 1
    return ends[np.diff(ends, prepend=-SHORTEST) >= SHORTEST]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))))
    return _POWERS[0][:n], _POWERS[1]


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, digests) of joined neighbouring chunks; every other digest will do, as it is only missed by letting windows pass."""
    ends = natural_cuts(raw)
    a, b = ends[:-JOINED], ends[JOINED:]
    power, inverse = _powers(len(raw))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUE[raw] * power, dtype=np.uint64)))
    digest = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
    for _ in range(2):
        digest = (digest ^ (digest >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    digest ^= digest >> np.uint64(32)
    few = digest & np.uint64(1) == 0
    return a[few], b[few], digest[few]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after it."""
    edge = np.diff(np.concatenate(([True], _BLANK[raw], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def _numbered(every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests as they come, so that numbers hardly jump, and the number of each entry."""
    unique, first, number = np.unique(every, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return unique[order], rank[number]


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences, which compress better; ``np.cumsum`` takes them back."""
    return np.diff(x, prepend=x.dtype.type(0))


def _asking(name: int, every: np.ndarray, holder: np.ndarray, buckets: int) -> tuple[np.ndarray, Iterator[pa.RecordBatch]]:
    """The number of each digest; one row per bucket: numbers, digests, smallest and largest holder."""
    unique, number = _numbered(every)
    least, most = np.full(len(unique), np.iinfo(np.int64).max), np.full(len(unique), np.iinfo(np.int64).min)
    np.minimum.at(least, number, holder)
    np.maximum.at(most, number, holder)

    def rows() -> Iterator[pa.RecordBatch]:
        if len(unique):
            home = (unique % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(home, kind="stable")
            parts = np.split(by_bucket, np.flatnonzero(np.diff(home[by_bucket], prepend=-1))[1:])
            data = [squeeze([_steps(p).astype("<u4"), unique[p], _steps(least[p]), most[p] - least[p]]) for p in parts]
            yield packed_rows(name, [int(home[p[0]]) for p in parts], data)

    return number, rows()


def _chunker(buckets: int, block_bytes: int, least_words: int):
    def block_rows(name: int, docs: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The anchors' digests, and one row that stays: the texts."""
        found = [anchors(np.frombuffer(t, np.uint8))[2] for t in texts]
        holder = np.repeat(np.array(docs, np.int64), [len(x) for x in found])
        yield from _asking(name, np.concatenate(found), holder, buckets)[1]
        yield packed_rows(name, [-1], [squeeze([np.array(docs, np.int64), np.array([len(t) for t in texts], np.int64), *texts])])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if len(word_bounds(np.frombuffer(text, np.uint8))[0]) < least_words:
                    continue
                docs.append(doc)
                texts.append(text)
                size += len(text)
                if size >= block_bytes:
                    yield from block_rows(name, docs, texts)
                    name, docs, texts, size = name + 1, [], [], 0
        if docs:
            yield from block_rows(name, docs, texts)

    return chunk


def _sharer(named: bool):
    """Rows by bucket -> for each block the numbers of digests that two documents hold, and their smallest and largest holder if ``named``."""

    def merged(bucket: int, blocks: list[int], data: list[bytes]) -> Iterator[pa.RecordBatch]:
        parts = [unsqueeze(d, ("<u4", "<u8", "<i8", "<i8")) for d in data]
        digests, least = np.concatenate([p[1] for p in parts]), np.concatenate([np.cumsum(p[2]) for p in parts])
        most = least + np.concatenate([p[3] for p in parts])
        order = np.argsort(digests, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], digests[order][1:] != digests[order][:-1])))
        counts = np.diff(np.append(starts, len(order)))
        low, high = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[order], starts), counts)
        high[order] = np.repeat(np.maximum.reduceat(most[order], starts), counts)
        at = 0
        for block, (numbers, *_) in zip(blocks, parts):
            own = np.flatnonzero(low[at : at + len(numbers)] < high[at : at + len(numbers)])
            if len(own):
                listed = np.cumsum(numbers, dtype=np.int64)[own]
                holders = [_steps(low[at + own]), high[at + own] - low[at + own]] if named else []
                yield packed_rows(block, [bucket], [squeeze([_steps(listed).astype("<u4"), *holders])])
            at += len(numbers)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, data = None, [], []
        for batch in batches:
            for block, bucket, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != now:
                    if blocks:
                        yield from merged(now, blocks, data)
                    now, blocks, data = bucket, [], []
                blocks.append(block)
                data.append(part)
        if blocks:
            yield from merged(now, blocks, data)

    return share


def _by_block(handle):
    """Rows by block -> ``handle`` of each block, what stayed with it, and its answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stayed, answers = None, None, []
        for batch in batches:
            for block, bucket, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now:
                    if now is not None:
                        yield from handle(now, stayed, answers)
                    now, stayed, answers = block, None, []
                if bucket < 0:
                    stayed = part
                else:
                    answers.append(part)
        if now is not None:
            yield from handle(now, stayed, answers)

    return run


def _windows(buckets: int, least_words: int):
    def handle(name: int, stayed: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        """The digests of windows whose anchors are all shared, and one row that stays: their places."""
        n = int(np.frombuffer(stayed, "<i8", 1)[0])
        docs, _, *texts = unsqueeze(stayed, ("<i8", "<i8", *[bytes] * (n - 2)))
        found = [anchors(np.frombuffer(t, np.uint8)) for t in texts]
        unique, number = _numbered(np.concatenate([x[2] for x in found]))
        again = np.zeros(len(unique), bool)
        for answer in answers:
            again[np.cumsum(unsqueeze(answer, ("<u4",))[0], dtype=np.int64)] = True
        shared, at = again[number], 0
        digest, counts, digests, places = xxhash.xxh64_intdigest, [], [], []
        for text, (a, b, _) in zip(texts, found):
            alone = np.concatenate(([0], np.cumsum(~shared[at : at + len(a)])))
            at += len(a)
            raw = np.frombuffer(text, np.uint8)
            starts, ends = word_bounds(raw)
            starts, ends = starts[: len(starts) - least_words + 1], ends[least_words - 1 :]
            low = np.searchsorted(a, starts + SEEN)
            high = np.maximum(np.searchsorted(b, ends, "right"), low)
            word = np.flatnonzero(alone[high] == alone[low])
            starts, ends = starts[word], ends[word]
            view = memoryview(text)
            counts.append(len(word))
            digests.append(np.array([digest(view[i:j]) for i, j in zip(starts.tolist(), ends.tolist())], np.uint64))
            if len(word):
                points, cut = np.cumsum((raw & 0xC0) != 0x80), natural_cuts(raw)  # code points up to and with each byte
                places.append(np.stack([word, points[starts] - 1, points[ends - 1], np.searchsorted(cut, starts, "right"), np.searchsorted(cut, ends)]))
        if places:
            number, rows = _asking(name, np.concatenate(digests), np.repeat(docs, counts), buckets)
            yield from rows
            places = [_steps(x).astype("<i8") for x in np.concatenate(places, axis=1)]
            yield packed_rows(name, [-1], [squeeze([docs, np.array(counts, np.int64), _steps(number), *places])])

    return _by_block(handle)


def _joiner(least_words: int):
    def handle(_: int, stayed: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Passages: windows in a row with one holder."""
        docs, counts, *rest = unsqueeze(stayed, ("<i8",) * 8)
        number, word, start, end, cut, last_cut = (np.cumsum(x) for x in rest)
        text = np.repeat(np.arange(len(docs)), counts)
        low = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
        high = low.copy()
        again = np.zeros(len(low), bool)
        for answer in answers:
            own, least, more = unsqueeze(answer, ("<u4", "<i8", "<i8"))
            own = np.cumsum(own, dtype=np.int64)
            again[own], low[own] = True, np.cumsum(least)
            high[own] = low[own] + more
        kept = np.flatnonzero(again[number])
        if not len(kept):
            return
        number, word, text = number[kept], word[kept], text[kept]
        doc, first = docs[text], low[number]
        holder = np.where(first == doc, high[number], first)
        begins = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (word[1:] != word[:-1] + 1) | (holder[1:] != holder[:-1]))))
        ends = np.append(begins[1:], len(kept)) - 1
        a, b = kept[begins], kept[ends]
        columns = (doc[begins], start[a], end[b], word[ends] - word[begins] + least_words, last_cut[b] - cut[a] + 1, first[begins])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], names=["doc", "start", "end", "n_words", "n_chunks", "first"])

    return _by_block(handle)


def repeated_passages(docs: DataFrame, least_words: int = PASSAGE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, start, end, n_words, n_chunks, first_doc_id, keep), positions in code points.

    One row for each passage that another document holds too; ``first_doc_id`` is
    the smallest id that holds it, and ``keep`` says whether that is this document.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), whole_text().alias("text"))
    buckets = bucket_count(docs.sparkSession)

    def answered(stored: DataFrame, named: bool) -> DataFrame:
        asked = stored.where("bucket >= 0").repartition("bucket").sortWithinPartitions("bucket")
        return asked.mapInArrow(_sharer(named), PACKED).unionAll(stored.where("bucket < 0")).repartition("block").sortWithinPartitions("block")

    chunked = staged(texts.mapInArrow(_chunker(buckets, block_bytes, least_words), PACKED))
    windows = staged(answered(chunked, False).mapInArrow(_windows(buckets, least_words), PACKED))
    schema = "doc long, start long, end long, n_words long, n_chunks long, first long"
    return answered(windows, True).mapInArrow(_joiner(least_words), schema).select(
        _id("doc").alias("doc_id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_words",
        "n_chunks", _id("first").alias("first_doc_id"), (F.col("first") == F.col("doc")).alias("keep"),
    )


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name))


def without_repeats(docs: DataFrame, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` with every repeated passage cut out of all texts but that of its smallest id.

    Rows that repeat an id lose the passages of either row; ids that are null keep their text.
    """
    own, spans = fresh(docs, "_own"), fresh(docs, "_spans")
    gone = repeated_passages(docs, least_words).where("not keep and doc_id is not null").groupBy(F.col("doc_id").alias(own)).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias(spans)
    )
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col(own), "left")
    # What stands before each passage is kept; passages may overlap.
    text = F.aggregate(
        spans,
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda x, s: F.struct(
            F.concat(x["kept"], F.substring(whole_text(), x["at"] + 1, F.greatest(s["start"] - x["at"], F.lit(0)))).alias("kept"),
            F.greatest(x["at"], s["end"]).alias("at"),
        ),
        lambda x: F.concat(x["kept"], F.substring(whole_text(), x["at"] + 1, F.char_length(whole_text()))),
    )
    return joined.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
