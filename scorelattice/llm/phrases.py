"""Collocations from sorted count streams (operator 12).

Counting.  Texts become blocks of word numbers.  A first pass counts words and
pairs of words by a hash; those with enough occurrences set bits in a map of fixed size.
In the second pass every position gives the words from there on, five at most,
cut where the map says that a word or pair is too rare to be in any candidate (a
wrong bit only lets more through).  Equal rows of a block are one row with a
count.  A block hands its rows on sorted, as one compressed run for each range of
language and words; the ranges are quantiles of a bounded sample.  The runs of a
range are merged, and one walk along it closes the counts of all phrases of one to
five words where the words change.  Only phrases open at the ends of a range meet others.
Neither a hot first word nor a passage with most of all positions makes a hot
task: ranges split anywhere between different rows, and a row comes once a block.

Joining.  The counts of at least ``LEAST`` are kept as two stored streams: in
prefix order (words from the first) and in suffix order (words from the last).
Merge joins walk a stream next to itself: each phrase meets the phrases that it
starts with (in the order of the stream) and those that are one word longer.  In
prefix order this gives the counts of left parts and of extensions to the right,
in suffix order those of right parts and of extensions to the left.  Both meet in
a last merge join.

Scores are exact: products are decimals of 38 digits, divided as integers.

Defined results: null text is the empty text; a null language is ``und``; ids are
not used; repeated rows count each time; ties are broken by the smaller cut and
by the phrase; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .common import smallest_hashes, squeeze, unsqueeze, whole_text

#: Words of the longest phrase, and occurrences that make a candidate.
LONGEST, LEAST = 5, 100
#: A candidate goes if a longer one has this share of its occurrences, in hundredths.
COVERED = 100
#: First rows of each language that are returned.
TOP = 2000
#: Bits of the map of frequent words and pairs, whatever the data.
MAP_BITS = 1 << 26
#: Positions of a block, and bytes of a text split at a time.
BLOCK, SLICE = 3_000_000, 1 << 20
#: Ranges for each shuffle partition, and texts and rows that their bounds are taken from.
RANGES, SAMPLE_TEXTS, SAMPLE_ROWS = 2, 4_000, 50_000
#: A-Z lower-cased, tabs as blanks, ends of pieces as line ends.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """A folded text in slices that end between words."""
    start = 0
    while start < len(text):
        ends = [e for e in (text.find(b" ", start + SLICE), text.find(b"\n", start + SLICE)) if e >= 0]
        end = min(ends, default=len(text))
        yield text[start:end]
        start = end


class _Words:
    """Word numbers of one language: word 0 is the end of a piece."""

    def __init__(self) -> None:
        self.begin([])

    def begin(self, words: list[bytes]) -> None:
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b"\n"], self.number[b""]
        self.parts = [np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))]

    def add(self, text: bytes) -> int:
        added = 1
        for piece in _pieces(text.translate(FOLD)):
            words = piece.replace(b"\n", b" \n ").split(b" ")
            found = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            self.parts.append(found[found != 1])
            added += len(self.parts[-1])
        self.parts.append(np.zeros(1, np.int32))
        return added

    def take(self) -> tuple[list[bytes], np.ndarray]:
        names, every = list(self.number), np.concatenate(self.parts)
        self.begin([])
        return names, every


def blocks(rows: Iterable[tuple[str, bytes]], longest: int = LONGEST, bound: int = BLOCK) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """(language, vocabulary, numbers), all languages together of about ``bound`` positions at a time.

    The last ``longest - 1`` numbers of a block are ends of pieces that start no phrase.
    """
    held: defaultdict[str, _Words] = defaultdict(_Words)
    n = 0

    def taken() -> Iterator[tuple[str, list[bytes], np.ndarray]]:
        while held:
            lang, words = held.popitem()
            names, every = words.take()
            yield lang, names, np.append(every, np.zeros(longest - 1, np.int32))

    for lang, text in rows:
        n += held[lang].add(text)
        if n >= bound:
            yield from taken()
            n = 0
    yield from taken()


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist())


def _hashes(lang: str, names: list[bytes]) -> np.ndarray:
    head = lang.encode() + b"\n"
    return np.fromiter((xxhash.xxh64_intdigest(head + w) for w in names), np.uint64, len(names))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    mixed = a * np.uint64(0x9E3779B97F4A7C15) + b
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def _counter(longest: int):
    """Occurrences of words and pairs by hash, and of all words (hash null)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in blocks(_rows_of(batches), longest):
            single = np.bincount(ids, minlength=len(names))
            single[0] = 0
            known = np.flatnonzero(single)
            first = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            pairs, n = np.unique(ids[first].astype(np.int64) * len(names) + ids[first + 1], return_counts=True)
            own = _hashes(lang, names)
            hashes = np.concatenate([own[known], _pair(own[pairs // len(names)], own[pairs % len(names)])]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * len(hashes) + [lang], pa.string()),
                    pa.concat_arrays([pa.array(hashes), pa.nulls(1, pa.int64())]),
                    pa.array(np.concatenate([single[known], n, [single.sum()]])),
                ],
                names=["lang", "hash", "n"],
            )

    return count


def frequent(texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, np.ndarray]:
    """(lang, n), the number of all words, and the map of frequent words and pairs."""
    counted = texts.mapInArrow(_counter(longest), "lang string, hash long, n long")
    seen = staged(counted.groupBy("lang", "hash").agg(F.sum("n").alias("n")).where(F.col("hash").isNull() | (F.col("n") >= least)))
    slot = F.pmod("hash", F.lit(MAP_BITS))
    marked = seen.where("hash IS NOT NULL").select(
        F.floor(slot / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(hash, {MAP_BITS}) % 64 AS int))").alias("bit")
    )
    # At most MAP_BITS / 64 rows.
    set_ = marked.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[set_["word"].to_numpy(np.int64)] = set_["bits"].to_numpy(np.int64)
    return seen.where("hash IS NULL").select("lang", "n"), bits.view(np.uint64)


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.int64) % (64 * len(bits))
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _sorted_rows(bits: np.ndarray, lang: str, names: list[bytes], ids: np.ndarray, longest: int) -> tuple[list[bytes], np.ndarray]:
    """Distinct rows of a block in order: the frequent words from a position on, each ended by a line end; and their counts."""
    own = _hashes(lang, names)
    good = _known(bits, own)
    good[0] = False
    ids = np.where(good[ids], ids, 0)
    follows = np.zeros(len(ids), bool)
    at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    follows[at] = _known(bits, _pair(own[ids[at]], own[ids[at + 1]]))
    # Positions with one word only are counted by word, the others by row.
    single = np.bincount(ids[~follows], minlength=len(names))
    single[0] = 0
    alone = np.flatnonzero(single)
    starts = np.flatnonzero(follows)
    columns, alive = [ids[starts], ids[starts + 1]], np.ones(len(starts), bool)
    for k in range(2, longest):
        alive = alive & follows[starts + k - 1]
        columns.append(np.where(alive, ids[starts + k], 0))
    rows, counts = _distinct(columns, len(names))
    counts = np.concatenate([single[alone], counts])
    rows = [np.concatenate([x, r]) for x, r in zip([alone, *[np.zeros_like(alone)] * (longest - 1)], rows)]
    ended = [b"\n", b"", *(w + b"\n" for w in names[2:])]
    keys = [b"".join(map(ended.__getitem__, r)) for r in zip(*(c.tolist() for c in rows))]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    return [keys[i] for i in order], counts[order]


def _suffixes(bits, longest: int):
    """The rows of a block as they are, for a sample."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in blocks(_rows_of(batches), longest):
            keys, _ = _sorted_rows(bits.value, lang, names, ids, longest)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.binary()).cast(pa.string())], names=["lang", "words"]
            )

    return find


def _runs(bits, bounds: list[tuple[str, str]], longest: int):
    """The rows of a block as compressed runs, one for each range that it has rows in."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, ids in blocks(_rows_of(batches), longest):
            keys, counts = _sorted_rows(bits.value, lang, names, ids, longest)
            first = bisect_left(bounds, (lang, ""))
            own = [w.encode() for at, w in bounds[first:] if at == lang]
            cuts = [0, *(bisect_left(keys, w) for w in own), len(keys)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if a < b:
                    data = squeeze([b"".join(keys[a:b]), counts[a:b].astype(np.int64)])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([first + k], pa.int32()), pa.array([lang], pa.string()), pa.array([data], pa.binary())], names=["range", "lang", "data"]
                    )

    return find


def _merger(least: int, longest: int):
    """All runs of a range merged, and walked."""

    def merge(runs: pa.Table) -> pa.Table:
        parts = []
        for lang, data in zip(runs.column("lang").to_pylist(), runs.column("data").to_pylist()):
            joined, counts = unsqueeze(data, (bytes, np.int64))
            ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 10)[longest - 1 :: longest] + 1
            words = pa.StringArray.from_buffers(len(counts), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(joined))
            parts.append(pa.table({"lang": pa.array([lang] * len(counts), pa.string()), "words": words, "n": pa.array(counts)}))
        together = pa.concat_tables(parts).sort_by([("lang", "ascending"), ("words", "ascending")]).combine_chunks()
        return pa.Table.from_batches(_walk(least, longest)(iter(together.to_batches(1 << 16))))

    return merge


def range_bounds(texts: DataFrame, bits, longest: int) -> list[tuple[str, str]]:
    """Ascending (lang, words): quantiles of the rows of a sample of texts."""
    spark = texts.sparkSession
    wanted = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = SAMPLE_TEXTS / max(texts.count(), 1)
    key = F.xxhash64("text")
    some = texts.where(key < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else texts
    rows = staged(some.mapInArrow(_suffixes(bits, longest), "lang string, words string"))
    total = rows.count()
    kept = smallest_hashes(rows.distinct(), ["lang", "words"], SAMPLE_ROWS, total).collect()
    keys = sorted((r["lang"].encode(), r["words"].encode()) for r in kept)
    return sorted({(lang.decode(), words.decode()) for lang, words in (keys[i * len(keys) // wanted] for i in range(1, wanted) if keys)})


def _distinct(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Different rows of several columns of numbers below ``size``, and how often each occurs."""
    width = max(int(size).bit_length(), 1)
    each = 63 // width
    keys = []
    for at in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), np.int64)
        for column in columns[at : at + each]:
            key = (key << width) | column.astype(np.int64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.diff(np.append(first, len(order)))


def _walk(least: int, longest: int):
    """Counts of all phrases along a sorted range; those open at its ends are given whatever their count."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each number of words: the phrase that may go on, its count, whether the range began with it.
        open_: list[tuple[tuple[str, ...], int, bool] | None] = [None] * longest
        out: list[tuple[str, str, int, int]] = []
        begun = False

        def close(phrase: tuple[str, ...], n: int) -> None:
            out.append((phrase[0], " ".join(phrase[1:]), len(phrase) - 1, n))

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, n = batch.column(0).dictionary_encode(), batch.column(2).to_numpy()
            words = pc.split_pattern(batch.column(1), "\n").values.dictionary_encode()
            names, spoken = words.dictionary.to_pylist(), lang.dictionary.to_pylist()
            numbers = words.indices.to_numpy().reshape(-1, longest + 1)[:, :longest]
            languages = lang.indices.to_numpy()
            empty = names.index("")  # behind the last line end
            changed = np.ones(len(n), bool)
            changed[1:] = languages[1:] != languages[:-1]
            for k in range(longest):
                changed[1:] |= numbers[1:, k] != numbers[:-1, k]
                starts = np.flatnonzero(changed)
                sums, real = np.add.reduceat(n, starts), numbers[starts, k] != empty

                def phrase(run: int) -> tuple[str, ...]:
                    row = starts[run]
                    return (spoken[languages[row]], *(names[i] for i in numbers[row, : k + 1]))

                before, edge = open_[k], not begun
                if before is not None and real[0] and phrase(0) == before[0]:
                    sums[0] += before[1]
                    edge = before[2]
                elif before is not None and (before[1] >= least or before[2]):
                    close(before[0], before[1])
                last = len(starts) - 1
                full = (sums >= least) & real
                if edge and real[0]:
                    full[0] = True
                full[last] = False
                for run in np.flatnonzero(full).tolist():
                    close(phrase(run), int(sums[run]))
                open_[k] = (phrase(last), int(sums[last]), edge and last == 0) if real[last] else None
            begun = True
            yield _rows(out)
            out.clear()
        for left in filter(None, open_):
            close(left[0], left[1])
        yield _rows(out)

    return walk


def _rows(out: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["lang", "phrase", "size", "a"])


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Stored (lang, phrase, size, a) of all phrases with at least ``least`` occurrences, and (lang, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    totals, bits = frequent(texts, least, longest)
    held = docs.sparkSession.sparkContext.broadcast(bits)
    bounds = range_bounds(texts, held, longest)
    runs = texts.mapInArrow(_runs(held, bounds, longest), "range int, lang string, data binary")
    closed = runs.groupBy("range").applyInArrow(_merger(least, longest), "lang string, phrase string, size int, a long")
    return staged(closed.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)), totals


def turned(phrase: str = "phrase") -> Column:
    """The phrase from its last word to its first."""
    return F.array_join(F.reverse(F.split(phrase, " ")), " ")


def stream(counted: DataFrame, key: Column) -> DataFrame:
    """The counts stored in the order of ``key``."""
    keyed = counted.select("lang", key.alias("key"), "size", "a")
    return staged(keyed.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key"))


def along(ordered: DataFrame) -> DataFrame:
    """(lang, key, size, a, parts, longer) of the phrases of two words and more.

    ``parts``: counts of the phrases that the key starts with, the shortest first;
    ``longer``: the largest count of a phrase that is one word longer, if any.
    """
    parts = ordered.where("size > 1").select("lang", "key", "size", "a", F.expr("explode(sequence(1, size - 1))").alias("k"))
    steps = parts.withColumn("part", F.expr("substring_index(key, ' ', k)"))
    own = ordered.select("lang", F.col("key").alias("part"), F.col("a").alias("f"))
    met = steps.join(own.hint("merge"), ["lang", "part"])
    held = met.groupBy("lang", "key", "size", "a").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("parts"))
    longer = steps.where("k = size - 1").groupBy("lang", F.col("part").alias("key")).agg(F.max("a").alias("longer"))
    return held.withColumn("parts", F.col("parts.f")).join(longer.hint("merge"), ["lang", "key"], "left")


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (left right)), exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    above, below = wide(a) * F.lit(1000) * wide(n), wide(left) * wide(right)
    return F.call_function("div", above, below)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): the first ``top`` candidates of each language."""
    counted, totals = counts(docs, least, longest)
    forward = along(stream(counted, F.col("phrase"))).select(
        "lang", F.col("key").alias("phrase"), "size", "a", F.col("parts").alias("lefts"), F.col("longer").alias("to_right")
    )
    backward = along(stream(counted, turned())).select(
        "lang", turned("key").alias("phrase"), F.col("parts").alias("rights"), F.col("longer").alias("to_left")
    )
    both = forward.join(backward.hint("merge"), ["lang", "phrase"])
    free = both.where(100 * F.coalesce(F.greatest("to_right", "to_left"), F.lit(0)) < covered * F.col("a"))
    scored = free.join(totals, "lang")

    def cut(k: Column) -> Column:
        left, right = F.get(F.col("lefts"), k - 1), F.get(F.col("rights"), F.col("size") - k - 1)
        return F.struct(cut_score(F.col("a"), F.col("n"), left, right).alias("score"), k.alias("cut"), left.alias("l"), right.alias("r"))

    best = scored.withColumn("best", F.array_min(F.transform(F.expr("sequence(1, size - 1)"), cut)))
    named = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score", "best.cut")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut")
