"""Quality rules by robust multivariate outliers (operator 13).

Each text is measured once.  Texts that pass the base rules become vectors of six
transformed statistics.  For every language and source a minimum-covariance-
determinant estimate is made from all its vectors: from two starts (mean and
covariance; medians and quartile ranges) concentration steps follow, each keeping
the ``HALF`` of the vectors that are nearest by the present estimate and estimating
anew from these, until nothing moves; the start with the smaller determinant wins.
A text is kept if its squared Mahalanobis distance is at most ``CUTOFF``.

A step is one aggregate over all vectors: counts, sums and products by group,
start and bin of the distance.  Whole bins are taken from the nearest on until at
least the wanted share is in, so there is no sorting, no group in one task, and the
same rows give the same estimate however they are dealt.  A source with a third of
all rows is added up before the shuffle like any other.

``SCALES`` are the differences of a statistic that say nothing: their squares are
added to the variances, so that a statistic which most texts have at zero makes no
outlier of the first text that differs.

Defined results: null text has no words; ids are only carried along, repeated rows
are measured each and count each; null and empty languages and sources are the same;
sources with fewer than ``LEAST_ROWS`` vectors form one group in their language,
languages with fewer one for all, and if that is as small, its texts are kept; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .common import whole_text

SHORTEST, MOST_REPEATED = 50, 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
#: Differences without meaning: log of words, characters a word, and roots of the shares of
#: symbols, repeated lines, repeated words and capital letters.
SCALES = (1.0, 0.5, 0.1, 0.2, 0.2, 0.1)
SIZE = len(SCALES)
PAIRS = tuple(combinations_with_replacement(range(SIZE), 2))
#: Share of the vectors that an estimate rests on.
HALF = 0.75
#: Vectors that a group needs for an estimate of its own.
LEAST_ROWS = 200
#: Concentration steps at most, and bins of distances for each doubling.
STEPS, BINS = 25, 16
# Fixed values of the chi-squared law of six degrees of freedom: its 0.999 quantile, and the factor that makes the
# covariance of the nearest 75 % consistent (0.75 over the law of eight degrees at the 0.75 quantile of six).
CUTOFF, CONSISTENT = 22.458, 1.3625
#: Steps per scale in which quartiles are read off.
GRID = 64
GROUP = ["level", "lang", "source"]


def repeated_words(numbers: np.ndarray) -> int:
    """Positions inside windows of three words that occur at least twice."""
    n = len(numbers)
    if n < 4:
        return 0
    base = int(numbers.max()) + 1
    _, pair = np.unique(numbers[:-1] * base + numbers[1:], return_inverse=True)
    _, window, count = np.unique(pair[:-1].astype(np.int64) * base + numbers[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def measured(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, repeated words, lines with a word, capitals A-Z)."""
    words = text.split()
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    repeated = repeated_words(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    seen: set[bytes] = set()
    again = lines = 0
    for line in text.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            again += line in seen
            seen.add(line)
    inner = sum(map(text.count, range(0x80, 0xC0))) if not text.isascii() else 0
    chars = len(text) - inner - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return len(words), chars, symbols, again, repeated, lines, capitals


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([measured(t) for t in batch.column(3).cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(MEASURES))
        arrays = [*batch.columns[:3], *(pa.array(np.ascontiguousarray(c)) for c in got.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "lang", "source", *MEASURES])


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, measures, base_failed) of every row."""
    named = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], whole_text().alias("text"),
    )
    rows = named.mapInArrow(_measure, "doc_id long, lang string, source string, " + ", ".join(f"{m} long" for m in MEASURES))
    failed = (F.col("n_words") < SHORTEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def vector() -> Column:
    """The transformed statistics of a measured row."""
    share = lambda part, whole: F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return F.array(
        F.log1p(F.col("n_words").cast("double")), F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        share("n_symbols", "n_words"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars"),
    )


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, source, x) with their group in place of language and source.

    Level 0 is a source of a language, 1 the small sources of a language, 2 those of small languages.
    """
    sizes = staged(rows.groupBy("lang", "source").agg(F.count("x").alias("n")))
    rest = sizes.where(F.col("n") < LEAST_ROWS).groupBy("lang").agg(F.sum("n").alias("rest"))
    level = F.when(F.col("n") >= LEAST_ROWS, 0).when(F.col("rest") >= LEAST_ROWS, 1).otherwise(2)
    placed = staged(
        sizes.join(rest, "lang", "left").withColumn("level", level).select(
            F.col("lang").alias("own_lang"), F.col("source").alias("own_source"), "level",
            F.when(F.col("level") < 2, F.col("lang")).otherwise("").alias("to_lang"), F.when(F.col("level") < 1, F.col("source")).otherwise("").alias("to_source"),
        )
    )
    same = (F.col("lang") == F.col("own_lang")) & (F.col("source") == F.col("own_source"))
    keep = [c for c in rows.columns if c not in GROUP]
    return rows.join(placed, same).select(*keep, "level", F.col("to_lang").alias("lang"), F.col("to_source").alias("source"))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From added-up rows to mean, inverse and log determinant of the covariance."""
    for batch in batches:
        n = batch.column(4).to_numpy().astype(float)
        flat = np.array(batch.column(5).to_pylist(), float).reshape(len(n), SIZE + len(PAIRS))
        mean = flat[:, :SIZE] / n[:, None]
        cov = np.zeros((len(n), SIZE, SIZE))
        for at, (i, j) in enumerate(PAIRS):
            cov[:, i, j] = cov[:, j, i] = flat[:, SIZE + at] / n - mean[:, i] * mean[:, j]
        yield _estimates(batch.columns[:4], mean, CONSISTENT * cov)


def _estimates(keys: list[pa.Array], mean: np.ndarray, cov: np.ndarray) -> pa.RecordBatch:
    """Rounded, so that the order in which rows were added up leaves no trace."""
    whole = np.round(cov, 9) + np.diag(np.square(SCALES))
    inverse = np.linalg.inv(whole) if len(whole) else whole
    size = np.linalg.slogdet(whole)[1] if len(whole) else np.empty(0)
    listed = lambda a: pa.array(a.reshape(len(a), -1).tolist(), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [*keys, listed(np.round(mean, 9)), listed(inverse), pa.array(np.round(size, 9))], names=[*GROUP, "start", "mean", "inverse", "size"]
    )


_ESTIMATE = "level int, lang string, source string, start int, mean array<double>, inverse array<double>, size double"


def _sums() -> Column:
    """Sums of the statistics and of their products."""
    x = [F.col("x")[i] for i in range(SIZE)]
    return F.array(*[F.sum(v) for v in x], *[F.sum(x[i] * x[j]) for i, j in PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance of ``x`` by ``mean`` and ``inverse``."""
    y = [F.col("x")[i] - F.col("mean")[i] for i in range(SIZE)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + F.lit(1.0 if i == j else 2.0) * F.col("inverse")[i * SIZE + j] * y[i] * y[j]
    return total


def medians(vectors: DataFrame) -> DataFrame:
    """Start 1: medians, and quartile ranges as scales, of each statistic alone."""
    cells = vectors.select(*GROUP, F.posexplode("x").alias("at", "v"))
    scale = F.element_at(F.array(*map(F.lit, SCALES)), F.col("at") + 1) / GRID
    counted = cells.groupBy(*GROUP, "at", F.round(F.col("v") / scale).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*GROUP, "at").orderBy("bin")
    placed = counted.select("*", F.sum("n").over(up_to).alias("below"), F.sum("n").over(Window.partitionBy(*GROUP, "at")).alias("all"))
    quartile = lambda q: F.min(F.when(F.col("below") >= q * F.col("all"), F.col("bin") * scale))
    each = placed.groupBy(*GROUP, "at").agg(quartile(0.25).alias("low"), quartile(0.5).alias("middle"), quartile(0.75).alias("high"))
    read = each.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("at", "middle", ((F.col("high") - F.col("low")) / 1.349).alias("spread")))).alias("way"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            way = batch.column(3).to_pylist()
            mean = np.array([[s["middle"] for s in w] for w in way]).reshape(-1, SIZE)
            spread = np.array([[s["spread"] for s in w] for w in way]).reshape(-1, SIZE)
            cov = np.square(spread)[:, :, None] * np.eye(SIZE)
            yield _estimates([*batch.columns[:3], pa.array([1] * len(mean), pa.int32())], mean, cov)

    return read.mapInArrow(start, _ESTIMATE)


def concentrated(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step: new estimates from the nearest vectors of each group and start."""
    keys = [*GROUP, "start"]
    near = vectors.join(estimates, GROUP).withColumn("bin", F.floor(F.log2(F.greatest(distance(), F.lit(1e-9))) * BINS).cast("int"))
    binned = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), _sums().alias("sums"))
    group = Window.partitionBy(*keys)
    placed = binned.select(
        "*", F.coalesce(F.sum("n").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(group).alias("all")
    )
    taken = placed.where(F.col("before") < HALF * F.col("all"))
    added = taken.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(SIZE + len(PAIRS))]).alias("sums"))
    return added.select(*GROUP, "start", "n", "sums").mapInArrow(_estimate, _ESTIMATE)


def estimates(vectors: DataFrame) -> DataFrame:
    """(level, lang, source, mean, inverse, size) of every group that has enough vectors."""
    sizes = vectors.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), _sums().alias("sums"))
    enough = staged(sizes.where(F.col("n") >= LEAST_ROWS))
    plain = enough.select(*GROUP, F.lit(0).alias("start"), "n", "sums").mapInArrow(_estimate, _ESTIMATE)
    now = staged(plain.unionByName(medians(vectors.join(enough.select(*GROUP), GROUP, "left_semi"))))
    for _ in range(STEPS):
        after = staged(concentrated(vectors, now))
        moved = after.alias("a").join(now.alias("b"), [*GROUP, "start"]).where("abs(a.size - b.size) > 1e-6").limit(1).count()
        now = after
        if not moved:
            break
    best = now.groupBy(*GROUP).agg(F.min_by(F.struct("mean", "inverse", "size"), F.struct("size", "start")).alias("e"))
    return best.select(*GROUP, "e.mean", "e.inverse", "e.size")


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept, distance) of every row; no distance where none is needed or known."""
    rows = staged(measures(docs))
    passed = rows.where("NOT base_failed").withColumn("x", vector())
    vectors = staged(grouped(passed))
    known = staged(estimates(vectors))
    out = [c for c in rows.columns if c not in GROUP]
    far = vectors.join(known, GROUP, "left").withColumn("distance", F.when(F.col("mean").isNotNull(), distance()))
    good = far.select(*out, (F.col("distance").isNull() | (F.col("distance") <= CUTOFF)).alias("kept"), "distance")
    bad = rows.where("base_failed").select(*out, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return good.unionByName(bad)
