"""Approximate nearest neighbours over balanced posting lists (operator 9).

Centroids are fitted on a bounded sample, with a price on size so that lists
stay balanced.  Every vector is posted to its nearest centroid; one near a
boundary also to the next ones, up to a distance ratio.  A query walks a graph
of centroids held in memory, best first, and searches the lists whose centroid
is within a distance ratio of the nearest.  How many lists and which ratio that
takes is measured: some queries are also searched exactly, and both grow until
the lists searched hold the share of true neighbours asked for, so recall holds
however many lists there are.  Lists and their queries meet in a shuffle by list, both sides cut into blocks of bounded size; each block keeps
the nearest few of every query, and the best over all blocks remain.

Equal vectors are one posting with their smallest ids: only these can be among
the nearest, as ties go to smaller ids.  So a vector that a third of all rows
share is one posting, searched once.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows without an id or vectors of another length
than most (ties: the longer); a repeated row counts once; of an id with several
vectors the nearest counts; with fewer candidates than asked for, all that the
searched lists hold are returned; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import staged
from .common import smallest_hashes

NEAREST = 10
QUERIES_OF = 100
#: Vectors that centroids are fitted on at least, and for each centroid; the most centroids (all held by the driver, centroids also broadcast).
SAMPLE, SAMPLE_PER_LIST, MOST_LISTS = 16_384, 8, 4_096
#: Vectors per list that are aimed at.
LIST_SIZE = 128
#: Lists a boundary vector is posted to, and how much farther than the nearest they may be.
COPIES, COPY_RATIO = 3, 1.08
#: Lists that a query searches at least and at most, and how much farther than the nearest those in between may be; the last two are where calibration starts.
LEAST_PROBES, PROBES, PROBE_RATIO = 32, 96, 1.6
#: Queries that calibrate, the share of their nearest vectors that the lists searched must hold, and the steps by which lists and ratio grow.
TRIED, RECALL, MORE_PROBES, MORE_RATIO = 256, 0.97, 1.2, 1.05
#: Neighbours of a centroid in the graph, and candidates kept during the walk (twice the lists searched if that is more).
DEGREE, BEAM = 24, 192
#: Rows of a list, and its queries, that meet in one group.
BLOCK = 4_096
#: Vectors whose distances to all centroids are held at once.
ROWS = 1_024
ROUNDS, PRICE = 12, 0.05


def fit_centroids(sample: np.ndarray, k: int, rounds: int = ROUNDS, price: float = PRICE, seed: int = 9) -> np.ndarray:
    """k-means where a centroid's distance grows with its size."""
    r = np.random.default_rng(seed)
    centres = sample[r.choice(len(sample), k, replace=False)].astype(np.float64)
    load = np.ones(k)
    for _ in range(rounds):
        scale = np.median(np.concatenate([_squared(x, centres).min(1) for x in _slices(sample)])) + 1e-12
        own = np.concatenate([(_squared(x, centres) + price * scale * np.log(load)[None, :]).argmin(1) for x in _slices(sample)])
        count = np.bincount(own, minlength=k).astype(float)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        full = count > 0
        centres[full] = total[full] / count[full, None]
        centres[~full] = sample[r.choice(len(sample), int((~full).sum()))]
        load = np.maximum(count * k / len(sample), 0.1)
    return centres


def _slices(a: np.ndarray) -> list[np.ndarray]:
    return [a[i : i + ROWS] for i in range(0, len(a), ROWS)]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0)


class Graph:
    """Centroids and their nearest other centroids."""

    def __init__(self, centres: np.ndarray, degree: int = DEGREE) -> None:
        self.centres = centres
        n = len(centres)
        near = np.concatenate([np.argsort(_squared(x, centres), axis=1, kind="stable")[:, 1 : degree + 1] for x in _slices(centres)]) if n > 1 else np.empty((n, 0), int)
        links = [set(row.tolist()) for row in near]
        for a, row in enumerate(near.tolist()):
            for b in row:
                links[b].add(a)
        self.links = [np.array(sorted(x), np.int64) for x in links]
        self.entries = np.linspace(0, n - 1, min(n, 8)).astype(np.int64) if n else np.empty(0, np.int64)

    def nearest(self, vector: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walk: (centroids, distances), nearest first."""
        seen = np.zeros(len(self.centres), bool)
        frontier: list[tuple[float, int]] = []
        kept: list[tuple[float, int]] = []

        def visit(ids: np.ndarray) -> None:
            ids = ids[~seen[ids]]
            seen[ids] = True
            if not len(ids):
                return
            for d, i in zip(np.sqrt(((self.centres[ids] - vector) ** 2).sum(1)).tolist(), ids.tolist()):
                if len(kept) < beam or d < -kept[0][0]:
                    heapq.heappush(frontier, (d, i))
                    heapq.heappush(kept, (-d, i))
                    if len(kept) > beam:
                        heapq.heappop(kept)

        visit(self.entries)
        while frontier:
            d, i = heapq.heappop(frontier)
            if len(kept) >= beam and d > -kept[0][0]:
                break
            visit(self.links[i])
        order = sorted((-d, i) for d, i in kept)
        return np.array([i for _, i in order], np.int64), np.array([d for d, _ in order])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part; v as doubles, without negative zeros."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    ).where(~bad & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (lengths["n"] if lengths else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(h1, h2, v, ids): each vector once with its ``keep`` smallest ids."""
    named = rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"))
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = named.withColumn("place", F.dense_rank().over(order)).where(F.col("place") <= keep)
    return few.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.array_sort(F.collect_set("vec_id")).alias("ids"))


def lists_of(v: np.ndarray, c: np.ndarray, copies: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lists): the nearest list of every vector, and others within the ratio."""
    n, rows, lists = min(copies, len(c)), [], []
    for i, part in enumerate(_slices(v)):
        d = np.sqrt(_squared(part, c))
        best = np.argpartition(d, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(d, best, 1)
        own, which = np.nonzero(near <= ratio * near.min(1, keepdims=True) + 1e-12)
        rows.append(own + i * ROWS)
        lists.append(best[own, which])
    return np.concatenate(rows), np.concatenate(lists)


def _poster(centres, copies: int, ratio: float):
    """Lists of every vector."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for batch in batches:
            v = np.array(batch.column(2).to_pylist(), np.float64)
            if not len(v):
                continue
            rows, lists = lists_of(v, c, copies, ratio)
            taken = pa.array(rows)
            arrays = [pa.array(lists.astype(np.int32)), *[batch.column(i).take(taken) for i in range(4)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["list", "h1", "h2", "v", "ids"])

    return post


def _searched(ids: np.ndarray, d: np.ndarray, probes: int, ratio: float) -> np.ndarray:
    """Those that a query searches, of centroids from the nearest on."""
    near = d[:probes] <= ratio * d[0]
    near[:LEAST_PROBES] = True  # a vector may be the centroid of its own list
    return ids[:probes][near]


def _exact(asked: np.ndarray, names: list, k: int):
    """The k nearest other vectors of each query asked, of a task's rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in asked]
        place = {name: i for i, name in enumerate(names)}
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if not keys:
                continue
            v = np.array(batch.column(2).to_pylist(), np.float64)
            d = np.sqrt(_squared(asked, v))
            for j, key in enumerate(keys):
                if key in place:
                    d[place[key], j] = np.inf
            n = min(k, len(v))
            best = np.argpartition(d, n - 1, axis=1)[:, :n]
            for i, own in enumerate(best.tolist()):
                kept[i] = sorted(kept[i] + [(float(d[i, j]), keys[j], v[j]) for j in own if d[i, j] < np.inf], key=lambda x: x[:2])[:k]
        rows = [(i, score, *key, x) for i, own in enumerate(kept) for score, key, x in own]
        kinds = (pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["query", "score", "h1", "h2", "v"])

    return find


def calibrated(once: DataFrame, wanted: DataFrame, centres: np.ndarray, k: int, probes: int, ratio: float) -> tuple[int, float]:
    """(probes, ratio), grown until the lists searched hold ``RECALL`` of the true neighbours of ``TRIED`` queries."""
    if len(centres) <= LEAST_PROBES:
        return probes, ratio
    tried = wanted.orderBy("h1", "h2").limit(TRIED).collect()
    if not tried:
        return probes, ratio
    asked = np.array([r["v"] for r in tried], np.float64)
    found = once.select("h1", "h2", "v").mapInArrow(_exact(asked, [(r["h1"], r["h2"]) for r in tried], k), "query int, score double, h1 long, h2 long, v array<double>")
    place = Window.partitionBy("query").orderBy("score", "h1", "h2")
    true = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k).select("query", "v").toPandas()
    if not len(true):
        return probes, ratio
    rows, lists = lists_of(np.array(true["v"].tolist(), np.float64), centres, COPIES, COPY_RATIO)
    query, graph = true["query"].to_numpy(), Graph(centres)
    distance = np.concatenate([np.sqrt(_squared(x, centres)) for x in _slices(asked)])
    order = np.argsort(distance, axis=1, kind="stable")

    def recall(ranked) -> float:
        searched = np.zeros((len(asked), len(centres)), bool)
        for i in range(len(asked)):
            searched[i, _searched(*ranked(i), probes, ratio)] = True
        held = np.zeros(len(true), bool)
        held[rows[searched[query[rows], lists]]] = True
        return held.mean()

    # The walk may miss a centroid, so it has the last word.
    while recall(lambda i: (order[i], distance[i, order[i]])) < RECALL or recall(lambda i: graph.nearest(asked[i], max(BEAM, 2 * probes))) < RECALL:
        if probes >= len(centres):
            return len(centres), float("inf")
        probes, ratio = int(np.ceil(probes * MORE_PROBES)), ratio * MORE_RATIO
    return probes, ratio


def _prober(centres, probes: int, ratio: float, beam: int):
    """Lists that each query searches, found by walking the graph."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(centres.value)
        for batch in batches:
            lists, rows = [], []
            for k, v in enumerate(batch.column(2).to_pylist()):
                ids = _searched(*graph.nearest(np.array(v, np.float64), max(beam, 2 * probes)), probes, ratio)
                lists += ids.tolist()
                rows += [k] * len(ids)
            taken = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists, pa.int32()), *[batch.column(i).take(taken) for i in range(3)]], names=["list", "h1", "h2", "v"]
            )

    return probe


def _closest(d: np.ndarray, ids: list, keep: int) -> list[tuple[float, int]]:
    """The ``keep`` nearest ids with their distances; an id of several vectors counts once."""
    wide = min(4 * keep, len(d))
    while True:
        last = np.partition(d, wide - 1)[wide - 1]
        found: dict[int, float] = {}
        for score, x in sorted((d[i], x) for i in np.flatnonzero(d <= last).tolist() for x in ids[i]):
            found.setdefault(x, score)
        if len(found) >= keep or wide == len(d):
            return [(score, x) for x, score in found.items()][:keep]
        wide = len(d)


def _searcher(keep: int):
    def search(key: tuple, postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"h1": [], "h2": [], "vec_id": [], "score": []}
        if len(postings) and len(queries):
            v = np.array(postings["v"].tolist(), np.float64)
            ids = postings["ids"].tolist()
            for h1, h2, q in zip(queries["h1"], queries["h2"], queries["v"]):
                found = _closest(np.sqrt(((v - np.asarray(q, np.float64)) ** 2).sum(1)), ids, keep)
                out["h1"] += [h1] * len(found)
                out["h2"] += [h2] * len(found)
                out["vec_id"] += [int(x) for _, x in found]
                out["score"] += [float(s) for s, _ in found]
        return pd.DataFrame(out).astype({"h1": "int64", "h2": "int64", "vec_id": "int64", "score": "float64"})

    return search


def nearest(
    vectors: DataFrame, k: int = NEAREST, every: int = QUERIES_OF, list_size: int = LIST_SIZE, probes: int = PROBES,
    probe_ratio: float = PROBE_RATIO, block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id ``every`` divides.

    ``probes`` and ``probe_ratio`` are where calibration starts.
    """
    spark = vectors.sparkSession
    rows = staged(usable(vectors))
    once = staged(distinct_vectors(rows, k + 1))
    asked = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")
    ).distinct()
    total = once.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    lists = int(min(max(total // list_size, 1), MOST_LISTS, max(total // SAMPLE_PER_LIST, 1)))
    size = max(SAMPLE, SAMPLE_PER_LIST * lists)
    sample = np.array(smallest_hashes(once, ["h1", "h2"], size, total, F.col("h1")).select("v").toPandas()["v"].tolist(), np.float64)
    fitted = fit_centroids(sample, lists)
    centres = spark.sparkContext.broadcast(fitted)
    posted = staged(once.mapInArrow(_poster(centres, COPIES, COPY_RATIO), "list int, h1 long, h2 long, v array<double>, ids array<long>"))
    wanted = staged(once.join(asked.select("h1", "h2").distinct(), ["h1", "h2"]).select("h1", "h2", "v"))
    probes, probe_ratio = calibrated(once, wanted, fitted, k, probes, probe_ratio)
    probed = staged(wanted.mapInArrow(_prober(centres, probes, probe_ratio, BEAM), "list int, h1 long, h2 long, v array<double>"))
    # At most MOST_LISTS rows, so they may be broadcast.
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n")).join(
        probed.groupBy("list").agg(F.count(F.lit(1)).alias("m")), "list"
    ).select("list", F.ceil(F.col("n") / block).cast("int").alias("parts"), F.ceil(F.col("m") / block).cast("int").alias("turns"))
    sizes = F.broadcast(staged(sizes))
    def numbers(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = posted.join(sizes, "list").select("list", F.pmod("h1", "parts").cast("int").alias("part"), numbers("turns").alias("turn"), "v", "ids")
    right = probed.join(sizes, "list").select("list", F.pmod("h2", "turns").cast("int").alias("turn"), numbers("parts").alias("part"), "h1", "h2", "v")
    group = ["list", "part", "turn"]
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(_searcher(k + 1), "h1 long, h2 long, vec_id long, score double")
    found = met.groupBy("h1", "h2", "vec_id").agg(F.min("score").alias("score"))
    place = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
    best = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1).drop("place")
    answers = asked.join(best, ["h1", "h2"]).where("vec_id != query_id")
    # An id with several vectors asks with each of them; its nearest answers count.
    answers = answers.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return answers.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
