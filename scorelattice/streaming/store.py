"""Tables that streams keep up to date, in parts by the hash of a key.

A micro-batch opens only the parts that it can touch, and of these only what it
needs, so its work grows with the batch and with these parts but not with the
number of batches before it.  Every batch writes folders of its own number, so a
batch that is run again replaces its own output and sees none of it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Parts of a store, and bits and probes for each key of a Bloom filter (one false answer in a million).
PARTS, BITS_PER_KEY, PROBES = 64, 32, 12

Seen = Callable[[int, list[str]], None]


def stored(spark: SparkSession, *paths: str) -> DataFrame | None:
    """What is stored under the paths, or None where nothing is."""
    try:
        return spark.read.parquet(*paths) if paths else None
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, one row for a key."""
    mixed = hashes.view(np.uint64)[:, None] + np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def bloom_filter(hashes: np.ndarray) -> bytes:
    size = max(64, (BITS_PER_KEY * len(hashes) + 7) // 8 * 8)
    bits = np.zeros(size, bool)
    bits[_places(hashes, size).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> bool:
    """Whether the filter may have been made with any of the keys; never a wrong no."""
    if not len(hashes):
        return False
    packed = np.frombuffer(bits, np.uint8)
    at = _places(hashes, 8 * len(packed))
    return bool(((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1).any())


def _make_filter(keys: tuple, rows: pa.Table) -> pa.Table:
    return pa.table({"part": pa.array([keys[0].as_py()], pa.int32()), "bits": pa.array([bloom_filter(rows.column("hash").to_numpy())], pa.binary())})


def _probe(keys: tuple, arrived: pa.Table, filters: pa.Table) -> pa.Table:
    hashes = arrived.column("hash").to_numpy()
    hits = [b for b, bits in zip(filters.column("batch").to_pylist(), filters.column("bits").to_pylist()) if may_hold(bits, hashes)]
    return pa.table({"part": pa.array([keys[0].as_py()] * len(hits), pa.int32()), "batch": pa.array(hits, pa.int64())})


def add_new(batch: DataFrame, number: int, keys: Sequence[str], out: str, parts: int = PARTS, opened: Seen | None = None) -> None:
    """Append the rows of a batch whose key was never stored.

    Rows lie under ``out``/rows by batch and part, and a Bloom filter of the keys of
    each such folder under ``out``/filters.  Only folders whose filter may hold a
    key of the batch are read.  ``opened`` is told which these are.
    """
    spark = batch.sparkSession
    landed_at, rows_at, filters_at = (f"{out}/{name}" for name in ("landed", "rows", "filters"))
    hashed = batch.dropDuplicates(list(keys)).withColumn("hash", F.xxhash64(*keys))
    dealt = hashed.withColumn("part", F.pmod("hash", F.lit(parts)).cast("int"))
    dealt.write.mode("overwrite").parquet(f"{landed_at}/batch={number}")
    landed = spark.read.schema(dealt.schema).parquet(f"{landed_at}/batch={number}")
    filters = stored(spark, filters_at)
    hits: list[tuple[int, int]] = []
    if filters is not None:
        # A batch that runs again must not meet its own earlier output.
        earlier = filters.where(F.col("batch") < number).select("part", F.col("batch").cast("long").alias("batch"), "bits")
        probed = landed.select("part", "hash").groupBy("part").cogroup(earlier.groupBy("part")).applyInArrow(_probe, "part int, batch long")
        hits = sorted((r["batch"], r["part"]) for r in probed.collect())  # at most a row for each stored folder
    paths = [f"{rows_at}/batch={b}/part={p}" for b, p in hits]
    if opened:
        opened(number, paths)
    fresh = landed
    if paths:
        known = spark.read.parquet(*paths).select(*[F.col(k).alias(f"_known_{i}") for i, k in enumerate(keys)])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_known_{i}"))
        fresh = landed.join(known, same, "left_anti")
    fresh.write.partitionBy("part").mode("overwrite").parquet(f"{rows_at}/batch={number}")
    written = spark.read.schema(landed.schema).parquet(f"{rows_at}/batch={number}")
    made = written.select("part", "hash").groupBy("part").applyInArrow(_make_filter, "part int, bits binary")
    made.write.mode("overwrite").parquet(f"{filters_at}/batch={number}")


def kept_rows(spark: SparkSession, out: str) -> DataFrame:
    """All rows that ``add_new`` has stored."""
    return spark.read.parquet(f"{out}/rows").drop("hash", "part", "batch")


class Versions:
    """Which batch wrote each part last, as a small table for each batch.

    A part that a batch changes is written whole by that batch; the others stay as
    they are.
    """

    def __init__(self, spark: SparkSession, out: str, before: int | None = None) -> None:
        """The versions as of the last batch before ``before``, or the last one at all."""
        self.spark, self.out = spark, out
        self.of: dict[int, int] = {}
        if before == 0:
            return
        rows = stored(spark, f"{out}/versions/batch={before - 1}") if before is not None else None
        if rows is None and (every := stored(spark, f"{out}/versions")) is not None:
            known = every if before is None else every.where(F.col("batch") < before)
            last = known.agg(F.max("batch")).first()[0]
            rows = None if last is None else known.where(F.col("batch") == last)
        if rows is not None:
            self.of = {r["part"]: r["version"] for r in rows.select("part", "version").collect()}

    def paths(self, name: str, parts: Sequence[int] | None = None) -> list[str]:
        wanted = self.of if parts is None else [p for p in parts if p in self.of]
        return [f"{self.out}/{name}/batch={self.of[p]}/part={p}" for p in sorted(wanted)]

    def write(self, number: int, parts: Sequence[int]) -> None:
        rows = list((self.of | dict.fromkeys(parts, number)).items())
        made = self.spark.createDataFrame(rows, "part int, version long")
        made.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/versions/batch={number}")
