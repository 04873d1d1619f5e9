"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Stands for a null id while rows are compared: smaller than any other id.
NO_ID = -(2**63)
#: Rows that carry many entries of a block to a bucket, and back.
PACKED = "block long, bucket int, data binary"
#: So many buckets, or so many for each shuffle partition if that is more.
BUCKETS, BUCKETS_PER_PARTITION = 1024, 8


_prepared: set[str] = set()


def prepared(spark: SparkSession) -> SparkSession:
    """Run-time settings, once per application; Arrow batches are bounded by rows and by bytes."""
    configure(spark)
    if spark.sparkContext.applicationId in _prepared:
        return spark
    _prepared.add(spark.sparkContext.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text as it is; null is the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return stem if stem.lower() not in taken else f"{stem}_{uuid.uuid4().hex[:8]}"


def ids_and_texts(batch: pa.RecordBatch) -> tuple[pa.Array, list[str]]:
    return batch.column(0), batch.column(1).to_pylist()


def ids_and_bytes(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes]]:
    """Texts as UTF-8, without a detour over str."""
    return batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: of the empty text)."""
    text = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def smallest_hashes(df: DataFrame, keys: list[str], bound: int, total: int, hashed: Column | None = None) -> DataFrame:
    """The ``bound`` rows with the smallest hash of ``keys``; ``total`` is about how many rows there are.

    Only rows below a threshold that leaves a fifth more than are wanted are sorted
    at all, so what one task receives does not grow with the partitions.
    """
    key = fresh(df, "_hash")
    named = df.withColumn(key, F.xxhash64(*keys) if hashed is None else hashed)
    share = (1.2 * bound + 1000) / max(total, 1)
    if share < 1:
        named = named.where(F.col(key) < F.lit(int(-(2**63) + share * 2**64)))
    return named.orderBy(key, *keys).limit(bound).drop(key)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, learnable: Column, bound: int
) -> DataFrame:
    """(text, label) of at most ``bound`` labelled rows, the same ones in every run.

    Only label rows are ordered, by a hash of their id; their texts are joined
    afterwards, with at most ``bound`` ids broadcast.  Rows that ``learnable`` refuses are never looked at.  Labels
    that are null, or not 0 or 1, and ids with two labels teach nothing.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & learnable)
        .groupBy("doc_id")
        .agg(F.min(target).alias("label"), F.max(target).alias("other"))
        .where("label = other")
        .select(F.col("doc_id").cast("long").alias("id"), "label")
    )
    picked = smallest_hashes(known, ["id"], bound, labels.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    return texts.join(F.broadcast(picked), "id").select("id", "text", "label")


def squeeze(parts: list) -> bytes:
    """Arrays or bytes as one compressed value, their sizes in front."""
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    head = np.array([len(raw), *map(len, raw)], "<i8").tobytes()
    return head + pa.compress(b"".join(raw), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, kinds: tuple) -> list:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    raw = pa.decompress(data[8 * (n + 1) :], int(sizes.sum()), codec="zstd", asbytes=True)
    ends = np.cumsum(sizes)
    parts = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist())]
    return [p if kind is bytes else np.frombuffer(p, kind) for p, kind in zip(parts, kinds)]


def packed_rows(block: int, buckets: list[int], data: list[bytes]) -> pa.RecordBatch:
    """Rows of a block that belong to the given buckets."""
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * len(data), pa.int64()), pa.array(buckets, pa.int32()), pa.array(data, pa.binary())],
        names=["block", "bucket", "data"],
    )


def bucket_count(spark: SparkSession) -> int:
    return max(BUCKETS, BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
