"""SimHash near-duplicates by pivot distance tables (operator 8).

Every distinct fingerprint gets a row of Hamming distances to fixed reference
fingerprints, kept block by block (the distance to a reference is the sum over
the four 16-bit blocks; a block's share is half the difference between the
distances to the reference and to the reference with that block inverted).

Two fingerprints that differ in at most two bits agree on at least two blocks,
so on these all their table entries are equal: pairs are only formed between
rows with equal entries on one of the six pairs of blocks.  Of those, a pair
whose distances to some reference differ by more than two is discarded (the
triangle inequality); the rest is verified bit by bit.  Only distinct
fingerprints take part; copies share one row.

A bucket of more than ``DENSE`` rows is not paired up.  Its members agree on 32
bits; for each choice of two of the other 32 bits, members that agree on all
remaining bits differ in these two at most, so each is linked to the smallest of
them: as many links as rows, none lost.

Defined results: null text is the empty text (fingerprint zero, linked like any
other); null ids are carried along but name no component unless nothing else is
in it; repeated rows share their fingerprint; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from random import Random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import staged
from .common import fresh, ids_and_bytes, whole_text
from .components import components

WORDS = 3
SEED = 42
MAX_BITS = 2
BLOCK_BITS = 16
BLOCKS = 64 // BLOCK_BITS
#: Pairs of blocks on which two near fingerprints may agree.
PAIRS = tuple(combinations(range(BLOCKS), 2))
#: Reference fingerprints of the distance table.
REFERENCES = tuple(map(Random(8).getrandbits, [64] * 12))
#: Rows of a bucket up to which its pairs are formed.
DENSE = 64
#: Shingles whose bits are added up at a time.
SLICE = 1 << 16


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The 64-bit SimHash of UTF-8 text; zero without words."""
    split = text.lower().split()  # bytes: A-Z only, and blanks [\x20\x09-\x0D]
    if not split:
        return 0
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(split) > words:
        ends, starts = ends[words - 1 :], starts[: 1 - words]
    else:
        ends, starts = ends[-1:], starts[:1]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, SLICE):
        spans = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist())
        hashes = np.array([digest(view[a:b], seed) for a, b in spans], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = ids_and_bytes(batch)
        prints = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints)], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, print): the fingerprint of each row as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(_fingerprints, "doc_id long, print long")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def _mask(block: int) -> int:
    return ((1 << BLOCK_BITS) - 1) << (BLOCK_BITS * block)


def distance_table(prints: DataFrame) -> DataFrame:
    """(print, far, near0..near3): distances to every reference, whole and for each block."""
    mixed = [F.col("print").bitwiseXOR(F.lit(_signed(r))) for r in REFERENCES]
    near = [
        F.array(*[F.bit_count(m.bitwiseAND(F.lit(_signed(_mask(b))))) for m in mixed]).alias(f"near{b}") for b in range(BLOCKS)
    ]
    return prints.select("print", F.array(*[F.bit_count(m) for m in mixed]).alias("far"), *near)


def links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in at most two bits.

    All pairs of sparse buckets; of dense ones, links that join the same rows.
    """
    table = staged(distance_table(prints.select("print").distinct()))
    choices = [
        F.struct(F.lit(p).alias("choice"), F.xxhash64(f"near{i}", f"near{j}").alias("key")) for p, (i, j) in enumerate(PAIRS)
    ]
    keyed = table.select("print", "far", F.explode(F.array(*choices)).alias("k")).select("print", "far", "k.choice", "k.key")
    sizes = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = staged(keyed.join(sizes, ["choice", "key"]))
    sparse = crowded.where(F.col("n") <= dense).drop("n")
    other = sparse.select("choice", "key", F.col("print").alias("b"), F.col("far").alias("far_b"))
    gap = F.array_max(F.zip_with("far", "far_b", lambda x, y: F.abs(x - y)))
    pairs = (
        sparse.withColumnRenamed("print", "a")
        .join(other, ["choice", "key"])
        .where((F.col("a") < F.col("b")) & (gap <= MAX_BITS))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
        .select("a", "b")
    )
    return pairs.unionAll(_dense_links(crowded.where(F.col("n") > dense))).distinct()


def _dense_links(crowded: DataFrame) -> DataFrame:
    """Links of buckets too full for pairs: agree on all bits but two chosen ones."""
    masks = [
        (p, _signed(~((1 << x) | (1 << y)) & (2**64 - 1)))
        for p, chosen in enumerate(PAIRS)
        for x, y in combinations([b for b in range(64) if b // BLOCK_BITS not in chosen], 2)
    ]
    # 6 x 496 rows, whatever the data.
    small = F.broadcast(crowded.sparkSession.createDataFrame(masks, "choice int, mask long"))
    masked = crowded.select("choice", "print").join(small, "choice").select("print", "mask", F.col("print").bitwiseAND(F.col("mask")).alias("rest"))
    least = masked.groupBy("mask", "rest").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return masked.join(least, ["mask", "rest"]).where(F.col("print") > F.col("b")).select(F.col("print").alias("a"), "b")


def near_duplicates(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """Rows (doc_id, print, component_id): the smallest id among all linked documents."""
    printed = staged(fingerprints(docs))
    least = staged(printed.groupBy("print").agg(F.min("doc_id").alias("least")))
    rooted = components(links(least, dense), "a", "b").select(F.col("node").alias("print"), "root")
    grouped = least.join(rooted, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(smallest, "root").select("print", "component_id")
    return printed.join(named, "print").select("doc_id", "print", "component_id")


def hex_print(column: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def one_of_each(docs: DataFrame, dense: int = DENSE) -> DataFrame:
    """``docs`` with only the smallest id of every component.

    Rows that share an id are one document; rows without an id stay.
    """
    gone = fresh(docs, "_gone")
    others = near_duplicates(docs, dense).where("doc_id != component_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(others, docs["doc_id"] == F.col(gone), "left_anti")
