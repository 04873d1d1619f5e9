"""Positions within groups of any size.

A plain ranking window puts a whole group into one task.  Here rows are
range-partitioned once by group and key, sorted, and stored with the number of
their range.  Each range numbers its own part of a group and adds the size of
the parts before it; only these sizes, one per group and range, are ordered.  A
group with most of all rows is spread over as many ranges as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import staged

# Stand-in group of positions over a whole table.
_WHOLE = "_all"


def _ranged(keyed: DataFrame, groups: Sequence[str], parts: int | None) -> DataFrame:
    """Rows stored range by range of (group, ``_k``), with the range's number ``_part``."""
    order = [*groups, "_k"]
    ranged = keyed.repartitionByRange(parts, *order) if parts else keyed.repartitionByRange(*order)
    return staged(ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))


def _with_before(ranged: DataFrame, groups: Sequence[str], weight: Column) -> DataFrame:
    """Add ``_before``, the weight of the group's rows in earlier ranges."""
    sizes = ranged.groupBy(*groups, "_part").agg(F.sum(weight).alias("_n"))
    earlier = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select(*groups, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # Groups may be null, so they are compared null-safely.
    named = before.toDF(*[f"_g{i}" for i in range(len(groups))], "_p", "_before")
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranged.join(named, same).drop("_p", *[f"_g{i}" for i in range(len(groups))])


def _keyed(df: DataFrame, groups: Sequence[str], keys: Sequence[Column]) -> tuple[DataFrame, list[str]]:
    own = list(groups) or [_WHOLE]
    base = df if groups else df.withColumn(_WHOLE, F.lit(1))
    return base.withColumn("_k", F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)])), own


def sequential_position(
    df: DataFrame, groups: Sequence[str], keys: Sequence[Column], position: str, parts: int | None = None
) -> DataFrame:
    """Number rows 1..n within each group by ``keys`` ascending.

    ``keys`` must tell rows apart; negate numbers for descending order.  Nulls
    come first.  ``parts`` sets the number of ranges.
    """
    keyed, own = _keyed(df, groups, keys)
    placed = _with_before(_ranged(keyed, own, parts), own, F.lit(1))
    local = W.partitionBy(*own, "_part").orderBy("_k")
    return placed.withColumn(position, (F.row_number().over(local) + F.col("_before")).cast("long")).select(
        *df.columns, position
    )


def competition_position(
    df: DataFrame, groups: Sequence[str], keys: Sequence[Column], position: str, parts: int | None = None
) -> DataFrame:
    """Rank with shared places (1, 1, 3) by ``keys`` ascending; keys not null.

    Equal keys are counted before anything is ordered, so a value that a third
    of the rows share is one row in the ordering step.
    """
    keyed, own = _keyed(df, groups, keys)
    values = keyed.groupBy(*own, "_k").agg(F.count(F.lit(1)).alias("_c"))
    placed = _with_before(_ranged(values, own, parts), own, F.col("_c"))
    earlier = W.partitionBy(*own, "_part").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    ranked = placed.select(
        *own,
        "_k",
        (F.coalesce(F.sum("_c").over(earlier), F.lit(0)) + F.col("_before") + 1).cast("long").alias(position),
    )
    # Groups may be null, keys may not.
    named = ranked.toDF(*[f"_g{i}" for i in range(len(own))], "_rank_k", position)
    same = F.col("_k") == F.col("_rank_k")
    for i, g in enumerate(own):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return keyed.join(named, same).select(*df.columns, position)
