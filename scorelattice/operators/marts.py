"""Tables shaped for charts: pivots, profiles, spreads and flow links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.scores import half_up
from ..session import staged
from .categories import benchmark_field_average, category_means, normalised
from .ordering import sequential_position


def _slots(chosen: Sequence[str]) -> DataFrame:
    return F.create_map(*[x for i, m in enumerate(chosen) for x in (F.lit(m), F.lit(f"s{i}"))])


def category_pivot(scores: DataFrame, benchmarks: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """One row per category, one ``sN`` column per chosen model."""
    slots = [f"s{i}" for i in range(len(chosen))]
    radar = category_means(scores.where(F.col("model_id").isin(*chosen)), benchmarks)
    cells = radar.select(
        "category",
        _slots(chosen)[F.col("model_id")].alias("slot"),
        half_up(F.col("radar_value") * 100, 1).alias("pct"),
    )
    wide = cells.groupBy("category").pivot("slot", slots).agg(F.max("pct"))
    return benchmarks.select("category").distinct().join(wide, "category", "left")


def benchmark_pivot(scores: DataFrame, benchmarks: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """One row per benchmark that any chosen model has a percentage for."""
    slots = [f"s{i}" for i in range(len(chosen))]
    cells = normalised(scores.where(F.col("model_id").isin(*chosen)), benchmarks)
    return (
        cells.withColumn("slot", _slots(chosen)[F.col("model_id")])
        .groupBy("benchmark_id", "category")
        .pivot("slot", slots)
        .agg(F.max("pct"))
        .where(F.coalesce(*slots).isNotNull())
    )


def model_profile(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Each model's percentage next to the field average of the benchmark."""
    field = benchmark_field_average(scores, benchmarks).select("benchmark_id", "field_pct")
    cells = normalised(scores, benchmarks).select("model_id", "benchmark_id", "pct")
    return cells.join(field, "benchmark_id").where(
        F.col("pct").isNotNull() | F.col("field_pct").isNotNull()
    )


def benchmark_spread(scores: DataFrame, benchmarks: DataFrame, models: DataFrame) -> DataFrame:
    """Percentages of each benchmark in falling order with a running number."""
    cells = (
        normalised(scores, benchmarks)
        .where(F.col("pct").isNotNull())
        .join(models.select("model_id", "name"), "model_id")
        .select("benchmark_id", "model_id", "name", "pct")
    )
    return sequential_position(
        cells, ["benchmark_id"], [-F.col("pct"), F.col("name"), F.col("model_id")], "spread_rank"
    )


def flow_nodes(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Nodes of the category-to-benchmark flow, numbered categories first.

    Only benchmarks with a percentage count.  A benchmark named like a category
    gets a ``·`` suffix.  The benchmark registry bounds the size, not the scores.
    """
    used = (
        normalised(scores, benchmarks)
        .where(F.col("pct").isNotNull())
        .groupBy("benchmark_id", "category")
        .agg(F.max("pct").alias("top_pct"))
        .join(benchmarks.select("benchmark_id", "benchmark_name"), "benchmark_id")
    )
    labels = used.select("category").distinct()
    clash = labels.select(F.col("category").alias("benchmark_name"), F.lit(True).alias("clash"))
    named = used.join(clash, "benchmark_name", "left").select(
        F.lit(1).alias("tier"),
        F.when(F.col("clash"), F.concat("benchmark_name", F.lit(" ·")))
        .otherwise(F.col("benchmark_name"))
        .alias("label"),
        "benchmark_id",
        "category",
        "top_pct",
    )
    heads = labels.select(
        F.lit(0).alias("tier"),
        F.col("category").alias("label"),
        F.lit(None).cast("string").alias("benchmark_id"),
        "category",
        F.lit(None).cast("double").alias("top_pct"),
    )
    nodes = staged(heads.unionByName(named))
    keys = [F.col("tier"), F.coalesce("benchmark_id", F.lit("")), F.col("category")]
    return sequential_position(nodes, [], keys, "_n").withColumn(
        "node_id", F.col("_n") - 1
    ).drop("_n")


def flow_links(nodes: DataFrame) -> DataFrame:
    """Links from category node to benchmark node, as wide as the best percentage."""
    heads = nodes.where(F.col("tier") == 0).select(
        "category", F.col("node_id").alias("source")
    )
    return (
        nodes.where(F.col("tier") == 1)
        .join(heads, "category")
        .select(
            "source",
            F.col("node_id").alias("target"),
            F.greatest("top_pct", F.lit(1.0)).alias("link_value"),
        )
    )


def column_groups(benchmarks: DataFrame) -> DataFrame:
    """Benchmarks of each category in id order, with their count.

    The list is as long as the registry's category, which is catalogue data.
    """
    return benchmarks.groupBy("category").agg(
        F.array_join(F.array_sort(F.collect_list("benchmark_id")), ",").alias("columns"),
        F.count(F.lit(1)).alias("n"),
    )
