"""Category averages, leaders and gauges over presentation values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scores import half_up, percent, presentation_value, raw_only

_DIMS = ("category", "higher_is_better", "scale_max", "norm_kind", "norm_min", "norm_max")


def normalised(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Scores with ``unit`` (0..1, larger is better, may be null) and ``pct``."""
    unit = presentation_value(
        F.col("value"), *[F.col(c) for c in _DIMS[1:]]
    )
    return (
        scores.join(benchmarks.select("benchmark_id", *_DIMS), "benchmark_id")
        .withColumn("unit", unit)
        .withColumn("pct", percent(F.col("unit")))
    )


def exact_mean(value: Column) -> Column:
    """Mean that does not depend on the order of addition (12 decimals kept)."""
    return F.sum(value.cast("decimal(28,12)")).cast("double") / F.count(value)


def category_list(benchmarks: DataFrame) -> DataFrame:
    return benchmarks.select("category").distinct()


def category_radar(
    models: DataFrame, scores: DataFrame, benchmarks: DataFrame, categories: Sequence[str]
) -> DataFrame:
    """Mean presentation value of every model in every category, null where none counts."""
    axes = models.select(
        "model_id", F.explode(F.array(*[F.lit(c) for c in categories])).alias("category")
    )
    return axes.join(category_means(scores, benchmarks), ["model_id", "category"], "left")


def category_means(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean presentation value per (model, category) that has any score."""
    return (
        normalised(scores, benchmarks)
        .groupBy("model_id", "category")
        .agg(exact_mean(F.col("unit")).alias("radar_value"))
    )


def covered_category_averages(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Averages of models that have every normalisable benchmark of a category."""
    usable = benchmarks.where(~raw_only(F.col("norm_kind")))
    totals = usable.groupBy("category").agg(F.count(F.lit(1)).alias("total"))
    return (
        normalised(scores, usable)
        .where(F.col("unit").isNotNull())
        .groupBy("category", "model_id")
        .agg(exact_mean(F.col("unit")).alias("avg"), F.count(F.lit(1)).alias("n"))
        .join(totals, "category")
        .where(F.col("n") == F.col("total"))
    )


def category_leaders(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Best fully covered model per category, with a row even where none is."""
    totals = (
        benchmarks.where(~raw_only(F.col("norm_kind")))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("total"))
    )
    key = F.struct((-F.col("avg")).alias("a"), F.col("model_id"))
    top = (
        covered_category_averages(scores, benchmarks)
        .groupBy("category")
        .agg(
            F.min_by("model_id", key).alias("model_id"),
            F.max("avg").alias("avg"),
            F.min_by("n", key).alias("n"),
        )
    )
    return totals.join(top, "category", "left").select(
        "category", "model_id", "avg", F.coalesce("n", F.lit(0)).alias("n"), "total"
    )


def overall_gauge(models: DataFrame, scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean of rounded cell percentages and share of normalisable benchmarks."""
    per_model = (
        normalised(scores, benchmarks)
        .groupBy("model_id")
        .agg(exact_mean(F.col("pct")).alias("mean_pct"), F.count("pct").alias("present"))
    )
    usable = benchmarks.agg(F.count_if(~raw_only(F.col("norm_kind"))).alias("n")).scalar()
    present = F.coalesce(F.col("present"), F.lit(0))
    return (
        models.select("model_id")
        .join(per_model, "model_id", "left")
        .withColumn("usable", usable)
        .select(
            "model_id",
            half_up(F.col("mean_pct"), 1).alias("pct"),
            F.when(F.col("usable") > 0, half_up(present / F.col("usable") * 100))
            .otherwise(0.0)
            .cast("long")
            .alias("coverage_pct"),
        )
    )


def benchmark_field_average(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Rounded mean of rounded percentages over all models, per benchmark."""
    per_benchmark = (
        normalised(scores, benchmarks)
        .groupBy("benchmark_id")
        .agg(half_up(exact_mean(F.col("pct")), 1).alias("field_pct"))
    )
    return benchmarks.select("benchmark_id", "category").join(
        per_benchmark, "benchmark_id", "left"
    )


def category_field_average(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Mean of the benchmark means in a category, rounded at each stage."""
    return (
        benchmark_field_average(scores, benchmarks)
        .groupBy("category")
        .agg(half_up(exact_mean(F.col("field_pct")), 1).alias("field_pct"))
    )


def catalog_share(benchmarks: DataFrame, categories: DataFrame) -> DataFrame:
    counts = benchmarks.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return categories.join(counts, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("count")
    )
