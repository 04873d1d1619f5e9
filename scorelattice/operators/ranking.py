"""Leaderboard ranking over long score rows.

Scores stay long: ``(model_id, benchmark_id, value)``.  A missing cell is an
absent row and its penalty is arithmetic, so the dense model × benchmark grid
is never built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scores import heat_alpha, heat_position, is_finite
from ..session import staged
from .ordering import competition_position, sequential_position

COVERAGE_THRESHOLD = 0.6
TOP_PER_BENCHMARK = 6


def benchmark_ranks(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Scores with ``rank`` per benchmark, best first in the declared direction."""
    directed = scores.where(is_finite(F.col("value"))).join(
        benchmarks.select("benchmark_id", "higher_is_better"), "benchmark_id"
    )
    better_first = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    return competition_position(directed, ["benchmark_id"], [better_first], "rank")


def scored_models(models: DataFrame, scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Models with a score on any of the given benchmarks."""
    seen = scores.join(benchmarks.select("benchmark_id"), "benchmark_id", "left_semi")
    return models.join(seen.select("model_id"), "model_id", "left_semi")


def unscored_models(models: DataFrame, scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    seen = scores.join(benchmarks.select("benchmark_id"), "benchmark_id", "left_semi")
    return models.join(seen.select("model_id"), "model_id", "left_anti")


def coverage_ranking(
    models: DataFrame,
    scores: DataFrame,
    benchmarks: DataFrame,
    threshold: float = COVERAGE_THRESHOLD,
) -> DataFrame:
    """Overall ranking of every model over the whole benchmark cohort.

    Ranks compare the integer rank sum: all models share the cohort size, so
    the order is that of the average rank without floating-point ties.
    """
    # The scores were grouped by (model, benchmark); ranks need the models too,
    # so scores of models outside the list are dropped before ranking.
    own = scores.join(models.select("model_id"), "model_id", "left_semi")
    return overall_places(models, rank_shares(benchmark_ranks(own, benchmarks)), benchmarks, threshold)


def rank_shares(ranks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """What each model's ranks add to the overall ranking, by further keys if given; such rows add up."""
    return ranks.groupBy(*keys, "model_id").agg(
        F.sum("rank").alias("present_sum"),
        F.count(F.lit(1)).alias("covered"),
        F.count_if(F.col("rank") == 1).alias("firsts"),
    )


def overall_places(
    models: DataFrame, per_model: DataFrame, benchmarks: DataFrame, threshold: float = COVERAGE_THRESHOLD
) -> DataFrame:
    """Overall ranking of every model from the added-up shares of the ranked ones."""
    total = benchmarks.agg(F.count(F.lit(1)).alias("n")).scalar()
    penalty = models.agg((F.count(F.lit(1)) + 1).alias("n")).scalar()
    rows = models.join(per_model, "model_id", "left").select(
        *models.columns,
        F.coalesce("covered", F.lit(0)).alias("covered"),
        F.coalesce("firsts", F.lit(0)).alias("firsts"),
        F.coalesce("present_sum", F.lit(0)).alias("present_sum"),
        total.alias("total"),
        penalty.alias("_penalty"),
    )
    rows = rows.select(
        *models.columns,
        "covered",
        "firsts",
        "total",
        (F.col("present_sum") + (F.col("total") - F.col("covered")) * F.col("_penalty")).alias(
            "rank_sum"
        ),
    ).withColumn(
        "unranked_reason",
        F.when(F.col("total") == 0, "no_benchmarks").when(
            F.col("covered") / F.col("total") < threshold, "incomplete_coverage"
        ),
    )
    # One small row per model from here on: stored once, so that placing the
    # models does not repeat the ranking of every benchmark.
    rows = staged(rows)
    # Models below the threshold go to the end of one shared ordering, so they
    # take no place from the ranked ones and their position is blanked after.
    late = F.when(F.col("unranked_reason").isNull(), 0).otherwise(1)
    keys = [late, F.col("rank_sum"), -F.col("firsts")]
    placed = competition_position(rows, [], keys, "_place")
    has_total = F.col("total") > 0
    return placed.select(
        *models.columns,
        F.when(F.col("unranked_reason").isNull(), F.col("_place")).alias("rank"),
        F.when(has_total, F.col("rank_sum") / F.col("total")).alias("avg_rank"),
        "firsts",
        F.when(has_total, F.col("covered") / F.col("total")).otherwise(0.0).alias("coverage"),
        "covered",
        "total",
        "unranked_reason",
    )


def leaderboard_order(ranking: DataFrame) -> DataFrame:
    """Ranked models first, the rest by coverage; names and ids settle ties."""
    return ranking.orderBy(
        F.asc_nulls_last("rank"), F.desc("covered"), F.asc("name"), F.asc("model_id")
    )


def column_order(
    models: DataFrame, scores: DataFrame, benchmark_id: str, descending: bool = True
) -> DataFrame:
    """Models by one benchmark's value, models without a value last either way."""
    column = scores.where(F.col("benchmark_id") == benchmark_id).select("model_id", "value")
    value = F.desc_nulls_last("value") if descending else F.asc_nulls_last("value")
    return models.join(column, "model_id", "left").orderBy(value, "name", "model_id")


def ordered_places(ordered: DataFrame, keys: list[Column], name: str = "place") -> DataFrame:
    """The places of a total order as a column, for results that travel unsorted."""
    return sequential_position(ordered, [], keys, name)


def top_per_benchmark(
    ranks: DataFrame, models: DataFrame, limit: int = TOP_PER_BENCHMARK
) -> DataFrame:
    """Best few models per benchmark.

    Spark cuts each task's rows to the limit before the shuffle (window group
    limit), so a benchmark holding most scores does not fill one task.
    """
    named = ranks.join(models.select("model_id", "name"), "model_id")
    w = W.partitionBy("benchmark_id").orderBy("_better", "name", "model_id")
    better = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    return (
        named.withColumn("_better", better)
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= limit)
        .drop("_better")
    )


def column_stats(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """min, max, best, worst, average and count per benchmark, absent ones kept."""
    stats = scores.groupBy("benchmark_id").agg(
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(F.col("value").cast("decimal(20,6)")).alias("_sum"),
        F.count("value").alias("count"),
    )
    up = F.col("higher_is_better")
    return benchmarks.join(stats, "benchmark_id", "left").select(
        "benchmark_id",
        "min",
        "max",
        F.when(up, F.col("max")).otherwise(F.col("min")).alias("best"),
        F.when(up, F.col("min")).otherwise(F.col("max")).alias("worst"),
        (F.col("_sum").cast("double") / F.col("count")).alias("avg"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def best_models(scores: DataFrame, benchmarks: DataFrame, models: DataFrame) -> DataFrame:
    """The first model by name among those holding each benchmark's best value."""
    directed = scores.join(
        benchmarks.select("benchmark_id", "higher_is_better"), "benchmark_id"
    ).join(models.select("model_id", "name"), "model_id")
    better = F.when(F.col("higher_is_better"), -F.col("value")).otherwise(F.col("value"))
    key = F.struct(better.alias("v"), F.col("name"), F.col("model_id"))
    return directed.groupBy("benchmark_id").agg(
        F.min_by("model_id", key).alias("model_id"), F.min_by("value", key).alias("value")
    )


def leads_per_model(best: DataFrame) -> DataFrame:
    return best.groupBy("model_id").agg(F.count(F.lit(1)).alias("leads"))


def heat_cells(scores: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Each cell's place between its column's extremes, opacity and best flag.

    Extremes come from a grouped aggregate and a join: partial aggregation
    keeps a large benchmark from gathering in one window task.
    """
    stats = column_stats(scores, benchmarks).select("benchmark_id", "min", "max", "best")
    t = heat_position(F.col("value"), F.col("min"), F.col("max"), F.col("higher_is_better"))
    return (
        scores.join(benchmarks.select("benchmark_id", "higher_is_better"), "benchmark_id")
        .join(stats, "benchmark_id")
        .withColumn("t", t)
        .withColumn("alpha", heat_alpha(F.col("t")))
        .withColumn("is_best", F.col("value") == F.col("best"))
        .select("model_id", "benchmark_id", "value", "t", "alpha", "is_best")
    )
