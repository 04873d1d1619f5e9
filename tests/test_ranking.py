"""Ranking, coverage, normalisation and averages on hand tables."""

import pytest
from pyspark.sql import functions as F

from scorelattice.functions import scores as S
from scorelattice.operators import categories as C, marts as M, ranking as R

BENCH = (
    "benchmark_id string, benchmark_name string, category string, higher_is_better boolean, scale_max double, "
    "norm_kind string, norm_min double, norm_max double"
)


@pytest.fixture(scope="module")
def world(spark):
    models = spark.createDataFrame(
        [("a", "Alpha", "v1"), ("b", "Beta", "v1"), ("c", "Gamma", "v2"), ("d", "Delta", "v2")],
        "model_id string, name string, vendor string",
    )
    benchmarks = spark.createDataFrame(
        [
            ("x", "X", "math", True, 100.0, "bounded", 0.0, 100.0),
            ("y", "Y", "math", False, 100.0, None, None, None),
            ("z", "Z", "chat", True, 100.0, "raw_only", None, None),
        ],
        BENCH,
    )
    scores = spark.createDataFrame(
        [
            ("a", "x", 90.0), ("b", "x", 90.0), ("c", "x", 10.0), ("a", "y", 5.0), ("b", "y", 20.0),
            ("c", "y", 150.0), ("a", "z", 7.0), ("d", "z", float("nan")),
        ],
        "model_id string, benchmark_id string, value double",
    )
    return models, benchmarks, scores


def test_ties_share_a_place_and_direction_counts(world, rows):
    models, benchmarks, scores = world
    got = R.benchmark_ranks(scores, benchmarks).select("benchmark_id", "model_id", "rank")
    assert rows(got) == [
        ("x", "a", 1), ("x", "b", 1), ("x", "c", 3), ("y", "a", 1), ("y", "b", 2), ("y", "c", 3), ("z", "a", 1),
    ]


def test_missing_cells_cost_one_place_below_the_cohort(world):
    models, benchmarks, scores = world
    got = {r.model_id: r for r in R.coverage_ranking(models, scores, benchmarks).collect()}
    # a: 1+1+1; b: 1+2+5 (missing z); c: 3+3+5; d has nothing: 15.
    assert [(m, got[m].rank, got[m].avg_rank) for m in "abc"] == [("a", 1, 1.0), ("b", 2, 8 / 3), ("c", 3, 11 / 3)]
    assert (got["d"].rank, got["d"].unranked_reason, got["d"].covered) == (None, "incomplete_coverage", 0)
    assert (got["a"].firsts, got["b"].coverage) == (3, 2 / 3)


def test_equal_rank_sums_share_a_rank_unless_firsts_differ(spark):
    models = spark.createDataFrame([(m, m) for m in "pqr"], "model_id string, name string")
    benchmarks = spark.createDataFrame([("x", True), ("y", True)], "benchmark_id string, higher_is_better boolean")
    scores = spark.createDataFrame(
        [("p", "x", 3.0), ("q", "x", 2.0), ("r", "x", 1.0), ("p", "y", 1.0), ("q", "y", 2.0), ("r", "y", 3.0)],
        "model_id string, benchmark_id string, value double",
    )
    got = {r.model_id: r.rank for r in R.coverage_ranking(models, scores, benchmarks).collect()}
    assert got == {"p": 1, "r": 1, "q": 3}


def test_no_benchmarks_ranks_nobody(world):
    models, benchmarks, scores = world
    got = R.coverage_ranking(models, scores, benchmarks.where("false")).collect()
    assert {(r.rank, r.avg_rank, r.unranked_reason) for r in got} == {(None, None, "no_benchmarks")}


def test_order_puts_ranked_first(world):
    models, benchmarks, scores = world
    ranking = R.coverage_ranking(models, scores, benchmarks)
    assert [r.model_id for r in R.leaderboard_order(ranking).collect()] == ["a", "b", "c", "d"]
    up = R.column_order(models, scores, "y", descending=False).collect()
    assert [r.model_id for r in up] == ["a", "b", "c", "d"]


def test_presentation_values(world, rows):
    models, benchmarks, scores = world
    got = C.normalised(scores, benchmarks).select("model_id", "benchmark_id", "unit", "pct")
    assert rows(got) == sorted(
        [
            ("a", "x", 0.9, 90.0), ("b", "x", 0.9, 90.0), ("c", "x", 0.1, 10.0), ("a", "y", 0.95, 95.0),
            ("b", "y", 0.8, 80.0), ("c", "y", None, None), ("a", "z", None, None), ("d", "z", None, None),
        ],
        key=repr,
    )


def test_leaders_need_every_normalisable_benchmark(world, rows):
    models, benchmarks, scores = world
    got = C.category_leaders(scores, benchmarks).select("category", "model_id", "n", "total")
    assert rows(got) == [("math", "a", 2, 2)]
    none = C.category_leaders(scores.where("model_id = 'c'"), benchmarks)
    assert rows(none.select("model_id", "avg", "n", "total")) == [(None, None, 0, 2)]


def test_radar_keeps_categories_without_a_value(world):
    models, benchmarks, scores = world
    got = {
        (r.model_id, r.category): r.radar_value
        for r in C.category_radar(models, scores, benchmarks, ["math", "chat"]).collect()
    }
    assert got[("a", "math")] == pytest.approx(0.925) and got[("a", "chat")] is None
    assert len(got) == 8 and got[("d", "math")] is None


def test_gauge_and_field_average(world, rows):
    models, benchmarks, scores = world
    gauge = {r.model_id: (r.pct, r.coverage_pct) for r in C.overall_gauge(models, scores, benchmarks).collect()}
    assert gauge == {"a": (92.5, 100), "b": (85.0, 100), "c": (10.0, 50), "d": (None, 0)}
    assert rows(C.category_field_average(scores, benchmarks)) == [("chat", None), ("math", 75.4)]


def test_stats_heat_and_best(world):
    models, benchmarks, scores = world
    y = {r.benchmark_id: r for r in R.column_stats(scores.where("not isnan(value)"), benchmarks).collect()}["y"]
    assert (y.min, y.max, y.best, y.worst, y["count"]) == (5.0, 150.0, 5.0, 150.0, 3)
    heat = {(r.model_id, r.benchmark_id): r for r in R.heat_cells(scores.where("not isnan(value)"), benchmarks).collect()}
    assert heat[("a", "y")].t == 1.0 and heat[("a", "y")].is_best and heat[("a", "z")].t is None
    best = {r.benchmark_id: r.model_id for r in R.best_models(scores.where("not isnan(value)"), benchmarks, models).collect()}
    assert best == {"x": "a", "y": "a", "z": "a"}


def test_flow_names_and_links(spark, world):
    models, benchmarks, scores = world
    clash = benchmarks.withColumn("benchmark_name", F.when(F.col("benchmark_id") == "x", "math").otherwise("Y"))
    nodes = M.flow_nodes(scores, clash)
    assert {(r.node_id, r.label) for r in nodes.collect()} == {(0, "math"), (1, "math ·"), (2, "Y")}
    assert {tuple(r) for r in M.flow_links(nodes).collect()} == {(0, 1, 90.0), (0, 2, 95.0)}


def test_rounding_and_formats(spark):
    df = spark.createDataFrame([(0.25, 2.5), (-0.25, -2.5), (None, None)], "a double, b double")
    got = [tuple(r) for r in df.select(
        S.half_up(F.col("a"), 1), S.half_up(F.col("b")), S.format_score(F.col("b"), F.lit(10.0)), S.format_score(F.col("b"), F.lit(100.0))
    ).collect()]
    assert got == [(0.3, 3.0, "2.5", "3"), (-0.2, -2.0, "-2.5", "-2"), (None, None, "—", "—")]
