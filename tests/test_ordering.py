"""Positions against brute force, in one range and in many."""

import random

import pytest
from pyspark.sql import functions as F

from scorelattice.operators.ordering import competition_position, sequential_position


def data(seed):
    rng = random.Random(seed)
    # One group holds most rows and one value a third of them.
    return [
        ("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", 5 if rng.random() < 0.33 else rng.randrange(200), i)
        for i in range(3000)
    ]


@pytest.mark.parametrize("parts", [None, 1, 40])
def test_sequential_position(spark, parts):
    items = data(1)
    df = spark.createDataFrame(items, "g string, v long, i long").repartition(7)
    got = sequential_position(df, ["g"], [-F.col("v"), F.col("i")], "p", parts)
    want = {}
    for g in {x[0] for x in items}:
        for p, x in enumerate(sorted((x for x in items if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[x[2]] = p
    assert {r.i: r.p for r in got.collect()} == want


@pytest.mark.parametrize("parts", [None, 1, 25])
def test_competition_position(spark, parts):
    items = data(2)
    df = spark.createDataFrame(items, "g string, v long, i long").repartition(5)
    got = competition_position(df, ["g"], [-F.col("v")], "p", parts)
    want = {x[2]: 1 + sum(y[0] == x[0] and y[1] > x[1] for y in items) for x in items}
    assert {r.i: r.p for r in got.collect()} == want


def test_whole_table_position(spark):
    df = spark.createDataFrame([(3,), (1,), (2,)], "v long")
    got = sequential_position(df, [], [F.col("v")], "p", 3)
    assert {(r.v, r.p) for r in got.collect()} == {(1, 1), (2, 2), (3, 3)}


def test_empty_input(spark):
    df = spark.createDataFrame([], "g string, v long")
    assert competition_position(df, ["g"], [F.col("v")], "p").count() == 0


def test_null_groups_and_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, None), ("a", 1), (None, 3)], "g string, v long")
    got = sequential_position(df, ["g"], [F.col("v")], "p", 3)
    assert {(r.g, r.v, r.p) for r in got.collect()} == {(None, None, 1), (None, 2, 2), (None, 3, 3), ("a", 1, 1)}


def test_a_hot_group_is_spread_over_ranges(spark):
    from scorelattice.operators.ordering import _ranged

    df = spark.range(2000).select(F.lit("x").alias("g"), F.struct(F.col("id")).alias("_k"))
    assert _ranged(df, ["g"], 12).select("_part").distinct().count() > 5


def test_null_groups_are_a_group(spark):
    df = spark.createDataFrame([(None, 3.0), (None, 3.0), ("a", 1.0), (None, 5.0)], "g string, v double")
    for parts in (1, 4):
        got = competition_position(df, ["g"], [F.col("v")], "rank", parts).collect()
        assert sorted(((r["g"], r["v"], r["rank"]) for r in got), key=repr) == [("a", 1.0, 1), (None, 3.0, 1), (None, 3.0, 1), (None, 5.0, 3)]
