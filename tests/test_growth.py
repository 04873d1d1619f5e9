"""Plans that must not grow in one task or in the driver."""

from scorelattice.operators import feed as E, ops as O
from scorelattice.plans import operations as P


def test_feed_issues_without_broadcast(spark):
    scores = spark.createDataFrame(
        [(1, "a", "x", 1, 10), (1, "a", "x", 1, 10), (2, "b", "y", 1, 11), (3, None, "x", 2, None)],
        "claim_id long, model_id string, benchmark_id string, source_id long, snapshot_id long",
    )
    models = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "model_id string")
    benchmarks = spark.createDataFrame([("x",)], "benchmark_id string")
    manifest = spark.createDataFrame([(1, 10), (2, None)], "source_id long, snapshot_id long")
    excluded = spark.createDataFrame([(2,), (9,)], "claim_id long")
    issues = E.feed_issues(scores, models, benchmarks, manifest, excluded)
    assert {r["code"]: r["n"] for r in issues.collect()} == {
        "MODEL_ID_REPEATED": 1, "BENCHMARK_ID_REPEATED": 0, "SCORE_MODEL_MISSING": 2, "SCORE_BENCHMARK_MISSING": 1,
        "MODEL_UNREFERENCED": 2, "BENCHMARK_UNREFERENCED": 0, "SCORE_PROVENANCE_MISSING": 2, "MANIFEST_UNREFERENCED": 1,
        "CLAIM_REPEATED": 1, "PAIR_REPEATED": 1, "CLAIM_SELECTED_AND_EXCLUDED": 1,
    }
    plan = issues._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan


def test_jobs_are_planned_and_told_apart_in_parts(spark, monkeypatch, rows):
    folder = "/root/testdata/sf0.001"
    assert P.plan(spark, folder).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    jobs = spark.createDataFrame([("c", "j"), ("c", "j"), ("c", "k"), ("d", "j")], "cycle_id string, job_id string")
    whole = rows(O.cycle_sentinels(jobs))
    assert sorted((r[0], r[1], r[3]) for r in whole) == [("c", 3, 1), ("d", 1, 0)]
    monkeypatch.setattr(O, "JOBS_PER_TASK", 2)
    assert rows(O.cycle_sentinels(jobs)) == whole


def test_rowset_digests_add_up_whole_numbers(spark):
    """No row is turned into a decimal, and the sums are those of any exact arithmetic."""
    import hashlib

    from pyspark.sql import functions as F
    from scorelattice.operators.audit import multiset_digest

    rows = spark.range(0, 3000, 1, 5).select((F.col("id") % 2).alias("g"), F.col("id").cast("string").alias("line"))
    out = multiset_digest(rows, ["g"], F.col("line"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "partial_sum" in plan and all("decimal" not in line for line in plan.splitlines() if "partial_sum" in line)
    for row in out.collect():
        hashed = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(row["g"], 3000, 2)]
        sums = [sum(int(h[15 * i : 15 * i + 15], 16) for h in hashed) for i in range(4)]
        assert row["digest"] == hashlib.sha256(":".join(map(str, [1500, *sums])).encode()).hexdigest()
    assert multiset_digest(rows.where("g > 5"), [], F.col("line")).first()["digest"] == hashlib.sha256(b"0:0:0:0:0").hexdigest()
