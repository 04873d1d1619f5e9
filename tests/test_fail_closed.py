"""Rules that guard what may pass: an unknown fact refuses."""

import pytest
from pyspark.sql import functions as F

from scorelattice.operators import admission as A, audit as U, feed as H, lineage as L, ops as O

SOURCE = {
    "status": "active", "officialness_level": A.TRUSTED_LEVELS[0], "machine_readable": True, "source_type": "api",
    "parser_name": "own", "source_url": "https://example.org/data.json",
}
SOURCE_TYPES = "status string, officialness_level string, machine_readable boolean, source_type string, parser_name string, source_url string"


def source_reason(spark, **changes):
    row = {**SOURCE, **changes}
    config = F.create_map(*[x for k, v in A.GOVERNANCE.items() for x in (F.lit(f"governance.{k}"), F.lit(v))])
    df = spark.createDataFrame([tuple(row.values())], SOURCE_TYPES).withColumn("parser_config", config)
    return df.select(A.source_eligibility()).first()[0]


def test_a_good_source_passes(spark):
    assert source_reason(spark) is None


@pytest.mark.parametrize("name", ["status", "officialness_level", "machine_readable", "source_type", "parser_name"])
def test_a_source_with_an_unknown_fact_does_not(spark, name):
    assert source_reason(spark, **{name: None}) is not None


def test_encoded_endpoints_are_seen(spark):
    blocked = A.TERMS_BLOCKED[0]
    host, _, path = blocked.partition("/")
    hidden = "".join(f"%{ord(c):02X}" if c == "." else c for c in path)
    assert source_reason(spark, source_url=f"https://{blocked}") == "TERMS_PROHIBIT_ENDPOINT"
    assert source_reason(spark, source_url=f"https://{host}/{hidden}") == "TERMS_PROHIBIT_ENDPOINT"


FETCH = {
    "source_reason": None, "n_bytes": 10, "max_bytes": 100, "http_status": 200, "approved_final_urls": ["u"], "final_url": "u",
    "content_hash": "h", "snapshot_hash": "h", "snapshot_status": 200,
}
FETCH_TYPES = (
    "source_reason string, n_bytes long, max_bytes long, http_status int, approved_final_urls array<string>, final_url string, "
    "content_hash string, snapshot_hash string, snapshot_status int"
)


@pytest.mark.parametrize("name", [None, *[k for k in FETCH if k != "source_reason"]])
def test_fetches(spark, name):
    row = {**FETCH, **({name: None} if name else {})}
    meta = F.create_map(F.lit("verbatim"), F.lit("true"), F.lit("artifact_count"), F.lit("1"))
    echo = F.create_map(F.lit("verbatim"), F.lit("true"), F.lit("artifact_count"), F.lit("1"), F.lit("final_url"), F.lit("u"))
    df = spark.createDataFrame([tuple(row.values())], FETCH_TYPES).withColumns({"metadata": meta, "snapshot_metadata": echo})
    reason = df.select(A.fetch_admission()).first()[0]
    assert (reason is None) == (name is None)


CLAIM = {
    "validations": 1, "not_passed": 0, "review_error": None, "review_id": 1, "review_outcome": "validation_reviewed", "model_id": 1,
    "benchmark_id": 1, "publication_error": None, "publication_id": 1, "publication_outcome": "approved", "published_review_id": 1,
    "score_numeric": 1.0, "model_raw": "m", "benchmark_raw": "b", "score_raw": "1", "capture_method": "c", "locator_type": "l",
    "locator_ok": True, "model_known": True, "benchmark_known": True,
}
CLAIM_TYPES = (
    "validations long, not_passed long, review_error string, review_id long, review_outcome string, model_id long, benchmark_id long, "
    "publication_error string, publication_id long, publication_outcome string, published_review_id long, score_numeric double, "
    "model_raw string, benchmark_raw string, score_raw string, capture_method string, locator_type string, locator_ok boolean, "
    "model_known boolean, benchmark_known boolean"
)


@pytest.mark.parametrize("name", [None, *[k for k in CLAIM if not k.endswith("_error")]])
def test_display(spark, name):
    row = {**CLAIM, **({name: None} if name else {})}
    reason = spark.createDataFrame([tuple(row.values())], CLAIM_TYPES).select(H.display_reason()).first()[0]
    assert (reason is None) == (name is None)


def test_repeated_ordinals_are_told_and_keep_row_counts(spark):
    rows = [("j", 0, 1), ("j", 1, 1), ("j", 2, 2), ("j", 2, 2), ("j", 3, 3)]
    df = spark.createDataFrame(rows, "job_id string, attempt long, token long").selectExpr(
        "*", "CASE WHEN attempt > 1 THEN attempt - 1 END AS prior_token", "attempt AS acquired_at", "'stale_fenced' AS outcome",
        "CAST(NULL AS long) AS retry_at", "CAST(NULL AS long) AS window_end",
    )
    out = sorted((r["attempt"], r["issue"]) for r in O.attempt_issues(df).fillna("-", ["issue"]).collect())
    assert [x for x in out if x[0] == 2] == [(2, "ATTEMPT_REPEATED")] * 2
    assert len(out) == 5 and out[0] == (0, "ATTEMPT_GAP") and out[-1] == (3, "-")


def test_repeated_ids_multiply_nothing(spark):
    rows = spark.createDataFrame([(1, "a", None), (1, "a", None), (2, "a", 1), (3, "a", 2)], "id long, entity string, parent long")
    assert L.with_parent(rows, "parent", "id", ["entity"]).count() == 4
    assert sorted((r["id"], r["depth"]) for r in L.chain_depths(rows).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_digest_tells_all_doubles_apart(spark):
    values = [1e13, 2e13, float("inf"), float("-inf"), float("nan"), 0.0, -0.0, 1e-8, 1.0, -1.0, 5e-324, 1.7e308, 0.1, 0.1 + 2**-56, None]
    out = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(U.real_text(F.col("v"))).collect()]
    assert len(set(out)) == len(values) and out[8] == "+0p4503599627370496" and out[-1] is None


def test_severity_by_family_and_code(spark):
    rows = [("IDENTITY", "MODEL_AMBIGUOUS", "SEV3"), ("DISCOVERY", "DUPLICATE", "SEV3"), ("IDENTITY", "DUPLICATE", "SEV3"), ("FETCH", None, "SEV2")]
    df = spark.createDataFrame([(*r, "taxonomy_default", None) for r in rows], "family string, code string, severity string, basis string, decision string")
    assert [r["issue"] for r in O.severity_issues(df).collect()] == [None, None, "CODE_UNKNOWN", "CODE_UNKNOWN"]
