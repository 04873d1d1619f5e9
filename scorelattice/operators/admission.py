"""Ordered admission rules for sources, fetches and claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.jsonpath import matches_template
from ..functions.rules import all_failures, first_failure, refuse
from ..functions.text import strict_number, strict_number_error

# Source classes and parsers that never feed results, and the
# governance statements every result source must make.
TRUSTED_LEVELS = ("O5", "O4", "O3", "O2", "O1")
BLOCKED_SOURCE_TYPES = (
    "fake", "fixture", "mock", "synthetic", "fallback", "html_table", "web_js_spa",
)
BLOCKED_PARSERS = (
    "fake", "hf_benchmark_api", "artificial_analysis_api", "lmsys_arena_api",
    "livebench_adapter", "livecodebench_adapter", "taubench_s3",
)
DERIVED_MARKERS = ("mock", "mock_used", "fallback", "fallback_used", "derived", "derived_score")
ARTICLE_SEGMENTS = ("/article", "/blog", "/news", "/newsletter", "/post", "/press")
TERMS_BLOCKED = ("arcprize.org/media/data/leaderboard/v2.json",)
GOVERNANCE = {
    "production_eligible": "true", "result_kind": "reported_result", "direct_source_only": "true",
}
FETCH_MARKERS = ("mock_used", "fallback_used", "derived", "transformed", "assembled")
ECHOED_METADATA = ("verbatim", "artifact_count", *FETCH_MARKERS)
MAX_FETCH_BYTES = 64 * 1024 * 1024
# The fields a source's current projection shares with its revision.
PROJECTED_FIELDS = (
    "source_name", "source_url", "source_type", "officialness_level", "machine_readable",
    "requires_auth", "supports_history", "update_cadence", "parser_name", "parser_version",
    "parser_config", "status", "notes",
)
QUARANTINE_CODES = ("MODEL_AMBIGUOUS", "MODEL_UNRESOLVED")
CLAIM_DIMENSIONS = (
    "benchmark_raw", "metric_raw", "split_raw", "setting_raw", "evaluation_version_raw",
)


def _any_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(False)
    for cond in conditions:
        out = out | cond
    return out


def source_eligibility(config: str = "parser_config") -> Column:
    """First reason a source may not be ingested, or null.

    The configuration is a ``map<string,string>``; its governance statements
    are entries named ``governance.<statement>``.
    """
    url = F.col("source_url")
    conf = F.col(config)
    # Percent-encoding hides no endpoint; a path that cannot be decoded is refused as malformed.
    spelled = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    decoded = F.try_url_decode(F.replace(spelled, F.lit("+"), F.lit("%2B")))
    path = F.rtrim(F.lower(F.coalesce(decoded, F.lit(""))), F.lit("/"))
    host = F.rtrim(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), F.lit("."))

    def setting(name: str) -> Column:
        return F.coalesce(F.element_at(conf, F.lit(name)), F.lit(""))

    governance = [F.map_contains_key(conf, F.lit(f"governance.{k}")) for k in GOVERNANCE]
    return first_failure(
        [
            refuse(F.col("status") != "active", "SOURCE_NOT_ACTIVE"),
            refuse(~F.col("officialness_level").isin(*TRUSTED_LEVELS), "OFFICIALNESS_NOT_TRUSTED"),
            refuse(~F.col("machine_readable"), "NOT_MACHINE_READABLE"),
            refuse(F.col("source_type").isin(*BLOCKED_SOURCE_TYPES), "SOURCE_TYPE_QUARANTINED"),
            refuse(F.col("parser_name").isin(*BLOCKED_PARSERS), "PARSER_QUARANTINED"),
            (_any_of([setting(m) == "true" for m in DERIVED_MARKERS]), "DERIVED_CONFIGURATION"),
            (setting("mode") == "discovery", "DISCOVERY_METADATA"),
            (url.isNotNull() & decoded.isNull(), "SOURCE_URL_MALFORMED"),
            (path.endswith("/first-rows"), "PREVIEW_ENDPOINT"),
            (F.concat(host, path).isin(*TERMS_BLOCKED), "TERMS_PROHIBIT_ENDPOINT"),
            (setting("automation_collection_prohibited") == "true", "AUTOMATION_PROHIBITED"),
            (_any_of([F.contains(F.lower(url), F.lit(s)) for s in ARTICLE_SEGMENTS]), "ARTICLE_SOURCE"),
            (~_any_of(governance), "GOVERNANCE_MISSING"),
            *[
                (setting(f"governance.{k}") != v, f"GOVERNANCE_{k.upper()}")
                for k, v in GOVERNANCE.items()
            ],
        ]
    )


def admit_sources(sources: DataFrame, revisions: DataFrame, leaves: DataFrame) -> DataFrame:
    """Sources with ``source_reason``: null for the exact certified current revision.

    ``leaves`` holds, per revision, the effective decision's id, outcome and
    policy facts, or its chain error.
    """
    fields = [f for f in PROJECTED_FIELDS if f in sources.columns and f in revisions.columns]
    r = revisions.select(
        F.col("revision_id").alias("current_revision_id"),
        F.col("source_id").alias("r_source_id"),
        F.col("benchmark_id").alias("r_benchmark_id"),
        F.col("status").alias("r_status"),
        "definition_hash",
        F.struct(*fields).alias("r_fields"),
    )
    joined = sources.join(r, "current_revision_id", "left").join(
        leaves.withColumnRenamed("entity", "current_revision_id"), "current_revision_id", "left"
    )
    policy = F.col("policy")
    own = F.struct(*fields)
    reason = first_failure(
        [
            (source_eligibility().isNotNull(), "SRC_SOURCE_CLASS_FORBIDDEN"),
            (F.col("r_source_id").isNull(), "SRC_CURRENT_REVISION_MISMATCH"),
            refuse((F.col("r_source_id") != F.col("source_id")) | (F.col("r_status") != "active"), "SRC_REVISION_NOT_ACTIVE"),
            (~F.col("r_benchmark_id").eqNullSafe(F.col("benchmark_id")), "SRC_REVISION_PROJECTION_MISMATCH"),
            (~own.eqNullSafe(F.col("r_fields")), "SRC_REVISION_PROJECTION_MISMATCH"),
            (F.col("chain_error").isNotNull(), F.concat(F.lit("SRC_DECISION_"), F.col("chain_error"))),
            (F.col("leaf_id").isNull(), "SRC_DECISION_MISSING"),
            refuse(F.col("outcome") != "certified", "SRC_DECISION_NOT_CERTIFIED"),
            (policy.isNull(), "SRC_POLICY_MISSING"),
            (~F.col("policy.definition_hash").eqNullSafe(F.col("definition_hash")), "SRC_POLICY_INVALID"),
            refuse(~F.array_contains("policy.approved_urls", F.col("source_url")), "SRC_POLICY_INVALID"),
            refuse(~F.col("policy.max_bytes").between(1, MAX_FETCH_BYTES), "SRC_POLICY_INVALID"),
        ]
    )
    return joined.withColumn("source_reason", reason)


def fetch_admission() -> Column:
    """First reason a fetched artifact is refused, from joined fetch columns."""
    meta, echo = F.col("metadata"), F.col("snapshot_metadata")

    def of(m: Column, name: str) -> Column:
        return F.coalesce(F.element_at(m, F.lit(name)), F.lit(""))

    return first_failure(
        [
            (F.col("source_reason").isNotNull(), "SRC_NOT_ADMITTED"),
            refuse(F.col("n_bytes") > F.col("max_bytes"), "FETCH_BODY_TOO_LARGE"),
            (~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), "FETCH_HTTP_STATUS_INVALID"),
            refuse(~F.array_contains("approved_final_urls", F.col("final_url")), "FETCH_FINAL_URL_NOT_APPROVED"),
            (
                (of(meta, "verbatim") != "true") | (of(meta, "artifact_count") != "1"),
                "FETCH_NON_VERBATIM_OR_MULTI_ARTIFACT",
            ),
            (_any_of([of(meta, m) == "true" for m in FETCH_MARKERS]), "FETCH_FALLBACK_OR_MOCK"),
            refuse(F.col("content_hash") != F.col("snapshot_hash"), "FETCH_SNAPSHOT_NOT_VERBATIM"),
            refuse(
                ~F.col("snapshot_status").eqNullSafe(F.col("http_status"))
                | (of(echo, "final_url") != F.col("final_url"))
                | _any_of([of(echo, m) != of(meta, m) for m in ECHOED_METADATA]),
                "FETCH_SNAPSHOT_METADATA_MISMATCH",
            ),
        ]
    )


def locator_matches(locator: Column, contract: Column) -> Column:
    """Whether an evidence locator is exactly what its source's contract allows.

    Both are structs with ``type, fields`` and the type's own columns.
    """
    same_fields = locator["fields"].eqNullSafe(contract["fields"])
    path_ok = matches_template(locator["record_path"], contract["record_path_template"])
    kind = locator["type"]
    by_type = (
        F.when(kind == "json_path_v1", path_ok)
        .when(
            kind == "json_script_path_v1",
            path_ok
            & locator["script_id"].eqNullSafe(contract["script_id"])
            & locator["script_type"].eqNullSafe(contract["script_type"]),
        )
        .when(kind == "csv_cell_v1", locator["row_index"] >= 0)
        .when(kind == "parquet_cell_v1", (locator["row_index"] >= 0) & locator["file_path"].isNotNull())
        .otherwise(False)
    )
    return F.coalesce(same_fields & by_type & (kind == contract["type"]), F.lit(False))


def dimension_error(value: Column, mode: Column, constant: Column, evidence: Column, allowed: Column) -> Column:
    """Constant or evidence value must equal the claim's and be on the list."""
    expected = F.when(mode == "revision_constant", constant).otherwise(evidence)
    listed = F.coalesce(F.array_contains(allowed, F.coalesce(value, F.lit("∅"))), F.lit(False))
    return first_failure(
        [
            ((mode == "evidence_field") & evidence.isNull(), "EVIDENCE_VALUE_NOT_VERBATIM"),
            (~value.eqNullSafe(expected), "DIMENSION_VALUE_MISMATCH"),
            (~listed, "DIMENSION_VALUE_NOT_ALLOWED"),
        ]
    )


def admit_claims(claims: DataFrame, dimensions: Sequence[str] = CLAIM_DIMENSIONS) -> DataFrame:
    """Claims joined to source, record, policy and matches -> ``disposition, reason``.

    Expects the record's values as ``e_<field>``, the policy's dimension rules
    as ``d_<field>`` structs (mode, constant, allowed), and the resolvers'
    results as ``model_status, model_match, benchmark_status, benchmark_match``.
    """
    blank = F.lit("")
    numeric_error = strict_number_error(F.col("score_raw"), F.col("lexeme_policy"))
    number = strict_number(F.col("score_raw"), F.col("lexeme_policy"))
    dims = []
    for name in dimensions:
        rule = F.col(f"d_{name}")
        dims.append(
            dimension_error(F.col(name), rule["mode"], rule["constant"], F.col(f"e_{name}"), rule["allowed"])
        )
    reason = first_failure(
        [
        (F.col("source_reason").isNotNull(), "SRC_NOT_ADMITTED"),
        (~F.col("decision_id").eqNullSafe(F.col("admitting_decision_id")), "CLAIM_SOURCE_DECISION_MISMATCH"),
        refuse(F.col("claim_source_id") != F.col("source_id"), "CLAIM_SOURCE_MISMATCH"),
        (
            (F.trim(F.coalesce("model_raw", blank)) == "")
            | (F.trim(F.coalesce("benchmark_raw", blank)) == "")
            | (F.coalesce("score_raw", blank) == ""),
            "CLAIM_REQUIRED_RAW_FIELD_MISSING",
        ),
        refuse(F.col("source_benchmark_id").isNull() | (F.col("benchmark_status") != "matched"), "BENCHMARK_UNRESOLVED"),
        (
            ~F.col("benchmark_match").eqNullSafe(F.col("source_benchmark_id"))
            | ~F.col("benchmark_id").eqNullSafe(F.col("source_benchmark_id")),
            "BENCHMARK_SOURCE_MISMATCH",
        ),
        refuse(~F.array_contains("locator_types", F.col("locator.type")), "EVIDENCE_LOCATOR_UNSUPPORTED"),
        (~locator_matches(F.col("locator"), F.col("contract")), "EVIDENCE_LOCATOR_CONTRACT_MISMATCH"),
        refuse(~F.col("record_found"), "EVIDENCE_NOT_FOUND"),
        (F.col("e_model_raw").isNull() | F.col("e_score_raw").isNull(), "EVIDENCE_VALUE_NOT_VERBATIM"),
        refuse(
            (F.col("e_model_raw") != F.col("model_raw")) | (F.col("e_score_raw") != F.col("score_raw")),
            "EVIDENCE_VALUE_MISMATCH",
        ),
        *dims,
        numeric_error,
        (~F.col("score_unit").eqNullSafe(F.col("policy_unit")), "SCORE_UNIT_UNDECLARED"),
        refuse(F.col("score_numeric") != number, "SCORE_NUMERIC_MISMATCH"),
        (F.col("model_status") == "ambiguous", "MODEL_AMBIGUOUS"),
        refuse(F.col("model_status") != "matched", "MODEL_UNRESOLVED"),
        (~F.col("model_entity_id").eqNullSafe(F.col("model_match")), "MODEL_MAPPING_MISMATCH"),
        ]
    )
    # One column holds the outcome of the whole chain; the rest reads that column.
    held = F.col("reason").isin(*QUARANTINE_CODES)
    identity_only = F.col("reason").isin(*QUARANTINE_CODES, "MODEL_MAPPING_MISMATCH")
    return claims.withColumn("reason", reason).select(
        "*",
        F.when(F.col("reason").isNull(), "admit").when(held, "quarantine").otherwise("reject").alias("disposition"),
        F.when(F.col("reason").isNull() | identity_only, number).alias("admitted_numeric"),
    )


def capture_status(admitted: DataFrame, validations: DataFrame) -> DataFrame:
    """Status after admission: review is due on quarantine or a doubtful validation.

    ``admitted`` should be stored admission results; a filter straight on the
    admission chain makes Spark derive constraints from the whole chain.
    """
    per_claim = validations.groupBy("claim_id").agg(
        F.bool_or(F.col("outcome") == "fail").alias("any_fail"),
        F.bool_or(F.col("outcome") == "pass").alias("any_pass"),
    )
    doubtful = F.coalesce("any_fail", F.lit(False)) | ~F.coalesce("any_pass", F.lit(False))
    return (
        admitted.where("disposition <> 'reject'")
        .join(per_claim, "claim_id", "left")
        .withColumn(
            "capture_status",
            F.when((F.col("disposition") == "quarantine") | doubtful, "needs_review").otherwise("parser_verified"),
        )
        .drop("any_fail", "any_pass")
    )


def risk_signals(columns: Mapping[str, str] | None = None) -> Column:
    """Sorted labels of what looks risky about a stored claim.

    Expects ``capture_method, locator_type, capture_status, decision_id,
    has_snapshot, revision_source_type, review_outcome, publication_outcome``.
    """
    c = {name: F.col((columns or {}).get(name, name)) for name in (
        "capture_method", "locator_type", "capture_status", "decision_id", "has_snapshot",
        "revision_source_type", "review_outcome", "publication_outcome",
    )}
    method, kind = F.lower(c["capture_method"]), F.lower(c["revision_source_type"])
    stopped = ("quarantined", "revoked")
    return all_failures(
        [
            (F.contains(method, F.lit("derived")), "DERIVED_CAPTURE_METHOD"),
            (method.rlike("fake|synthetic|mock"), "SYNTHETIC_CAPTURE_METHOD"),
            (F.contains(method, F.lit("discovery")), "DISCOVERY_CAPTURE_METHOD"),
            (F.contains(method, F.lit("fallback")), "FALLBACK_CAPTURE_METHOD"),
            (c["locator_type"] == "derived_analytics", "DERIVED_EVIDENCE_LOCATION"),
            (c["capture_status"].isin("unreviewed", "needs_review"), "PROVISIONAL_CAPTURE_STATUS"),
            (c["decision_id"].isNull(), "LEGACY_UNASSESSED"),
            (~c["has_snapshot"], "MISSING_SNAPSHOT"),
            (kind.isNull(), "MISSING_SOURCE_REVISION"),
            (kind == "fake", "SYNTHETIC_SOURCE_TYPE"),
            (F.contains(kind, F.lit("discovery")), "DISCOVERY_SOURCE_TYPE"),
            *[(c["review_outcome"] == o, f"REVIEW_{o.upper()}") for o in stopped],
            *[(c["publication_outcome"] == o, f"PUBLICATION_{o.upper()}") for o in stopped],
        ]
    )


def filter_models(
    models: DataFrame, vendors: Sequence[str] = (), open_weights: bool | None = None, search: str = ""
) -> DataFrame:
    """Models shown: chosen vendors, open weights only, text in name or vendor."""
    kept = models
    if vendors:
        kept = kept.where(F.col("vendor").isin(*vendors))
    if open_weights:
        kept = kept.where(F.coalesce("open_weights", F.lit(False)))
    if search.strip():
        fields = [c for c in ("name", "vendor", "family") if c in models.columns]
        kept = kept.where(F.contains(F.lower(F.concat_ws(" ", *fields)), F.lit(search.strip().lower())))
    return kept


def valid_selection(wanted: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """Asked-for ids that exist, in the order asked, up to a display limit."""
    kept = wanted.join(known, "id", "left_semi").orderBy("position")
    return kept.limit(limit) if limit is not None else kept


def capped_columns(benchmarks: DataFrame, category: str | None = None, cap: int = 12) -> DataFrame:
    """Benchmark columns shown: a whole category, or the first few in order."""
    if category is not None:
        return benchmarks.where(F.col("category") == category)
    return benchmarks.orderBy("no").limit(cap)
