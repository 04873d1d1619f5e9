"""Source, fetch and claim admission; filters of the shown table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as A, lineage as L, ranking as R
from ..operators.ordering import sequential_position
from ..session import staged
from . import domain as D
from .registry import query

_RULED = """CASE n WHEN 1 THEN 'OFFICIALNESS_NOT_TRUSTED' WHEN 2 THEN 'NOT_MACHINE_READABLE' WHEN 3 THEN 'SOURCE_TYPE_QUARANTINED' WHEN 4 THEN 'PARSER_QUARANTINED'
  WHEN 5 THEN 'DERIVED_CONFIGURATION' WHEN 6 THEN 'DISCOVERY_METADATA' WHEN 7 THEN 'PREVIEW_ENDPOINT' WHEN 8 THEN 'TERMS_PROHIBIT_ENDPOINT'
  WHEN 9 THEN 'AUTOMATION_PROHIBITED' WHEN 10 THEN 'ARTICLE_SOURCE' WHEN 11 THEN 'GOVERNANCE_MISSING' WHEN 12 THEN 'GOVERNANCE_PRODUCTION_ELIGIBLE'
  WHEN 13 THEN 'GOVERNANCE_RESULT_KIND' WHEN 14 THEN 'GOVERNANCE_DIRECT_SOURCE_ONLY' END"""
_SOURCE_SQL = f"""src AS (SELECT c_custkey AS source_id, c_acctbal, c_mktsegment,
  CASE WHEN c_acctbal < 0 THEN 'SOURCE_NOT_ACTIVE' ELSE {_RULED.replace('CASE n', 'CASE c_nationkey')} END AS reason, c_nationkey AS n FROM customer)"""


def sources(spark, folder):
    """Customers as sources; the nation decides which rule a source breaks."""
    c = D.table(spark, folder, "customer")
    n = F.col("c_nationkey")
    url = (
        F.when(n == 7, F.concat(F.lit("https://rows.example.org/First-Rows/?s="), "c_custkey"))
        .when(n == 8, F.lit("https://arcprize.org/media/data/leaderboard/v2.json"))
        .when(n == 10, F.concat(F.lit("https://example.org/News/"), "c_custkey"))
        .otherwise(F.concat(F.lit("https://example.org/results/"), "c_custkey"))
    )
    governance = {
        "governance.production_eligible": F.when(n == 12, "false").otherwise("true"),
        "governance.result_kind": F.when(n == 13, "opinion").otherwise("reported_result"),
        "governance.direct_source_only": F.when(n == 14, "false").otherwise("true"),
    }
    config = F.map_from_arrays(
        F.array(
            F.lit("derived"), F.lit("mode"), F.lit("automation_collection_prohibited"),
            *[F.when(n != 11, k).otherwise(f"x{k}") for k in governance],
        ),
        F.array(
            F.when(n == 5, "true").otherwise("false"), F.when(n == 6, "discovery").otherwise("results"),
            F.when(n == 9, "true").otherwise("false"), *governance.values(),
        ),
    )
    return c.select(
        F.col("c_custkey").alias("source_id"), F.col("c_mktsegment").alias("benchmark_id"),
        F.when(F.col("c_acctbal") < 0, "retired").otherwise("active").alias("status"),
        F.when(n == 1, "O0").otherwise("O5").alias("officialness_level"),
        (n != 2).alias("machine_readable"),
        F.when(n == 3, "html_table").otherwise("json_api").alias("source_type"),
        F.when(n == 4, "taubench_s3").otherwise("generic_json").alias("parser_name"),
        url.alias("source_url"), F.col("c_name").alias("source_name"), config.alias("parser_config"),
        F.col("c_custkey").alias("current_revision_id"), n.alias("n"), "c_acctbal",
    )


@query(f"WITH {_SOURCE_SQL} SELECT source_id, reason FROM src")
def source_eligibility(spark, folder):
    return sources(spark, folder).select("source_id", A.source_eligibility().alias("reason"))


@query(
    f"""WITH {_SOURCE_SQL} SELECT source_id, CASE WHEN reason IS NOT NULL THEN 'SRC_SOURCE_CLASS_FORBIDDEN' WHEN n = 15 THEN 'SRC_CURRENT_REVISION_MISMATCH'
    WHEN n = 16 THEN 'SRC_REVISION_NOT_ACTIVE' WHEN n IN (17, 18) THEN 'SRC_REVISION_PROJECTION_MISMATCH' WHEN n = 19 THEN 'SRC_DECISION_CHAIN_AMBIGUOUS'
    WHEN n = 20 THEN 'SRC_DECISION_MISSING' WHEN n = 21 THEN 'SRC_DECISION_NOT_CERTIFIED' WHEN n = 22 THEN 'SRC_POLICY_MISSING' WHEN n IN (23, 24) THEN 'SRC_POLICY_INVALID' END AS source_reason FROM src"""
)
def source_admission(spark, folder):
    s = sources(spark, folder)
    n = F.col("n")
    revisions = s.where("n <> 15").select(
        F.col("source_id").alias("revision_id"), "source_id",
        F.when(n == 17, "OTHER").otherwise(F.col("benchmark_id")).alias("benchmark_id"),
        F.when(n == 16, "retired").otherwise(F.col("status")).alias("status"),
        F.sha2("source_name", 256).alias("definition_hash"),
        F.when(n == 18, "Renamed").otherwise(F.col("source_name")).alias("source_name"),
        "source_url", "source_type", "officialness_level", "machine_readable", "parser_name",
    )
    # The status of a revision is a rule of its own, so it is not compared twice.
    decisions = s.where("n <> 20").select(
        F.explode(F.when(n == 19, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("i"), "*"
    ).select(
        (F.col("source_id") * 10 + F.col("i")).alias("id"), F.col("source_id").alias("entity"),
        F.lit(None).cast("long").alias("parent"),
        F.when(n == 21, "quarantined").otherwise("certified").alias("outcome"),
        F.when(
            n != 22,
            F.struct(
                F.when(n == 23, "stale").otherwise(F.sha2("source_name", 256)).alias("definition_hash"),
                F.array(F.when(n == 24, "https://example.org/other").otherwise(F.col("source_url"))).alias("approved_urls"),
                F.lit(1_000_000).alias("max_bytes"),
            ),
        ).alias("policy"),
    )
    leaves = L.effective_leaves(decisions).join(
        decisions.select(F.col("id").alias("leaf_id"), "outcome", "policy"), "leaf_id", "left"
    )
    return A.admit_sources(s, revisions.drop("status").withColumn(
        "status", F.when(F.col("source_id").isNull(), "").otherwise("active")
    ).join(s.where(n == 16).select("source_id", F.lit("retired").alias("gone")), "source_id", "left").withColumn(
        "status", F.coalesce("gone", "status")
    ).drop("gone"), leaves).select("source_id", "source_reason")


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'FETCH_BODY_TOO_LARGE' WHEN o_custkey % 10 = 1 THEN 'FETCH_HTTP_STATUS_INVALID'
      WHEN o_orderpriority = '1-URGENT' THEN 'FETCH_FINAL_URL_NOT_APPROVED' WHEN o_orderpriority = '2-HIGH' THEN 'FETCH_NON_VERBATIM_OR_MULTI_ARTIFACT'
      WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'FETCH_FALLBACK_OR_MOCK' WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 'FETCH_SNAPSHOT_NOT_VERBATIM'
      WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'FETCH_SNAPSHOT_METADATA_MISMATCH' END AS reason FROM orders"""
)
def fetch_admission(spark, folder):
    o = D.table(spark, folder, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    url = F.concat(F.lit("https://example.org/o/"), "o_orderkey")
    meta = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("verbatim", "artifact_count", "derived")]),
        F.array(
            F.lit("true"), F.when(p == "2-HIGH", "2").otherwise("1"),
            F.when((p == "3-MEDIUM") & (s == "F"), "true").otherwise("false"),
        ),
    )
    echo = F.map_concat(meta, F.create_map(F.lit("final_url"), url))
    fetched = o.select(
        "o_orderkey", F.lit(None).cast("string").alias("source_reason"), F.col("o_totalprice").alias("n_bytes"),
        F.lit(450000).alias("max_bytes"), F.when(F.col("o_custkey") % 10 == 1, 404).otherwise(200).alias("http_status"),
        url.alias("final_url"),
        F.array(F.when(p == "1-URGENT", "https://example.org/").otherwise(url)).alias("approved_final_urls"),
        meta.alias("metadata"), F.sha2("o_orderstatus", 256).alias("content_hash"),
        F.sha2(F.when((p == "3-MEDIUM") & (s == "O"), "changed").otherwise(s), 256).alias("snapshot_hash"),
        F.when((p == "5-LOW") & (s == "P"), 304).otherwise(F.when(F.col("o_custkey") % 10 == 1, 404).otherwise(200)).alias("snapshot_status"),
        echo.alias("snapshot_metadata"),
    )
    return fetched.select("o_orderkey", A.fetch_admission().alias("reason"))


_CLAIM_RULES = """CASE WHEN s_acctbal < 0 THEN 'SRC_NOT_ADMITTED' WHEN l_tax = 0.08 AND l_returnflag = 'A' THEN 'CLAIM_SOURCE_DECISION_MISMATCH'
  WHEN l_quantity = 50 THEN 'CLAIM_REQUIRED_RAW_FIELD_MISSING' WHEN p_size = 50 THEN 'BENCHMARK_UNRESOLVED' WHEN p_size = 49 THEN 'BENCHMARK_SOURCE_MISMATCH'
  WHEN l_linenumber = 7 THEN 'EVIDENCE_LOCATOR_UNSUPPORTED' WHEN l_linenumber = 6 THEN 'EVIDENCE_LOCATOR_CONTRACT_MISMATCH' WHEN l_discount = 0.1 THEN 'EVIDENCE_NOT_FOUND'
  WHEN l_discount = 0.09 THEN 'EVIDENCE_VALUE_MISMATCH' WHEN p_type = 'SMALL' THEN 'DIMENSION_VALUE_MISMATCH' WHEN l_returnflag = 'R' THEN 'DIMENSION_VALUE_NOT_ALLOWED'
  WHEN l_discount = 0.08 THEN 'SCORE_UNIT_UNDECLARED' WHEN l_discount = 0.07 THEN 'SCORE_UNIT_UNDECLARED' WHEN l_discount = 0.06 THEN 'SCORE_NUMERIC_MISMATCH' END"""
_ADMITTED = f"""adm AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_shipdate, l_tax, r AS rejected,
   coalesce(r, CASE WHEN l_tax = 0.07 THEN 'MODEL_AMBIGUOUS' WHEN l_tax = 0.06 THEN 'MODEL_UNRESOLVED' WHEN l_tax = 0.05 THEN 'MODEL_MAPPING_MISMATCH' END) AS reason,
   CASE WHEN r IS NOT NULL THEN 'reject' WHEN l_tax IN (0.07, 0.06) THEN 'quarantine' WHEN l_tax = 0.05 THEN 'reject' ELSE 'admit' END AS disposition,
   CASE WHEN r IS NULL THEN l_extendedprice END AS admitted_numeric
 FROM (SELECT *, {_CLAIM_RULES} AS r FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey))"""


def admitted_claims(spark, folder):
    """Line items as claims with their evidence, policy and matches alongside."""
    li = D.spread_table(spark, folder, "lineitem")
    part = D.table(spark, folder, "part").select("p_partkey", "p_size", "p_type", "p_brand")
    supp = D.table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(
        supp, F.col("l_suppkey") == F.col("s_suppkey")
    )
    disc, tax, no = F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    own = F.concat(F.lit("d"), F.col("l_suppkey"))
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    spelled = F.when(disc == 0.08, F.concat(price, F.lit("%"))).otherwise(price)
    fields = F.lit("model,score")

    def locator(kind, path):
        return F.struct(
            kind.alias("type"), fields.alias("fields"), path.alias("record_path"),
            F.lit("$.rows[{row_index}]").alias("record_path_template"),
            F.lit(None).cast("string").alias("script_id"), F.lit(None).cast("string").alias("script_type"),
            F.lit(None).cast("long").alias("row_index"), F.lit(None).cast("string").alias("file_path"),
        )

    def rule(mode, constant, *allowed):
        return F.struct(
            F.lit(mode).alias("mode"), F.lit(constant).cast("string").alias("constant"),
            F.array(*[F.lit(a) for a in allowed]).alias("allowed"),
        )

    model = F.when(F.col("l_quantity") == 50, " ").otherwise(F.concat(F.lit("s"), F.col("l_suppkey")))
    status = F.when(tax == 0.07, "ambiguous").when(tax == 0.06, "unmatched").otherwise("matched")
    claims = rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate", "l_tax",
        F.when(F.col("s_acctbal") < 0, "SOURCE_NOT_ACTIVE").alias("source_reason"),
        own.alias("decision_id"),
        F.when((tax == 0.08) & (F.col("l_returnflag") == "A"), "other").otherwise(own).alias("admitting_decision_id"),
        F.col("l_suppkey").alias("claim_source_id"), F.col("l_suppkey").alias("source_id"),
        model.alias("model_raw"), F.col("p_brand").alias("benchmark_raw"), spelled.alias("score_raw"),
        F.col("p_brand").alias("source_benchmark_id"),
        F.when(F.col("p_size") == 49, "Brand#0").otherwise(F.col("p_brand")).alias("benchmark_id"),
        F.when(F.col("p_size") == 50, "ambiguous").otherwise("matched").alias("benchmark_status"),
        F.col("p_brand").alias("benchmark_match"),
        locator(
            F.when(no == 7, "html_table_cell").otherwise("json_path_v1"),
            F.concat(F.when(no == 6, "$.rows[0").otherwise("$.rows["), no, F.lit("]")),
        ).alias("locator"),
        locator(F.lit("json_path_v1"), F.lit(None).cast("string")).alias("contract"),
        F.array(F.lit("json_path_v1"), F.lit("csv_cell_v1")).alias("locator_types"),
        (disc != 0.1).alias("record_found"), model.alias("e_model_raw"),
        F.when(disc == 0.09, F.concat(spelled, F.lit("0"))).otherwise(spelled).alias("e_score_raw"),
        F.when(F.col("p_type") == "SMALL", "cost").otherwise("price").alias("metric_raw"),
        F.col("l_returnflag").alias("split_raw"), F.lit(None).cast("string").alias("e_metric_raw"),
        F.col("l_returnflag").alias("e_split_raw"),
        rule("revision_constant", "price", "price").alias("d_metric_raw"),
        rule("evidence_field", None, "A", "N").alias("d_split_raw"),
        F.lit("decimal").alias("lexeme_policy"),
        F.when(disc == 0.07, "percent").alias("score_unit"), F.lit(None).cast("string").alias("policy_unit"),
        F.when(disc == 0.06, F.col("l_extendedprice") + 1).otherwise(F.col("l_extendedprice")).alias("score_numeric"),
        status.alias("model_status"), F.when(status == "matched", F.col("l_suppkey")).alias("model_match"),
        F.when(tax != 0.05, F.col("l_suppkey")).alias("model_entity_id"),
    )
    return A.admit_claims(claims, ("metric_raw", "split_raw"))


@query(
    f"WITH {_ADMITTED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, disposition, reason, admitted_numeric FROM adm"
)
def claim_admission(spark, folder):
    return admitted_claims(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "disposition", "reason", "admitted_numeric"
    )


_CAPTURE_SQL = f"""{_ADMITTED}, val AS (SELECT doc_id, bool_or(toxic = 1) AS bad, bool_or(quality = 1) AS good FROM labels GROUP BY doc_id),
st AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_shipdate, l_tax, disposition, CASE WHEN disposition = 'quarantine' OR coalesce(bad, false) OR NOT coalesce(good, false) THEN 'needs_review' ELSE 'parser_verified' END AS capture_status
  FROM adm LEFT JOIN val ON doc_id = l_orderkey WHERE disposition <> 'reject')"""


def captured(spark, folder):
    """Admitted claims with the labels of the document of the same number as checks."""
    labels = D.table(spark, folder, "labels")
    checks = labels.select(
        F.col("doc_id").alias("claim_id"),
        F.explode(F.array(
            F.when(F.col("quality") == 1, "pass").otherwise("uncertain"),
            F.when(F.col("toxic") == 1, "fail").otherwise("uncertain"),
        )).alias("outcome"),
    )
    # Admission results are a table of their own: stored, then read by what follows.
    admitted = staged(
        admitted_claims(spark, folder).select(F.col("l_orderkey").alias("claim_id"), "disposition")
    )
    return A.capture_status(admitted, checks)


@query(f"WITH {_CAPTURE_SQL} SELECT capture_status, disposition, count(*) AS n FROM st GROUP BY ALL")
def capture_status(spark, folder):
    return captured(spark, folder).groupBy("capture_status", "disposition").agg(F.count(F.lit(1)).alias("n"))


_RISK_SQL = """risk AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(list_filter([
   CASE WHEN l_returnflag = 'R' THEN 'DERIVED_CAPTURE_METHOD' END, CASE WHEN l_tax = 0.01 THEN 'SYNTHETIC_CAPTURE_METHOD' END,
   CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'DERIVED_EVIDENCE_LOCATION' END, CASE WHEN l_discount < 0.02 THEN 'PROVISIONAL_CAPTURE_STATUS' END,
   CASE WHEN l_tax = 0 THEN 'LEGACY_UNASSESSED' END, CASE WHEN s_acctbal < 0 THEN 'MISSING_SNAPSHOT' END, CASE WHEN s_suppkey IS NULL THEN 'MISSING_SOURCE_REVISION' END,
   CASE WHEN s_nationkey = 1 THEN 'SYNTHETIC_SOURCE_TYPE' END, CASE WHEN s_nationkey = 2 THEN 'DISCOVERY_SOURCE_TYPE' END,
   CASE WHEN l_quantity = 1 THEN 'REVIEW_REVOKED' END, CASE WHEN l_quantity = 2 THEN 'PUBLICATION_QUARANTINED' END], lambda x: x IS NOT NULL)) AS code
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


@query(f"WITH {_RISK_SQL} SELECT code, count(*) AS n FROM risk GROUP BY code")
def risk_signal_counts(spark, folder):
    li = D.table(spark, folder, "lineitem").join(
        D.table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left"
    )
    method = F.concat_ws(
        "_", F.when(F.col("l_returnflag") == "R", "Derived"), F.when(F.col("l_tax") == 0.01, "mock"), F.lit("parser")
    )
    claims = li.select(
        method.alias("capture_method"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "derived_analytics").alias("locator_type"),
        F.when(F.col("l_discount") < 0.02, "unreviewed").otherwise("parser_verified").alias("capture_status"),
        F.when(F.col("l_tax") != 0, F.col("l_suppkey")).alias("decision_id"),
        (F.coalesce("s_acctbal", F.lit(0.0)) >= 0).alias("has_snapshot"),
        F.when(F.col("s_suppkey").isNull(), None).when(F.col("s_nationkey") == 1, "fake")
        .when(F.col("s_nationkey") == 2, "hub_discovery").otherwise("json_api").alias("revision_source_type"),
        F.when(F.col("l_quantity") == 1, "revoked").alias("review_outcome"),
        F.when(F.col("l_quantity") == 2, "quarantined").alias("publication_outcome"),
    )
    signals = claims.select(F.explode(A.risk_signals()).alias("code"))
    return signals.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    D.with_ctes(
        "models cells benchmarks",
        """SELECT model_id, name, vendor FROM models WHERE vendor IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_15') AND open_weights
    AND contains(lower(name || ' ' || vendor), 'tion_1')""",
    )
)
def model_filter(spark, folder):
    models = D.models(spark, folder)
    vendors = ("NATION_1", "NATION_2", "NATION_3", "NATION_15")
    return A.filter_models(models, vendors, True, " Tion_1").select("model_id", "name", "vendor")


@query(
    """SELECT o_custkey AS id, count(*) AS asked FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1"""
)
def selection_filter(spark, folder):
    """Customers of orders taken as asked-for models; unknown ones are dropped."""
    wanted = D.table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"))
    known = D.table(spark, folder, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    kept = A.valid_selection(wanted, known)
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("asked"))


@query(
    """SELECT p_brand AS benchmark_id, rn AS place FROM (SELECT p_brand, row_number() OVER (ORDER BY CAST(substr(p_brand, 7) AS INTEGER)) AS rn FROM (SELECT DISTINCT p_brand FROM part)) WHERE rn <= 12"""
)
def column_cap(spark, folder):
    shown = A.capped_columns(D.benchmarks(spark, folder))
    return sequential_position(shown.select("benchmark_id", "no"), [], [F.col("no")], "place").drop("no")
