"""Name resolution and alias reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resolve as R
from ..sources import tables as T
from . import domain as D
from .registry import query


def _text(column):
    return F.col(column).cast("string")


def entities(spark, folder):
    return D.table(spark, folder, "customer").select(
        _text("c_custkey").alias("entity_id"),
        F.col("c_name").alias("canonical_name"),
        F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("display_name"),
    )


def aliases(spark, folder):
    """Names of customers in credit, one alias per segment, and some dead targets."""
    c = D.table(spark, folder, "customer")
    own = c.where("c_acctbal >= 0").select(_text("c_custkey").alias("entity_id"), F.col("c_name").alias("alias_text"))
    shared = c.select(_text("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("alias_text"))
    dead = c.where("c_acctbal < 0").select(
        F.concat(F.lit("gone-"), "c_custkey").alias("entity_id"), F.col("c_name").alias("alias_text")
    )
    return own.unionByName(shared).unionByName(dead)


def mentions(spark, folder):
    """How each order spells its customer."""
    o = D.table(spark, folder, "orders").join(
        D.table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    name, status = F.col("c_name"), F.col("o_orderstatus")
    spelled = F.when(status == "F", name).when(status == "O", F.upper(name)).otherwise(
        F.translate(name, "#", "-")
    )
    raw = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("c_mktsegment"))
        .when(F.col("o_orderpriority") == "2-HIGH", _text("c_custkey"))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat_ws(" clerk ", "o_orderstatus", "c_custkey"))
        .otherwise(spelled)
    )
    return o.select("o_orderkey", raw.alias("raw"))


CTES = """ents AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS canonical_name, c_mktsegment || ' ' || c_custkey AS display_name FROM customer),
als AS (SELECT CAST(c_custkey AS VARCHAR) AS entity_id, c_name AS alias_text FROM customer WHERE c_acctbal >= 0
  UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
  UNION ALL SELECT 'gone-' || c_custkey, c_name FROM customer WHERE c_acctbal < 0),
live AS (SELECT * FROM als WHERE entity_id IN (SELECT entity_id FROM ents)),
ment AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN c_mktsegment WHEN '2-HIGH' THEN CAST(c_custkey AS VARCHAR)
    WHEN '5-LOW' THEN o_orderstatus || ' clerk ' || c_custkey
    ELSE CASE o_orderstatus WHEN 'F' THEN c_name WHEN 'O' THEN upper(c_name) ELSE replace(c_name, '#', '-') END END AS raw
  FROM orders JOIN customer ON o_custkey = c_custkey),
keys AS (SELECT 1 AS tier, alias_text AS key, entity_id FROM live UNION ALL SELECT 2, lower(alias_text), entity_id FROM live
  UNION ALL SELECT 3, regexp_replace(lower(alias_text), '[^a-z0-9]+', '', 'g'), entity_id FROM live
  UNION ALL SELECT 4, entity_id, entity_id FROM ents UNION ALL SELECT 5, lower(canonical_name), entity_id FROM ents
  UNION ALL SELECT 5, lower(display_name), entity_id FROM ents
  UNION ALL SELECT 6, regexp_replace(lower(canonical_name), '[^a-z0-9]+', '', 'g'), entity_id FROM ents
  UNION ALL SELECT 6, regexp_replace(lower(display_name), '[^a-z0-9]+', '', 'g'), entity_id FROM ents),
idx AS (SELECT tier, key, count(DISTINCT entity_id) AS n, min(entity_id) AS e FROM keys GROUP BY tier, key),
raws AS (SELECT DISTINCT raw FROM ment),
rawkeys AS (SELECT raw, tier, CASE WHEN tier IN (1, 4) THEN raw WHEN tier IN (2, 5) THEN lower(raw)
   ELSE regexp_replace(lower(raw), '[^a-z0-9]+', '', 'g') END AS key FROM raws, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS tier)),
hits AS (SELECT raw, tier, n, e FROM rawkeys JOIN idx USING (tier, key)),
best AS (SELECT raw, min(tier) AS tier, arg_min(n, tier) AS n, arg_min(e, tier) AS e FROM hits GROUP BY raw),
res AS (SELECT o_orderkey, m.raw, CAST(tier AS INTEGER) AS tier, CASE WHEN tier IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
   CASE WHEN n = 1 THEN e END AS entity_id FROM ment m LEFT JOIN best b ON b.raw = m.raw)
"""


def resolved(spark, folder):
    index = R.tier_index(entities(spark, folder), aliases(spark, folder))
    return R.resolve(mentions(spark, folder), index)


@query(f"WITH {CTES} SELECT * FROM res")
def tiered_alias_match(spark, folder):
    return resolved(spark, folder)


@query(f"WITH {CTES} SELECT tier, status, count(*) AS n FROM res GROUP BY tier, status")
def match_tier_counts(spark, folder):
    return resolved(spark, folder).groupBy("tier", "status").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
    CASE WHEN l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'A' THEN 1 WHEN l_returnflag = 'N' THEN 2 ELSE 3 END AS tier,
    'matched' AS status, p_brand AS entity_id FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def benchmark_match(spark, folder):
    """Brands as benchmarks: finished lines declare theirs, others are spelled three ways."""
    brands = D.benchmarks(spark, folder).select(
        F.col("benchmark_id").alias("entity_id"), F.col("benchmark_id").alias("canonical_name"),
        F.concat(F.lit("the "), F.col("benchmark_id")).alias("display_name"),
    )
    known = brands.select("entity_id", F.col("canonical_name").alias("alias_text"))
    lines = D.table(spark, folder, "lineitem").join(
        D.table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    brand = F.col("p_brand")
    raw = F.when(F.col("l_returnflag") == "A", brand).when(F.col("l_returnflag") == "N", F.upper(brand)).otherwise(
        F.translate(brand, "#", " ")
    )
    told = lines.select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
        raw.alias("raw"), F.when(F.col("l_linestatus") == "F", brand).alias("stated"),
    )
    return R.resolve(told, R.tier_index(brands, known), "raw", "stated").drop("raw", "stated")


_COLLISION_SQL = """k AS (SELECT DISTINCT 'exact' AS match_kind, alias_text AS match_key, entity_id FROM als
  UNION SELECT 'normalized', regexp_replace(lower(alias_text), '[^a-z0-9]+', '', 'g'), entity_id FROM als),
c AS (SELECT match_kind, match_key, count(*) AS n_entities, min(entity_id) AS first_entity, max(entity_id) AS last_entity
  FROM k GROUP BY ALL HAVING count(*) > 1)"""
_PART_ALIASES = "als AS (SELECT p_brand AS entity_id, p_name AS alias_text FROM part UNION ALL SELECT p_brand, upper(p_type) FROM part),"


def _part_aliases(spark, folder):
    part = D.table(spark, folder, "part")
    return part.select(F.col("p_brand").alias("entity_id"), F.col("p_name").alias("alias_text")).unionByName(
        part.select("p_brand", F.upper("p_type")).toDF("entity_id", "alias_text")
    )


@query(f"WITH {_PART_ALIASES} {_COLLISION_SQL} SELECT * FROM c")
def alias_collisions(spark, folder):
    return R.alias_collisions(_part_aliases(spark, folder))


@query(f"WITH {_PART_ALIASES} {_COLLISION_SQL} SELECT k.* FROM k JOIN c USING (match_kind, match_key)")
def alias_collision_members(spark, folder):
    return R.collision_members(_part_aliases(spark, folder))


@query(
    """WITH u AS (SELECT 'supplier' AS kind, CAST(s_suppkey AS VARCHAR) AS entry_id, replace(s_name, 'Supplier', 'party') AS name FROM supplier
      UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), replace(c_name, 'Customer', 'Party ') FROM customer
      UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name FROM part),
    k AS (SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, kind, entry_id FROM u)
    SELECT key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n, min(entry_id) AS first_id FROM k GROUP BY key"""
)
def candidate_inventory(spark, folder):
    s, c, p = (D.table(spark, folder, t) for t in ("supplier", "customer", "part"))

    def catalog(df, kind, key, name):
        return df.select(F.lit(kind).alias("kind"), _text(key).alias("entry_id"), name.alias("name"))

    union = (
        catalog(s, "supplier", "s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("party")))
        .unionByName(catalog(c, "customer", "c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Party "))))
        .unionByName(catalog(p, "part", "p_partkey", F.col("p_name")))
    )
    return R.merge_catalogs(union)


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS entity_id, CAST(1 + (s_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 3000))::INT AS BIGINT) AS parts
    FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)"""
)
def known_candidates(spark, folder):
    """Customers in credit as candidates against two registry parts of suppliers."""
    s = D.table(spark, folder, "supplier")
    rows = s.select(_text("s_suppkey").alias("entity_id"), "s_acctbal")
    registry = T.registry_union({"core": rows, "seed": rows.where("s_acctbal < 3000")})
    candidates = D.table(spark, folder, "customer").where("c_acctbal > 0").select(
        _text("c_custkey").alias("entity_id")
    )
    return R.known_candidates(candidates, registry)


@query(
    """SELECT lower(n_name) || '-customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS entity_id,
    CASE WHEN c_acctbal < 0 THEN c_name ELSE 'C ' || c_custkey END AS canonical_name,
    CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment WHEN c_acctbal < 0 THEN c_name ELSE 'C ' || c_custkey END AS display_name,
    n_name AS provider, CAST(CASE WHEN c_acctbal < 0 THEN 2 ELSE 3 END + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS INTEGER) AS n_aliases
    FROM (SELECT c.*, replace(n_name, '_', '-') AS n_name FROM customer c JOIN nation ON c_nationkey = n_nationkey)"""
)
def candidate_projection(spark, folder):
    c = D.table(spark, folder, "customer").join(
        D.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    candidates = c.select(
        F.concat_ws("/", F.replace("n_name", F.lit("_"), F.lit("-")), "c_name").alias("candidate_id"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("C "), "c_custkey")).alias("canonical_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).alias("display_name"),
        F.lit(None).cast("string").alias("provider"),
    )
    rows = R.project_candidates(candidates)
    return rows.withColumn("n_aliases", F.size("aliases")).drop("aliases")


@query(
    """SELECT o_orderkey, CASE
      WHEN st = 'none' AND NOT (pr = 'none' AND n = 0) THEN 'COLLISION_FACTS_NOT_EMPTY'
      WHEN st <> 'none' AND pr || '_collision' <> st THEN 'COLLISION_PRIORITY_MISMATCH'
      WHEN st <> 'none' AND n < 2 THEN 'COLLISION_SUBJECTS_MISSING'
      WHEN st <> 'none' AND oc NOT IN ('unresolved', 'rejected') THEN 'COLLISION_NOT_AMBIGUOUS'
      WHEN st <> 'none' AND ac NOT IN ('no_alias', 'reject_alias') THEN 'COLLISION_ALIAS_ADDED'
      WHEN oc = 'resolved' AND ac <> 'add_scoped_alias' THEN 'RESOLVED_WITHOUT_ALIAS'
      WHEN oc = 'unresolved' AND ac <> 'no_alias' THEN 'UNRESOLVED_WITH_ALIAS'
      WHEN oc = 'rejected' AND ac <> 'reject_alias' THEN 'REJECTED_WITHOUT_REJECTION' END AS issue
    FROM (SELECT l_orderkey AS o_orderkey, min(l_linenumber) - 1 AS n,
      CASE any_value(o_orderstatus) WHEN 'F' THEN 'none' WHEN 'O' THEN 'exact_collision' ELSE 'normalized_collision' END AS st,
      CASE any_value(o_orderpriority) WHEN '1-URGENT' THEN 'none' WHEN '2-HIGH' THEN 'normalized' ELSE CASE any_value(o_orderstatus) WHEN 'F' THEN 'none' ELSE 'exact' END END AS pr,
      CASE max(l_returnflag) WHEN 'R' THEN 'rejected' WHEN 'N' THEN 'unresolved' ELSE 'resolved' END AS oc,
      CASE min(l_returnflag) WHEN 'R' THEN 'reject_alias' WHEN 'N' THEN 'no_alias' ELSE 'add_scoped_alias' END AS ac
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey)"""
)
def collision_facts(spark, folder):
    """Decisions made from each order's lines: flags give outcome and action."""
    joined = D.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_linenumber") - 1).alias("n_conflicting"),
        F.max("l_returnflag").alias("hi"), F.min("l_returnflag").alias("lo"),
    ).join(D.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "none").when(
        F.col("o_orderstatus") == "O", "exact_collision"
    ).otherwise("normalized_collision")
    priority = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "none")
        .when(F.col("o_orderpriority") == "2-HIGH", "normalized")
        .when(F.col("o_orderstatus") == "F", "none").otherwise("exact")
    )
    decisions = joined.select(
        "o_orderkey", "n_conflicting", status.alias("collision_status"), priority.alias("matching_priority"),
        F.when(status != "none", "MANY_SUBJECTS").alias("collision_reason"),
        F.when(F.col("hi") == "R", "rejected").when(F.col("hi") == "N", "unresolved").otherwise("resolved").alias("outcome"),
        F.when(F.col("lo") == "R", "reject_alias").when(F.col("lo") == "N", "no_alias").otherwise("add_scoped_alias").alias("action"),
        F.lit(None).cast("string").alias("selected_id"),
    )
    return R.collision_fact_issues(decisions).select("o_orderkey", "issue")
