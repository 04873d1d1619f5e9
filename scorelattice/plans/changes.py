"""Idempotent inserts, reconciles and backfills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H, lineage as L
from ..sources import tables as T
from . import domain as D
from .governance import _DECISIONS, review_decisions
from .registry import query


def _snapshots(spark, folder):
    docs = D.table(spark, folder, "documents").withColumn("revision", F.col("lang"))
    return T.content_snapshots(docs, "source", "revision", "text").drop("content")


@query(
    """WITH s AS (SELECT source AS source_id, lang AS revision_id, sha256(text) AS content_hash, count(*) AS arrivals FROM documents GROUP BY ALL),
    e AS (SELECT DISTINCT source, lang, sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
    SELECT s.*, CASE WHEN h IS NULL THEN 'created' ELSE 'reused' END AS outcome FROM s LEFT JOIN e ON source = source_id AND lang = revision_id AND h = content_hash"""
)
def snapshot_dedupe(spark, folder):
    """Documents as arriving snapshots; those labelled good are stored already."""
    good = D.table(spark, folder, "labels").where("quality = 1").select("doc_id")
    stored = D.table(spark, folder, "documents").join(good, "doc_id", "left_semi")
    existing = T.content_snapshots(stored.withColumn("revision", F.col("lang")), "source", "revision", "text")
    return H.insert_outcomes(
        _snapshots(spark, folder), existing, ["source_id", "revision_id", "content_hash"]
    )


@query(
    """SELECT l_suppkey, l_partkey, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag FROM lineitem
      EXCEPT SELECT l_suppkey, l_partkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F') GROUP BY ALL"""
)
def insert_if_new(spark, folder):
    """Claims keyed by supplier, part and flag; finished lines are in the store."""
    keys = ["l_suppkey", "l_partkey", "l_returnflag"]
    li = D.table(spark, folder, "lineitem")
    fresh = H.insert_if_new(li.select(*keys), li.where("l_linestatus = 'F'"), keys)
    return fresh.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))


_BATCH = """b AS (SELECT 'model' AS entity_type, o_custkey AS entity_id, o_orderpriority AS alias_text FROM orders),
ent AS (SELECT 'model' AS entity_type, c_custkey AS entity_id FROM customer WHERE c_acctbal >= 0)"""


def _alias_batch(spark, folder):
    o = D.table(spark, folder, "orders")
    batch = o.select(
        F.lit("model").alias("entity_type"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("alias_text")
    )
    stored = batch.where("alias_text = '1-URGENT'")
    ents = D.table(spark, folder, "customer").where("c_acctbal >= 0").select(
        F.lit("model").alias("entity_type"), F.col("c_custkey").alias("entity_id")
    )
    return batch, stored, ents


@query(
    f"""WITH {_BATCH} SELECT DISTINCT b.* FROM b JOIN ent USING (entity_type, entity_id) WHERE alias_text <> '1-URGENT'"""
)
def alias_insert(spark, folder):
    batch, stored, ents = _alias_batch(spark, folder)
    return H.new_aliases(batch, stored, ents)


@query(f"WITH {_BATCH} SELECT count(*) AS dangling FROM b LEFT JOIN ent USING (entity_type, entity_id) WHERE ent.entity_id IS NULL")
def alias_dangling(spark, folder):
    batch, _, ents = _alias_batch(spark, folder)
    return H.dangling_aliases(batch, ents).agg(F.count(F.lit(1)).alias("dangling"))


@query(
    """WITH cur AS (SELECT c_custkey AS k, c_name AS name, CAST(c_acctbal AS DECIMAL(18,2)) AS bal FROM customer WHERE c_mktsegment <> 'BUILDING'),
    inc AS (SELECT o_custkey AS k, CASE WHEN count(*) > 10 THEN 'busy' END AS name, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS bal FROM orders GROUP BY 1)
    SELECT coalesce(inc.k, cur.k) AS k, CASE WHEN inc.k IS NOT NULL THEN inc.name ELSE cur.name END AS name,
      CAST(CASE WHEN inc.k IS NOT NULL THEN inc.bal ELSE cur.bal END AS DOUBLE) AS bal,
      CASE WHEN cur.k IS NULL THEN 'inserted' WHEN inc.k IS NOT NULL THEN 'updated' ELSE 'kept' END AS change FROM cur FULL JOIN inc ON cur.k = inc.k"""
)
def entity_upsert(spark, folder):
    current = D.table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("decimal(28,2)").alias("bal")
    )
    incoming = D.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.when(F.count(F.lit(1)) > 10, "busy").alias("name"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("bal"),
    )
    return H.upsert(current, incoming, "k", ["name", "bal"]).withColumn("bal", F.col("bal").cast("double"))


def _reconcile(spark, folder):
    """Stored sources are customers; the manifest comes from the suppliers."""
    c, s = D.table(spark, folder, "customer"), D.table(spark, folder, "supplier")
    current = c.select(
        F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("owner_id"),
        F.concat(F.lit("u"), "c_custkey").alias("url"), F.sha2(F.col("c_mktsegment"), 256).alias("definition_hash"),
        F.when(F.col("c_acctbal") < 0, "retired").otherwise("active").alias("status"),
        (F.col("c_mktsegment") != "BUILDING").alias("managed"),
    )
    old = c.select(
        F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("owner_id"),
        F.col("c_mktsegment").alias("segment"), "c_acctbal",
    )
    seg = F.when(F.col("s_acctbal") > 5000, F.col("segment")).otherwise("CHANGED")
    manifest = s.join(old, F.col("s_suppkey") == F.col("source_id"), "left").select(
        F.when(F.col("s_nationkey") == 4, F.col("s_suppkey") + 10_000_000_000).otherwise(F.col("s_suppkey")).alias("source_id"),
        F.when(F.col("s_nationkey") == 5, -1).otherwise(F.col("owner_id")).alias("owner_id"),
        F.concat(F.lit("u"), F.when(F.col("s_nationkey") == 4, F.col("s_suppkey") + 10_000_000_000).otherwise(F.col("s_suppkey"))).alias("url"),
        F.sha2(seg, 256).alias("definition_hash"),
    )
    ordinals = D.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(
        F.count(F.lit(1)).alias("last_ordinal")
    )
    return H.reconcile_definitions(manifest, current, ordinals)


_RECONCILE = """man AS (SELECT CASE WHEN s_nationkey = 4 THEN s_suppkey + 10000000000 ELSE s_suppkey END AS sid, CASE WHEN s_nationkey = 5 THEN -1 ELSE c_nationkey END AS own,
   CASE WHEN s_acctbal > 5000 THEN c_mktsegment ELSE 'CHANGED' END AS seg FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey),
ords AS (SELECT o_custkey, count(*) AS lo FROM orders GROUP BY 1),
rec AS (SELECT coalesce(c_custkey, sid) AS source_id, coalesce(lo, 0) AS lo, CASE WHEN sid IS NOT NULL AND c_custkey IS NOT NULL AND own <> c_nationkey THEN 'BENCHMARK_CHANGED' END AS error,
   CASE WHEN sid IS NOT NULL AND c_custkey IS NOT NULL AND own <> c_nationkey THEN 'refused' WHEN c_custkey IS NULL THEN 'created'
     WHEN sid IS NULL AND c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 THEN 'retired' WHEN sid IS NULL THEN 'untouched'
     WHEN seg = c_mktsegment THEN 'unchanged' WHEN c_acctbal < 0 THEN 'reactivated' ELSE 'revised' END AS disposition
  FROM customer FULL JOIN man ON sid = c_custkey LEFT JOIN ords ON o_custkey = coalesce(c_custkey, sid))"""


@query(
    f"""WITH {_RECONCILE} SELECT source_id, disposition, error, CASE WHEN disposition IN ('created', 'retired', 'reactivated', 'revised') THEN lo + 1 ELSE lo END AS ordinal,
    CASE disposition WHEN 'created' THEN 'uncertified_source_revision' WHEN 'revised' THEN 'registry_definition_changed' WHEN 'reactivated' THEN 'source_reintroduced' WHEN 'retired' THEN 'removed_from_registry' END AS decision_reason,
    CASE WHEN disposition = 'retired' THEN 'revoked' WHEN disposition IN ('created', 'revised', 'reactivated') THEN 'quarantined' END AS decision_outcome FROM rec"""
)
def scd_reconcile(spark, folder):
    return _reconcile(spark, folder)


@query(f"WITH {_RECONCILE} SELECT source_id FROM rec WHERE disposition = 'retired'")
def retire_missing(spark, folder):
    return _reconcile(spark, folder).where("disposition = 'retired'").select("source_id")


@query(
    f"""WITH {_RECONCILE} SELECT count(*) FILTER (WHERE disposition <> 'untouched') AS processed, """
    + ", ".join(
        f"count(*) FILTER (WHERE disposition = '{k}') AS {k}"
        for k in ("created", "revised", "reactivated", "retired", "unchanged", "refused")
    )
    + " FROM rec"
)
def reconcile_counters(spark, folder):
    return H.reconcile_counters(_reconcile(spark, folder))


@query(
    f"""WITH {_DECISIONS}, prop AS (SELECT o_orderkey AS entity, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderkey * 8 + o_custkey % 8 END AS supersedes,
      CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS reason_code FROM orders)
    SELECT p.entity, CASE WHEN chain_error IS NOT NULL THEN chain_error WHEN reason_code = ' ' THEN 'REASON_MISSING' WHEN leaf_id IS NULL AND supersedes IS NOT NULL THEN 'FIRST_DECISION_HAS_PARENT'
      WHEN supersedes IS DISTINCT FROM leaf_id THEN 'NOT_ON_EFFECTIVE_DECISION' ELSE 'accepted' END AS verdict FROM prop p LEFT JOIN leaf l ON l.entity = p.entity"""
)
def append_decisions(spark, folder):
    """Each order proposes a next decision on some line number of its own."""
    o = D.table(spark, folder, "orders")
    proposals = o.select(
        F.col("o_orderkey").alias("entity"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey") * 8 + F.col("o_custkey") % 8).alias("supersedes"),
        F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")).alias("reason_code"),
    )
    checked = H.check_appends(proposals, L.effective_leaves(review_decisions(spark, folder)))
    return checked.select("entity", "verdict")


@query(
    """SELECT l_orderkey * 8 + l_linenumber AS receipt, count(*) AS receipts FROM lineitem GROUP BY 1
    HAVING min(sha256(l_returnflag || l_linestatus)) <> max(sha256(l_returnflag || l_linestatus))"""
)
def replay_conflicts(spark, folder):
    receipts = D.table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("receipt"),
        F.sha2(F.concat("l_returnflag", "l_linestatus"), 256).alias("digest"),
    )
    return H.replay_conflicts(receipts, "receipt", "digest")


@query(
    """SELECT 'revisions' AS kind, count(*) AS n, min(id) AS low, max(id) AS high FROM (SELECT 'revision-' || sha256(CAST(s_suppkey AS VARCHAR)) AS id FROM supplier)
    UNION ALL SELECT 'decisions', count(*), min(id), max(id) FROM (SELECT 'decision-' || sha256('revision-' || sha256(CAST(s_suppkey AS VARCHAR))) AS id FROM supplier)
    UNION ALL SELECT 'snapshots', count(*), min(id), max(id) FROM (SELECT 'revision-' || sha256(CAST(s_suppkey AS VARCHAR)) AS id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)
    UNION ALL SELECT 'reviews', count(*), min(id), max(id) FROM (SELECT 'review-' || sha256(CAST(o_orderkey AS VARCHAR)) AS id FROM orders)
    UNION ALL SELECT 'publications', count(*), min(id), max(id) FROM (SELECT 'publication-' || sha256(CAST(o_orderkey AS VARCHAR)) AS id FROM orders)"""
)
def governance_backfill(spark, folder):
    s, li, o = (D.table(spark, folder, t) for t in ("supplier", "lineitem", "orders"))
    sources = s.select(F.col("s_suppkey").alias("source_id"), F.sha2("s_name", 256).alias("definition_hash"))
    snaps = li.select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("snapshot_id"))
    made = H.backfill_history(sources, snaps, o.select(F.col("o_orderkey").alias("claim_id")))
    ids = {"revisions": "revision_id", "decisions": "decision_id", "snapshots": "revision_id", "reviews": "review_id", "publications": "publication_id"}
    out = None
    for kind, col in ids.items():
        part = made[kind].agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).select(
            F.lit(kind).alias("kind"), "n", "low", "high"
        )
        out = part if out is None else out.unionByName(part)
    return out
