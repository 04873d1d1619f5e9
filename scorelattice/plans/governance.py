"""Admission, decision chains, eligibility and feed over the shipped tables.

Customers are snapshots and sources' revisions are nations; an order is a
claim, its line items are the claim's validations and review decisions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import identity_digest
from ..operators import admission as A, feed as E, history as H, lineage as L
from ..session import staged
from . import domain as D
from .registry import query


# --- decision chains from line items -------------------------------------

def review_decisions(spark, folder):
    """One decision per (order, line number); each supersedes the number before.

    Missing numbers break a chain, returned lines skip one back and so branch
    it, and a first line with the top tax rate points at the second: a cycle.
    """
    li = D.table(spark, folder, "lineitem")
    lines = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.max("l_tax").alias("tax"),
        F.min("l_suppkey").alias("supp"), F.min("l_partkey").alias("part"),
        F.min("l_linestatus").alias("ls"), F.min("l_shipdate").alias("at"),
    )
    n = F.col("l_linenumber")
    rid = F.col("l_orderkey") * 8 + n
    parent = (
        F.when((n == 1) & (F.col("tax") == 0.08), rid + 1)
        .when(n == 1, None)
        .when((F.col("flag") == "R") & (n > 2), rid - 2)
        .otherwise(rid - 1)
    )
    return lines.select(
        rid.alias("id"), F.col("l_orderkey").alias("entity"), parent.alias("parent"), n.cast("long").alias("seq"),
        F.when(F.col("flag") == "A", "validation_reviewed").when(F.col("ls") == "F", "identity_resolved")
        .otherwise("validation_reviewed").alias("outcome"),
        F.when(F.col("flag") == "N", F.lpad(F.col("supp").cast("string"), 12, "0")).alias("model_id"),
        F.lit(None).cast("string").alias("benchmark_id"),
        F.when(F.col("tax") >= 0.05, F.col("flag")).alias("metric"),
        F.when(F.col("ls") == "F", "test").alias("split"),
        F.lit(None).cast("string").alias("setting"),
        F.when(n == 2, "v2").alias("evaluation_version"),
        F.col("at").alias("decided_at"),
    )


_DECISIONS = """dec AS (SELECT l_orderkey * 8 + n AS id, l_orderkey AS entity,
   CASE WHEN n = 1 AND tax = 0.08 THEN l_orderkey * 8 + n + 1 WHEN n = 1 THEN NULL
        WHEN flag = 'R' AND n > 2 THEN l_orderkey * 8 + n - 2 ELSE l_orderkey * 8 + n - 1 END AS parent, CAST(n AS BIGINT) AS seq,
   CASE WHEN flag = 'A' THEN 'validation_reviewed' WHEN ls = 'F' THEN 'identity_resolved' ELSE 'validation_reviewed' END AS outcome,
   CASE WHEN flag = 'N' THEN lpad(CAST(supp AS VARCHAR), 12, '0') END AS model_id, CAST(NULL AS VARCHAR) AS benchmark_id,
   CASE WHEN tax >= 0.05 THEN flag END AS metric, CASE WHEN ls = 'F' THEN 'test' END AS split, CAST(NULL AS VARCHAR) AS setting,
   CASE WHEN n = 2 THEN 'v2' END AS evaluation_version, shipped AS decided_at
 FROM (SELECT l_orderkey, l_linenumber AS n, min(l_returnflag) AS flag, max(l_tax) AS tax, min(l_suppkey) AS supp,
              min(l_linestatus) AS ls, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2)),
sup AS (SELECT DISTINCT parent AS id FROM dec WHERE parent IS NOT NULL),
leaves AS (SELECT d.entity, CASE WHEN count(*) FILTER (WHERE d.parent IS NOT NULL AND (p.id IS NULL OR p.entity <> d.entity)) > 0 THEN 'CHAIN_INVALID'
     WHEN count(*) FILTER (WHERE s.id IS NULL) <> 1 THEN 'CHAIN_AMBIGUOUS' WHEN count(*) FILTER (WHERE d.parent IS NULL) = 0 THEN 'CHAIN_CYCLE' END AS chain_error,
     max(CASE WHEN s.id IS NULL THEN d.id END) AS leaf FROM dec d LEFT JOIN dec p ON p.id = d.parent LEFT JOIN sup s ON s.id = d.id GROUP BY d.entity),
leaf AS (SELECT entity, CASE WHEN chain_error IS NULL THEN leaf END AS leaf_id, chain_error FROM leaves)"""
_WALK = """walk AS (SELECT id, id AS root, CAST(0 AS BIGINT) AS depth FROM dec WHERE parent IS NULL
  UNION ALL SELECT d.id, w.root, w.depth + 1 FROM dec d JOIN walk w ON d.parent = w.id)"""


@query(f"WITH {_DECISIONS} SELECT * FROM leaf")
def effective_leaf(spark, folder):
    return L.effective_leaves(review_decisions(spark, folder))


@query(f"WITH RECURSIVE {_DECISIONS}, {_WALK} SELECT * FROM walk")
def chain_walk(spark, folder):
    return L.chain_depths(review_decisions(spark, folder))


_FIELDS = ("model_id", "benchmark_id", "metric", "split", "setting", "evaluation_version")
_CLAIMS = """claims AS (SELECT o_orderkey AS claim_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN lpad(CAST(o_custkey // 15 AS VARCHAR), 12, '0') END AS model_id,
  o_orderpriority AS benchmark_id, CAST(o_orderdate AS VARCHAR) AS metric, o_orderstatus AS split, CAST(NULL AS VARCHAR) AS setting,
  CASE WHEN o_orderstatus = 'F' THEN 'v1' END AS evaluation_version FROM orders)"""
_SPARSE = ", ".join(
    f"arg_max({f}, CASE WHEN {f} IS NOT NULL THEN depth END) FILTER (WHERE {f} IS NOT NULL) AS {f}" for f in _FIELDS
)
_PROJECTED = ", ".join(
    f"CASE WHEN l.chain_error IS NULL THEN coalesce(r.{f}, c.{f}) END AS {f}" for f in _FIELDS
)
_IDENT = f"""rev AS (SELECT entity, {_SPARSE} FROM dec JOIN walk USING (id) GROUP BY entity),
ident AS (SELECT c.claim_id, {_PROJECTED}, l.leaf_id, l.chain_error FROM claims c LEFT JOIN leaf l ON l.entity = c.claim_id LEFT JOIN rev r ON r.entity = c.claim_id)"""


def captured_claims(spark, folder):
    o = D.table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("claim_id"),
        F.when(
            F.col("o_orderpriority") != "1-URGENT",
            F.lpad(F.floor(F.col("o_custkey") / 15).cast("string"), 12, "0"),
        ).alias("model_id"),
        F.col("o_orderpriority").alias("benchmark_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("metric"),
        F.col("o_orderstatus").alias("split"),
        F.lit(None).cast("string").alias("setting"),
        F.when(F.col("o_orderstatus") == "F", "v1").alias("evaluation_version"),
        "o_custkey", "o_totalprice", "o_orderdate",
    )


@query(
    """SELECT o_orderkey AS claim_id, row_number() OVER (ORDER BY CASE WHEN o_orderpriority <> '1-URGENT' THEN lpad(CAST(o_custkey // 15 AS VARCHAR), 12, '0') END NULLS FIRST, o_orderpriority,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'v1' END NULLS FIRST, o_orderkey) AS place FROM orders"""
)
def cell_order(spark, folder):
    """Every claim's place in the order of display cells."""
    return E.in_cell_order(captured_claims(spark, folder), "claim_id").select("claim_id", "place")


def _stated_reviews(spark, folder):
    """What chains, projection and outcomes read of the review decisions, stored once for all of them."""
    return staged(review_decisions(spark, folder).select("id", "entity", "parent", "outcome", *_FIELDS))


def _identities(spark, folder):
    decisions = _stated_reviews(spark, folder)
    return L.project_identity(
        captured_claims(spark, folder), decisions, L.chain_depths(decisions),
        L.effective_leaves(decisions), _FIELDS,
    )


@query(f"WITH RECURSIVE {_DECISIONS}, {_WALK}, {_CLAIMS}, {_IDENT} SELECT * FROM ident")
def sparse_projection(spark, folder):
    return _identities(spark, folder)


@query(
    f"""WITH RECURSIVE {_DECISIONS}, {_WALK} SELECT 'reviews' AS family, count(*) AS n_rows, count(*) FILTER (WHERE d.parent IS NULL) AS roots,
    count(*) FILTER (WHERE d.parent IS NOT NULL AND p.id IS NULL) AS missing_parents, count(*) FILTER (WHERE p.entity <> d.entity) AS crossed_entities,
    count(*) FILTER (WHERE (d.parent IS NULL AND d.seq <> 1) OR (p.id IS NOT NULL AND d.seq <> p.seq + 1)) AS sequence_gaps,
    count(*) FILTER (WHERE d.decided_at < p.decided_at) AS time_reversals,
    (SELECT count(*) FROM (SELECT parent FROM dec WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) > 1)) AS branches, CAST(0 AS BIGINT) AS repeated_ids,
    CAST((SELECT count(*) FROM dec WHERE id NOT IN (SELECT id FROM sup)) AS BIGINT) AS leaves,
    (SELECT count(*) FROM (SELECT entity FROM dec GROUP BY entity HAVING count(*) FILTER (WHERE parent IS NULL) <> 1)) AS bad_roots,
    (SELECT count(*) FROM (SELECT entity FROM dec GROUP BY entity HAVING count(*) FILTER (WHERE id NOT IN (SELECT id FROM sup)) <> 1)) AS bad_leaves,
    (SELECT count(*) FROM dec WHERE id NOT IN (SELECT id FROM walk)) AS off_root
    FROM dec d LEFT JOIN dec p ON p.id = d.parent"""
)
def lineage_audit(spark, folder):
    decisions = review_decisions(spark, folder)
    return L.lineage_audit(
        decisions, "reviews", sequence="seq", time="decided_at", depths=L.chain_depths(decisions)
    )


@query(
    """WITH t AS (SELECT conv_id * 100000 + turn AS id, conv_id AS entity, CASE WHEN turn > 0 THEN conv_id * 100000 + turn - 1 END AS parent, role, text, turn FROM conversations)
    SELECT t.id, t.entity, CASE WHEN t.parent IS NOT NULL AND p.id IS NULL THEN 'PRIOR_REVISION_MISSING'
      WHEN p.id IS NOT NULL AND t.role = 'user' AND p.role <> 'assistant' THEN 'PRIOR_EDITION_MISMATCH'
      WHEN p.id IS NOT NULL AND t.role = 'assistant' AND sha256(t.text) <> sha256(p.text) THEN 'COMPATIBLE_CHANGE_ALTERED_IDENTITY'
      WHEN p.id IS NOT NULL AND t.role <> 'assistant' AND (t.role = p.role OR sha256(t.text) = sha256(p.text)) THEN 'NEW_EDITION_REUSED_IDENTITY' END AS issue
    FROM t LEFT JOIN t p ON p.id = t.parent"""
)
def revision_chain(spark, folder):
    """Turns of a conversation as revisions: the role is the edition."""
    t = D.table(spark, folder, "conversations")
    rid = F.col("conv_id") * 100000 + F.col("turn")
    stated = F.when(F.col("role") == "user", "assistant")
    rows = t.select(
        rid.alias("id"), F.col("conv_id").alias("entity"), F.when(F.col("turn") > 0, rid - 1).alias("parent"),
        F.col("role").alias("edition"), stated.alias("stated_prior_edition"), F.sha2("text", 256).alias("fingerprint"),
        F.when(F.col("role") == "assistant", "display_rename").otherwise("new_edition").alias("change_type"),
        F.when(F.col("role") == "assistant", "same_identity").otherwise("new_edition_identity").alias("disposition"),
    )
    # Replies and instructions state what they replace correctly.
    prior = rows.select(F.col("id").alias("parent"), F.col("edition").alias("prior_edition"))
    told = rows.join(prior, "parent", "left").withColumn(
        "stated_prior_edition", F.coalesce("stated_prior_edition", "prior_edition")
    ).drop("prior_edition")
    return L.revision_chain_issues(told)


_EDGES = """e AS (SELECT DISTINCT a.o_custkey AS src, b.o_custkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1)"""


def follow_edges(spark, folder):
    """Customers linked to the customer of the next order."""
    o = D.table(spark, folder, "orders")
    nxt = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    return o.join(nxt, "o_orderkey").select(F.col("o_custkey").alias("src"), "dst")


#: Nodes with walks of one edge, two edges and so on, until no more drop out.
_WALKS = """r AS (SELECT DISTINCT 1 AS step, src, CAST(9223372036854775807 AS BIGINT) AS before FROM e
     UNION ALL SELECT DISTINCT r.step + 1, e.src, (SELECT count(*) FROM r) FROM r JOIN e ON e.dst = r.src WHERE (SELECT count(*) FROM r) < r.before),
    f AS (SELECT src FROM r WHERE step = (SELECT max(step) FROM r) AND before = (SELECT count(*) FROM r WHERE step = (SELECT max(step) FROM r)))
    SELECT src, dst FROM e WHERE dst IN (SELECT src FROM f)"""
_ORDER_EDGES = """t AS (SELECT o_orderkey AS src, unnest([o_orderkey + o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN o_orderkey - o_custkey * 5 WHEN '2-HIGH' THEN o_orderkey + 1 END]) AS dst FROM orders),
   e AS (SELECT DISTINCT src, dst FROM t WHERE dst IN (SELECT o_orderkey FROM orders))"""


def order_edges(spark, folder):
    """Every order refers to a later one, urgent ones to an earlier one as well, high ones to their neighbour."""
    o = D.table(spark, folder, "orders")
    key, cust, priority = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    also = F.when(priority == "1-URGENT", key - cust * 5).when(priority == "2-HIGH", key + 1)
    edges = o.select(key.alias("src"), F.explode(F.array(key + cust, also)).alias("dst"))
    return edges.join(o.select(key.alias("dst")), "dst", "left_semi").select("src", "dst")


@query(
    f"""WITH RECURSIVE {_ORDER_EDGES}, {_WALKS}"""
)
def order_cycles(spark, folder):
    """References between orders that lie on a cycle or lead to one; others run out."""
    return L.cyclic_edges(order_edges(spark, folder))


@query(
    f"""WITH RECURSIVE {_EDGES}, {_WALKS}"""
)
def graph_cycles(spark, folder):
    """Edges that lie on a cycle or lead to one."""
    return L.cyclic_edges(follow_edges(spark, folder))


@query(
    f"""WITH {_EDGES} SELECT src, dst, 'base_model' AS role, CASE WHEN c_mktsegment = 'BUILDING' THEN 'harness' ELSE 'system' END AS dst_kind FROM e JOIN customer ON c_custkey = dst
      WHERE src % 3 > 0 AND c_mktsegment <> 'MACHINERY'"""
)
def component_kinds(spark, folder):
    """Edges that name a base model as their target, where the target is none."""
    edges = follow_edges(spark, folder).distinct().withColumn("role", F.when(F.col("src") % 3 > 0, "base_model").otherwise("tool"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "harness").when(F.col("c_mktsegment") == "MACHINERY", "base_model").otherwise("system")
    subjects = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("subject"), kind.alias("kind"))
    return L.component_issues(edges, subjects).select("src", "dst", "role", "dst_kind")


_PUBS = """pub AS (SELECT o_orderkey AS id, o_orderkey AS entity, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey * 8 + m END AS review_id,
   CASE WHEN o_orderpriority = '5-LOW' THEN 'quarantined' ELSE 'approved' END AS outcome, o_orderdate AS decided_at
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def publications(spark, folder):
    """One publication per order, of the review with the order's last line number."""
    last = D.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m"))
    o = D.table(spark, folder, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("entity"), F.lit(None).cast("long").alias("parent"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") * 8 + F.col("m")).alias("review_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "quarantined").otherwise("approved").alias("outcome"),
        F.col("o_orderdate").alias("decided_at"),
    )


@query(
    f"""WITH {_DECISIONS}, {_PUBS} SELECT p.id, CASE WHEN d.id IS NULL THEN 'REVIEW_MISSING' WHEN p.decided_at < d.decided_at THEN 'PUBLISHED_BEFORE_REVIEW' END AS issue
    FROM pub p LEFT JOIN dec d ON d.id = p.review_id"""
)
def cross_lineage(spark, folder):
    issues = L.cross_lineage_issues(publications(spark, folder), review_decisions(spark, folder))
    return issues.select("id", "issue")


# --- eligibility and feed -------------------------------------------------

def judged_claims(spark, folder):
    """Every order through the whole eligibility cascade."""
    c = D.table(spark, folder, "customer")
    nation = D.table(spark, folder, "nation")
    li = D.table(spark, folder, "lineitem")
    source_decisions = nation.select(
        F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("entity"), F.lit(None).cast("int").alias("parent"),
        F.when(F.col("n_regionkey") == 4, "quarantined").otherwise("certified").alias("outcome"),
        (F.col("n_nationkey") != 7).alias("policy_complete"),
    )
    revisions = nation.select(
        F.col("n_nationkey").alias("revision_id"), F.col("n_nationkey").alias("source_id"),
        F.sha2("n_name", 256).alias("definition_hash"),
    )
    sources = nation.select(F.col("n_nationkey").alias("source_id"))
    snapshots = c.select(
        F.col("c_custkey").alias("snapshot_id"), F.col("c_nationkey").alias("source_id"),
        F.col("c_nationkey").alias("revision_id"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "").otherwise(F.sha2("c_name", 256)).alias("content_hash"),
        F.when(F.col("c_acctbal") > -900, F.col("c_acctbal")).alias("captured_at"),
    )
    captured = captured_claims(spark, folder).join(
        c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")
    )
    claims = captured.select(
        "claim_id", F.col("c_nationkey").alias("source_id"), F.col("o_custkey").alias("snapshot_id"),
        F.when(F.col("o_totalprice") > 5000, F.col("c_nationkey")).alias("decision_id"),
        F.col("benchmark_id").alias("benchmark_raw"), F.lit("m").alias("model_raw"),
        F.col("o_totalprice").cast("string").alias("score_raw"), F.lit("json_parser").alias("capture_method"),
        F.when(F.col("o_totalprice") < 490000, F.col("o_totalprice")).otherwise(float("nan")).alias("score_numeric"),
        F.lit("json_path_v1").alias("locator_type"), (F.col("o_totalprice") < 480000).alias("locator_ok"),
    )
    validations = li.select(
        F.col("l_orderkey").alias("claim_id"),
        F.when((F.col("l_discount") == 0.1) & (F.col("l_returnflag") == "R"), "fail").otherwise("pass").alias("outcome"),
    )
    reviews = _stated_reviews(spark, folder)
    leaves = L.effective_leaves(reviews)
    pubs = publications(spark, folder)
    identities = L.project_identity(
        captured_claims(spark, folder), reviews, L.chain_depths(reviews), leaves, _FIELDS
    )
    context = E.claim_context(
        claims, snapshots, revisions, sources, source_decisions, L.effective_leaves(source_decisions),
        validations, reviews, leaves, pubs, L.effective_leaves(pubs), identities,
        D.models(spark, folder), D.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("benchmark_id")),
    )
    # Verdicts are stored before anything filters on them, so that the rule chain
    # is planned and evaluated once.
    return staged(E.eligibility(context).select("claim_id", "source_id", "snapshot_id", *E.CELL, "reason"))


_JUDGED = f"""{_DECISIONS}, {_WALK}, {_CLAIMS}, {_IDENT}, {_PUBS},
val AS (SELECT l_orderkey AS claim_id, count(*) AS v, count(*) FILTER (WHERE l_discount = 0.1 AND l_returnflag = 'R') AS bad FROM lineitem GROUP BY 1),
judged AS (SELECT c.claim_id, n.n_nationkey AS source_id, o_custkey AS snapshot_id, i.model_id, i.benchmark_id, i.metric, i.split, i.setting, i.evaluation_version,
  CASE WHEN o_totalprice <= 5000 THEN 'SOURCE_DECISION_MISSING' WHEN n_regionkey = 4 THEN 'SOURCE_DECISION_NOT_CERTIFIED'
    WHEN n_nationkey = 7 THEN 'SOURCE_CERTIFICATION_POLICY_INVALID' WHEN c_mktsegment = 'MACHINERY' THEN 'SNAPSHOT_HASH_INVALID'
    WHEN c_acctbal <= -900 THEN 'SNAPSHOT_CAPTURE_TIME_MISSING' WHEN v IS NULL THEN 'VALIDATION_MISSING' WHEN bad > 0 THEN 'VALIDATION_NOT_ALL_PASS'
    WHEN i.chain_error IS NOT NULL THEN 'REVIEW_CHAIN_INVALID' WHEN d.outcome <> 'validation_reviewed' THEN 'REVIEW_NOT_VALIDATION_REVIEWED'
    WHEN i.model_id IS NULL OR i.benchmark_id IS NULL THEN 'DISPLAY_IDENTITY_UNRESOLVED'
    WHEN p.outcome <> 'approved' OR p.review_id IS NULL OR p.review_id <> i.leaf_id THEN 'PUBLICATION_NOT_APPROVED'
    WHEN o_totalprice >= 490000 THEN 'SCORE_NOT_FINITE_NUMERIC' WHEN o_totalprice >= 480000 THEN 'EVIDENCE_LOCATION_CONTRACT_MISMATCH'
    WHEN i.model_id NOT IN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 12, '0') FROM supplier) THEN 'DISPLAY_IDENTITY_MISSING' END AS reason
  FROM claims c JOIN orders o ON o_orderkey = c.claim_id JOIN customer ON c_custkey = o_custkey JOIN nation n ON n_nationkey = c_nationkey
  JOIN ident i ON i.claim_id = c.claim_id LEFT JOIN val ON val.claim_id = c.claim_id LEFT JOIN dec d ON d.id = i.leaf_id LEFT JOIN pub p ON p.entity = c.claim_id),
elig AS (SELECT *, count(*) OVER (PARTITION BY model_id, benchmark_id, metric, split, setting, evaluation_version) AS k FROM judged WHERE reason IS NULL)"""


@query(f"WITH RECURSIVE {_JUDGED} SELECT claim_id, reason FROM judged")
def claim_eligibility(spark, folder):
    return judged_claims(spark, folder).select("claim_id", "reason")


@query(f"WITH RECURSIVE {_JUDGED} SELECT claim_id, model_id, benchmark_id, metric, split, setting, evaluation_version, k AS claims_in_cell FROM elig WHERE k > 1")
def display_conflicts(spark, folder):
    eligible = judged_claims(spark, folder).where("reason is null")
    return E.cell_conflicts(eligible).select("claim_id", *E.CELL, "claims_in_cell")


@query(
    f"""WITH RECURSIVE {_JUDGED}, disp AS (SELECT 'omitted' AS disposition, reason AS omission_reason FROM judged WHERE reason IS NOT NULL
      UNION ALL SELECT CASE WHEN k > 1 THEN 'conflicted' ELSE 'candidate' END, CASE WHEN k > 1 THEN 'DISPLAY_CELL_CONFLICT' END FROM elig)
    SELECT disposition, omission_reason, count(*) AS n FROM disp GROUP BY ALL"""
)
def claim_dispositions(spark, folder):
    disposed = E.dispositions(judged_claims(spark, folder))
    return disposed.groupBy("disposition", "omission_reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH RECURSIVE {_JUDGED}, s AS (SELECT * FROM elig WHERE k = 1) SELECT count(*) AS score_count, count(DISTINCT model_id) AS model_count,
    count(DISTINCT benchmark_id) AS benchmark_count, count(DISTINCT snapshot_id) AS source_snapshot_count,
    CAST(CASE WHEN (SELECT count(*) FROM elig WHERE k > 1) > 0 THEN 0 ELSE count(*) END AS BIGINT) AS strict_count FROM s"""
)
def feed_projection(spark, folder):
    """Counts of the conflict-free preview, and what the strict feed would hold."""
    eligible = judged_claims(spark, folder).where("reason is null")
    strict = E.feed_scores(eligible).agg(F.count(F.lit(1)).alias("n")).scalar()
    return E.feed_counts(E.without_conflicts(eligible)).withColumn("strict_count", strict)


@query(
    f"""WITH RECURSIVE {_JUDGED}, s AS (SELECT * FROM elig WHERE k = 1), m AS (SELECT model_id FROM ({D.CTES['models'].split('AS (', 1)[1].rsplit(')', 1)[0]})),
    b AS (SELECT DISTINCT o_orderpriority AS benchmark_id FROM orders), f AS (SELECT DISTINCT c_nationkey AS source_id, c_custkey AS snapshot_id FROM customer)
    SELECT 'MODEL_ID_REPEATED' AS code, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'BENCHMARK_ID_REPEATED', 0
    UNION ALL SELECT 'SCORE_MODEL_MISSING', count(*) FROM s WHERE model_id NOT IN (SELECT model_id FROM m)
    UNION ALL SELECT 'SCORE_BENCHMARK_MISSING', count(*) FROM s WHERE benchmark_id NOT IN (SELECT benchmark_id FROM b)
    UNION ALL SELECT 'MODEL_UNREFERENCED', count(*) FROM m WHERE model_id NOT IN (SELECT model_id FROM s)
    UNION ALL SELECT 'BENCHMARK_UNREFERENCED', count(*) FROM b WHERE benchmark_id NOT IN (SELECT benchmark_id FROM s)
    UNION ALL SELECT 'SCORE_PROVENANCE_MISSING', count(*) FROM s WHERE snapshot_id NOT IN (SELECT snapshot_id FROM f)
    UNION ALL SELECT 'MANIFEST_UNREFERENCED', count(*) FROM f WHERE snapshot_id NOT IN (SELECT snapshot_id FROM s)
    UNION ALL SELECT 'CLAIM_REPEATED', 0 UNION ALL SELECT 'PAIR_REPEATED', count(*) FROM (SELECT 1 FROM s GROUP BY model_id, benchmark_id HAVING count(*) > 1)
    UNION ALL SELECT 'CLAIM_SELECTED_AND_EXCLUDED', 0"""
)
def feed_validation(spark, folder):
    judged = judged_claims(spark, folder)
    scores = staged(E.without_conflicts(judged.where("reason is null")))
    b = D.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("benchmark_id")).distinct()
    manifest = D.table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("source_id"), F.col("c_custkey").alias("snapshot_id")
    )
    return E.feed_issues(
        scores, D.models(spark, folder).select("model_id"), b, manifest, judged.where("reason is not null")
    )


@query(
    """SELECT claim_id, issue FROM (SELECT coalesce(c.k, s.k) AS claim_id, CASE WHEN c.k IS NULL THEN 'STORED_WITHOUT_CANDIDATE' WHEN s.k IS NULL THEN 'CANDIDATE_WITHOUT_STORED'
      WHEN c.a IS DISTINCT FROM s.a OR c.b <> s.b THEN 'FIELDS_DIFFER' END AS issue
    FROM (SELECT o_orderkey AS k, o_custkey AS a, o_orderstatus AS b FROM orders WHERE o_orderpriority <> '5-LOW') c
    FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 100000 THEN o_custkey END AS a, o_orderstatus AS b FROM orders WHERE o_orderstatus <> 'P') s ON c.k = s.k) WHERE issue IS NOT NULL"""
)
def release_binding(spark, folder):
    o = D.table(spark, folder, "orders")
    candidates = o.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")
    )
    stored = o.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("claim_id"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_custkey")).alias("a"), F.col("o_orderstatus").alias("b"),
    )
    return E.release_mismatches(candidates, stored, ["a", "b"])


@query(
    """SELECT o_orderkey AS pos FROM (SELECT o_orderkey, o_orderstatus AS a, o_totalprice AS b, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS pk,
      lag(o_orderstatus) OVER (ORDER BY o_orderkey) AS pa, lag(o_totalprice) OVER (ORDER BY o_orderkey) AS pb FROM orders)
    WHERE pk = o_orderkey - 1 AND NOT (pa < a OR (pa = a AND pb < b))"""
)
def order_breaks(spark, folder):
    o = D.table(spark, folder, "orders").withColumn("pos", F.col("o_orderkey"))
    return E.order_breaks(o, "pos", [F.col("o_orderstatus"), F.col("o_totalprice")])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN s_nationkey = 3 THEN 'differs' ELSE 'verified' END AS evidence
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal >= 0) ON l_suppkey = s_suppkey"""
)
def evidence_lookup(spark, folder):
    s = D.table(spark, folder, "supplier")
    name = F.concat(F.lit("source "), F.col("manifest_key"))
    manifest = s.where("s_acctbal >= 0").withColumn("manifest_key", F.col("s_suppkey")).select(
        "manifest_key", F.when(F.col("s_nationkey") == 3, "renamed").otherwise(name).alias("source_name")
    )
    scores = D.table(spark, folder, "lineitem").withColumn("manifest_key", F.col("l_suppkey")).withColumn(
        "source_name", name
    )
    found = E.evidence_lookup(scores, manifest, ["source_name"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "evidence")
