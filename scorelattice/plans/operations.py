"""Schedules, incidents, attempts and runs over the shipped tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.digests import derived_id
from ..functions.timegrid import epoch_micros, epoch_seconds
from ..operators import ops as O
from ..operators.ordering import sequential_position
from . import domain as D
from .registry import query
from .scalars import ANCHOR, CADENCE

_TARGETS = """tgt AS (SELECT c_custkey AS target_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'P1D' WHEN 'MACHINERY' THEN 'PT12H' WHEN 'FURNITURE' THEN 'P1DT12H' ELSE 'P7D' END AS cadence,
  CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 3 ELSE 14 END AS k,
  CASE c_nationkey WHEN 0 THEN 'draft' WHEN 1 THEN 'paused' WHEN 2 THEN 'blocked_terms' WHEN 3 THEN 'blocked_permission' WHEN 4 THEN 'retired' ELSE 'configured' END AS status FROM customer),
plan AS (SELECT target_id, slot, CASE WHEN status IN ('draft', 'paused', 'blocked_terms', 'blocked_permission') THEN 'blocked' WHEN status = 'configured' AND slot % k = 0 THEN 'due' ELSE 'not_due' END AS disposition,
  CASE status WHEN 'draft' THEN 'SOURCE_POLICY_BLOCKED' WHEN 'paused' THEN 'OPERATOR_PAUSED' WHEN 'blocked_terms' THEN 'TERMS_POLICY_BLOCKED' WHEN 'blocked_permission' THEN 'TERMS_POLICY_BLOCKED'
    WHEN 'configured' THEN CASE WHEN slot % k = 0 THEN 'DUE_BY_SCHEDULE' ELSE 'NOT_DUE_BY_POLICY' END ELSE 'NOT_DUE_BY_POLICY' END AS reason_code
  FROM tgt, (SELECT unnest(range(0, 14)) AS slot))"""


def targets(spark, folder):
    c = D.spread_table(spark, folder, "customer")
    seg, n = F.col("c_mktsegment"), F.col("c_nationkey")
    status = F.when(n == 0, "draft").when(n == 1, "paused").when(n == 2, "blocked_terms").when(
        n == 3, "blocked_permission").when(n == 4, "retired").otherwise("configured")
    return c.select(
        F.col("c_custkey").alias("target_id"),
        F.when(seg == "BUILDING", "P1D").when(seg == "MACHINERY", "PT12H").when(seg == "FURNITURE", "P1DT12H")
        .otherwise("P7D").alias("cadence"),
        status.alias("status"),
    )


def plan(spark, folder):
    """A week of 12-hour slots."""
    return O.due_plan(targets(spark, folder), 0, 13, CADENCE)


@query(f"WITH {_TARGETS} SELECT target_id, slot, disposition, reason_code FROM plan")
def due_plan(spark, folder):
    return plan(spark, folder)


_JOBS = f"""{_TARGETS}, job AS (SELECT *, 'cycle-' || sha256('prod' || chr(31) || 'recheck' || chr(31) || CAST({ANCHOR} + slot * {CADENCE} AS VARCHAR)) AS cycle_id FROM plan),
jobid AS (SELECT *, 'job-' || sha256(cycle_id || chr(31) || CAST(target_id AS VARCHAR)) AS job_id FROM job)"""


def multiset_sql(source: str, groups: str, line: str, count: str, digest: str) -> str:
    """The additive multiset hash spelled in SQL."""
    sums = ", ".join(
        f"sum(CAST('0x' || substr(h, {1 + i * 15}, 15) AS BIGINT)) AS s{i}" for i in range(4)
    )
    parts = " || ':' || ".join(f"CAST(coalesce(s{i}, 0) AS VARCHAR)" for i in range(4))
    lead = f"{groups}, " if groups else ""
    group_by = f"GROUP BY {groups}" if groups else ""
    return (
        f"SELECT {lead}n AS {count}, sha256(CAST(n AS VARCHAR) || ':' || {parts}) AS {digest} FROM "
        f"(SELECT {lead}count(*) AS n, {sums} FROM (SELECT {lead}sha256({line}) AS h FROM {source}) {group_by})"
    )


@query(
    f"""WITH {_JOBS}, sen AS ({multiset_sql('jobid', 'cycle_id', 'job_id', 'job_count', 'job_digest')})
    SELECT *, CAST(0 AS BIGINT) AS repeated_jobs FROM sen"""
)
def cycle_fanout(spark, folder):
    jobs = O.cycle_jobs(plan(spark, folder), "prod", "recheck", ANCHOR, CADENCE)
    return O.cycle_sentinels(jobs)


@query(
    f"""WITH {_JOBS} SELECT cycle_id FROM jobid GROUP BY cycle_id HAVING count(*) FILTER (WHERE disposition = 'due' AND slot >= 7) > 0"""
)
def cycle_replay(spark, folder):
    """Cycles planned again without the due jobs of the later slots differ."""
    jobs = O.cycle_jobs(plan(spark, folder), "prod", "recheck", ANCHOR, CADENCE)
    stored = O.cycle_sentinels(jobs.where("disposition <> 'due' OR slot < 7"))
    return O.replay_differences(jobs, stored).select("cycle_id")


_TERMINAL = """CASE WHEN due = 'not_due' THEN 'not_due' WHEN due = 'blocked' THEN 'operator_paused' WHEN o_orderstatus = 'F' THEN 'completed_changed'
  WHEN o_orderstatus = 'O' THEN 'completed_with_review' WHEN o_totalprice > 400000 THEN 'mislabelled' ELSE 'retry_exhausted' END"""
_CJOBS = f"""cj AS (SELECT *, {_TERMINAL} AS terminal FROM (SELECT o.*, o_custkey AS cycle_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'not_due' WHEN '2-HIGH' THEN 'blocked' ELSE 'due' END AS due FROM orders o))"""


def scheduled_jobs(spark, folder):
    """Orders as jobs of their customer's cycle."""
    o = D.table(spark, folder, "orders")
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    due = F.when(p == "1-URGENT", "not_due").when(p == "2-HIGH", "blocked").otherwise("due")
    terminal = (
        F.when(due == "not_due", "not_due").when(due == "blocked", "operator_paused")
        .when(s == "F", "completed_changed").when(s == "O", "completed_with_review")
        .when(F.col("o_totalprice") > 400000, "mislabelled").otherwise("retry_exhausted")
    )
    return o.select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("cycle_id"), due.alias("due"), terminal.alias("terminal"),
        "o_orderdate", "o_totalprice",
    )


@query(
    f"""WITH {_CJOBS} SELECT *, expected = due + not_due + blocked AND due = succeeded + review_required + failed AS balanced FROM (
      SELECT cycle_id, count(*) AS expected, count(*) FILTER (WHERE due = 'due') AS due, count(*) FILTER (WHERE due = 'not_due') AS not_due, count(*) FILTER (WHERE due = 'blocked') AS blocked,
      count(*) FILTER (WHERE terminal = 'completed_changed') AS succeeded, count(*) FILTER (WHERE terminal = 'completed_with_review') AS review_required,
      count(*) FILTER (WHERE terminal = 'retry_exhausted') AS failed FROM cj GROUP BY cycle_id)"""
)
def cycle_counts(spark, folder):
    return O.cycle_counts(scheduled_jobs(spark, folder))


def _cycles(spark, folder):
    o = D.table(spark, folder, "orders")
    return o.select(
        F.col("o_orderstatus").alias("environment"), F.col("o_orderpriority").alias("lane"),
        epoch_seconds(F.col("o_orderdate")).alias("scheduled_for"),
        F.col("o_orderkey").alias("cycle_id"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("content_digest"),
    )


_CYCLES = """cyc AS (SELECT o_orderstatus AS environment, o_orderpriority AS lane, CAST(epoch(o_orderdate) AS BIGINT) AS scheduled_for, o_orderkey AS cycle_id,
  sha256(CAST(o_custkey AS VARCHAR)) AS content_digest FROM orders)"""


@query(
    f"""WITH {_CYCLES}, ws AS ({multiset_sql('cyc', 'environment, lane', "CAST(cycle_id AS VARCHAR) || '|' || CAST(scheduled_for AS VARCHAR) || '|' || content_digest", 'cycles', 'set_digest')}),
    e AS (SELECT *, row_number() OVER (PARTITION BY environment, lane ORDER BY scheduled_for, cycle_id) AS a, row_number() OVER (PARTITION BY environment, lane ORDER BY scheduled_for DESC, cycle_id DESC) AS z FROM cyc)
    SELECT environment, lane, min(scheduled_for) AS earliest, max(CASE WHEN a = 1 THEN cycle_id END) AS earliest_id, max(scheduled_for) AS latest,
      max(CASE WHEN z = 1 THEN cycle_id END) AS latest_id, max(CASE WHEN z = 1 THEN content_digest END) AS latest_digest, any_value(cycles) AS cycles, any_value(set_digest) AS set_digest
    FROM e JOIN ws USING (environment, lane) GROUP BY environment, lane"""
)
def lane_watermarks(spark, folder):
    return O.lane_watermarks(_cycles(spark, folder))


@query(
    f"""WITH {_CYCLES}, m AS (SELECT lane, max(scheduled_for) AS scheduled_for FROM cyc GROUP BY lane)
    SELECT lane, scheduled_for, CASE WHEN count(*) = 1 THEN min(cycle_id) END AS cycle_id, count(*) = 1 AS unambiguous FROM cyc JOIN m USING (lane, scheduled_for) GROUP BY ALL"""
)
def latest_cycle(spark, folder):
    return O.latest_cycles(_cycles(spark, folder))


# --- incidents --------------------------------------------------------------

_STEPS = ("OPENED", "ACKNOWLEDGED", "INVESTIGATION_STARTED", "MITIGATED", "RESOLVED", "CLOSED", "REOPENED")
_WSTEPS = ("CREATED", "CLAIMED", "DEFERRED", "RESOLVED", "REOPENED")


def _numbered(spark, folder):
    ev = D.table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", epoch_micros(F.col("ts")).alias("at")
    )
    numbered = sequential_position(ev, ["user_id"], [F.col("at"), F.col("event_id")], "ordinal")
    return O.with_prior(numbered, "user_id", "ordinal", ["event_id"])


def incident_events(spark, folder):
    """A user's events as steps of one incident; views misstate their predecessor."""
    ev = _numbered(spark, folder)
    step = F.get(F.array(*[F.lit(s) for s in _STEPS]), ((F.col("ordinal") - 1) % 7).cast("int"))
    kind = F.when(F.col("event_type") == "error", "OCCURRENCE_RECORDED").otherwise(step)
    leaves = F.create_map(*[F.lit(x) for x in (
        "ACKNOWLEDGED", "OPEN", "INVESTIGATION_STARTED", "ACKNOWLEDGED", "MITIGATED", "INVESTIGATING",
        "RESOLVED", "MITIGATED", "CLOSED", "RESOLVED", "REOPENED", "CLOSED", "OCCURRENCE_RECORDED", "OPEN")])
    enters = F.create_map(*[F.lit(x) for x in (
        "OPENED", "OPEN", "ACKNOWLEDGED", "ACKNOWLEDGED", "INVESTIGATION_STARTED", "INVESTIGATING", "MITIGATED", "MITIGATED",
        "RESOLVED", "RESOLVED", "CLOSED", "CLOSED", "REOPENED", "OPEN", "OCCURRENCE_RECORDED", "OPEN")])
    return ev.select(
        F.col("user_id").alias("entity"), "ordinal", "event_id",
        F.when(F.col("event_type") == "view", F.col("event_id") - 1).otherwise(F.col("p_event_id")).alias("prior_event_id"),
        kind.alias("event_type"), leaves[kind].alias("from_state"), enters[kind].alias("to_state"),
        (F.col("at") - F.when(F.col("event_type") == "signup", 86_400_000_000).otherwise(0)).alias("occurred_at"),
    )


_INC = f"""num AS (SELECT *, epoch_us(ts) AS at_us, row_number() OVER w AS ordinal, lag(event_id) OVER w AS lag_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
inc0 AS (SELECT user_id AS entity, ordinal, event_id, CASE WHEN event_type = 'view' THEN event_id - 1 ELSE lag_id END AS prior_event_id,
   CASE WHEN event_type = 'error' THEN 'OCCURRENCE_RECORDED' ELSE ({list(_STEPS)})[(ordinal - 1) % 7 + 1] END AS event_type,
   at_us - CASE WHEN event_type = 'signup' THEN 86400000000 ELSE 0 END AS occurred_at FROM num),
inc AS (SELECT *, CASE event_type WHEN 'ACKNOWLEDGED' THEN 'OPEN' WHEN 'INVESTIGATION_STARTED' THEN 'ACKNOWLEDGED' WHEN 'MITIGATED' THEN 'INVESTIGATING' WHEN 'RESOLVED' THEN 'MITIGATED'
     WHEN 'CLOSED' THEN 'RESOLVED' WHEN 'REOPENED' THEN 'CLOSED' WHEN 'OCCURRENCE_RECORDED' THEN 'OPEN' END AS from_state,
   CASE event_type WHEN 'OPENED' THEN 'OPEN' WHEN 'REOPENED' THEN 'OPEN' WHEN 'OCCURRENCE_RECORDED' THEN 'OPEN' WHEN 'INVESTIGATION_STARTED' THEN 'INVESTIGATING' ELSE event_type END AS to_state FROM inc0),
incl AS (SELECT *, lag(event_id) OVER v AS p_id, lag(to_state) OVER v AS p_state, lag(occurred_at) OVER v AS p_at FROM inc WINDOW v AS (PARTITION BY entity ORDER BY ordinal))"""


@query(
    f"""WITH {_INC} SELECT entity, ordinal, event_id, CASE WHEN prior_event_id IS DISTINCT FROM p_id THEN 'PRIOR_EVENT_MISMATCH'
      WHEN event_type = 'OCCURRENCE_RECORDED' AND coalesce(p_state, 'RESOLVED') <> 'OPEN' THEN 'ILLEGAL_TRANSITION'
      WHEN from_state IS DISTINCT FROM p_state THEN 'STATE_DISCONTINUITY' WHEN occurred_at < p_at THEN 'TIME_REVERSED' END AS issue FROM incl"""
)
def incident_audit(spark, folder):
    issues = O.step_issues(incident_events(spark, folder), O.INCIDENT_STEPS, "OCCURRENCE_RECORDED")
    return issues.select("entity", "ordinal", "event_id", "issue")


_FOLD = f"""{_INC}, re AS (SELECT entity, max(CASE WHEN event_type = 'REOPENED' THEN ordinal END) AS r FROM inc GROUP BY entity),
fold AS (SELECT entity, count(*) AS events, arg_max(to_state, ordinal) AS state, count(*) FILTER (WHERE event_type IN ('OPENED', 'REOPENED', 'OCCURRENCE_RECORDED')) AS occurrences,
   arg_min(occurred_at, ordinal) FILTER (WHERE event_type IN ('OPENED', 'REOPENED', 'OCCURRENCE_RECORDED')) AS first_at, arg_max(occurred_at, ordinal) FILTER (WHERE event_type IN ('OPENED', 'REOPENED', 'OCCURRENCE_RECORDED')) AS last_at,
   arg_max(occurred_at, ordinal) FILTER (WHERE event_type IN ('OPENED', 'REOPENED')) AS episode_at,
   arg_max(occurred_at, ordinal) FILTER (WHERE event_type = 'ACKNOWLEDGED' AND ordinal > coalesce(r, 0)) AS acknowledged_at,
   arg_max(occurred_at, ordinal) FILTER (WHERE event_type = 'MITIGATED' AND ordinal > coalesce(r, 0)) AS mitigated_at FROM inc JOIN re USING (entity) GROUP BY entity)"""


@query(f"WITH {_FOLD} SELECT * FROM fold")
def incident_fold(spark, folder):
    return O.incident_fold(incident_events(spark, folder))


@query(
    f"""WITH {_FOLD}, s AS (SELECT *, 'SEV' || entity % 4 AS severity, CASE entity % 4 WHEN 0 THEN 900 WHEN 1 THEN 1800 END AS a, CASE entity % 4 WHEN 0 THEN 3600 WHEN 1 THEN 14400 END AS m FROM fold)
    SELECT entity, severity, episode_at // 1000000 + a AS acknowledge_due, acknowledged_at // 1000000 <= episode_at // 1000000 + a AS acknowledged_on_time,
      episode_at // 1000000 + m AS mitigate_due, mitigated_at // 1000000 <= episode_at // 1000000 + m AS mitigated_on_time FROM s"""
)
def sla_assess(spark, folder):
    folded = O.incident_fold(incident_events(spark, folder))
    seconds = folded.select(
        "entity", F.concat(F.lit("SEV"), F.col("entity") % 4).alias("severity"),
        *[F.floor(F.col(c) / 1_000_000).alias(c) for c in ("episode_at", "acknowledged_at", "mitigated_at")],
    )
    return O.sla_assessment(seconds).select(
        "entity", "severity", "acknowledge_due", "acknowledged_on_time", "mitigate_due", "mitigated_on_time"
    )


@query(
    f"""WITH num AS (SELECT *, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal FROM events),
    w AS (SELECT user_id AS entity, ordinal, at_us, ({list(_WSTEPS)})[(ordinal - 1) % 5 + 1] AS event_type FROM num), l AS (SELECT entity, count(*) AS events, max(ordinal) AS ordinal FROM w GROUP BY entity)
    SELECT entity, events, CASE WHEN event_type IN ('CREATED', 'REOPENED') THEN 'OPEN' ELSE event_type END AS state, CASE WHEN event_type = 'DEFERRED' THEN at_us + 3600000000 END AS next_review_at,
      CASE WHEN event_type = 'RESOLVED' THEN at_us END AS terminal_at FROM w JOIN l USING (entity, ordinal)"""
)
def work_item_fold(spark, folder):
    ev = _numbered(spark, folder)
    step = F.get(F.array(*[F.lit(s) for s in _WSTEPS]), ((F.col("ordinal") - 1) % 5).cast("int"))
    enters = O.text_map({k: v[1] for k, v in O.WORK_STEPS.items()})
    events = ev.select(
        F.col("user_id").alias("entity"), "ordinal", step.alias("event_type"), enters[step].alias("to_state"),
        F.col("at").alias("occurred_at"), F.when(step == "DEFERRED", F.col("at") + 3_600_000_000).alias("next_review_at"),
    )
    return O.work_fold(events)


@query(
    """SELECT event_id, def AS default_severity, CASE WHEN def IS NULL THEN 'FAMILY_UNKNOWN' WHEN NOT coalesce(list_contains(codes, code), false) THEN 'CODE_UNKNOWN' WHEN b AND sev <> def THEN 'NOT_THE_DEFAULT' WHEN NOT b AND dec IS NULL THEN 'ESCALATION_WITHOUT_DECISION'
      WHEN NOT b AND sev >= def THEN 'ESCALATION_NOT_MORE_SEVERE' END AS issue FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'SEV0' WHEN 'view' THEN 'SEV1' WHEN 'error' THEN 'SEV2' WHEN 'purchase' THEN 'SEV3' END AS def,
      CASE event_type WHEN 'click' THEN ['UNSAFE_EGRESS'] WHEN 'view' THEN ['UNAVAILABLE', 'RESTORE_FAILED'] WHEN 'error' THEN ['TRANSIENT'] WHEN 'purchase' THEN ['MODEL_AMBIGUOUS'] END AS codes,
      CASE event_id % 6 WHEN 0 THEN 'UNSAFE_EGRESS' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'TRANSIENT' WHEN 3 THEN 'MODEL_AMBIGUOUS' WHEN 4 THEN 'RESTORE_FAILED' END AS code,
      'SEV' || user_id % 4 AS sev, value < 20 AS b, CASE WHEN value >= 20 AND user_id % 3 > 0 THEN 'd' || user_id END AS dec FROM events)"""
)
def severity_rules(spark, folder):
    families = O.text_map({"click": "SECURITY", "view": "DATABASE", "error": "FETCH", "purchase": "IDENTITY", "signup": "OTHER"})
    codes = F.array(*[F.lit(c) for c in ("UNSAFE_EGRESS", "UNAVAILABLE", "TRANSIENT", "MODEL_AMBIGUOUS", "RESTORE_FAILED")])
    basis = F.when(F.col("value") < 20, "taxonomy_default").otherwise("escalated_by_decision")
    incidents = D.table(spark, folder, "events").select(
        "event_id", families[F.col("event_type")].alias("family"), F.get(codes, (F.col("event_id") % 6).cast("int")).alias("code"), F.concat(F.lit("SEV"), F.col("user_id") % 4).alias("severity"),
        basis.alias("basis"),
        F.when((F.col("value") >= 20) & (F.col("user_id") % 3 > 0), F.concat(F.lit("d"), "user_id")).alias("decision"),
    )
    return O.severity_issues(incidents).select("event_id", "default_severity", "issue")


# --- attempts, leases, receipts ----------------------------------------------

_LINES = """ln AS (SELECT l_orderkey AS job_id, l_linenumber AS n, min(l_returnflag) AS flag, min(l_linestatus) AS ls, CAST(epoch(min(l_shipdate)) AS BIGINT) AS at_s, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2)"""


def _lines(spark, folder):
    li = D.table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("n")).agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("ls"),
        epoch_seconds(F.min("l_shipdate")).alias("at"), F.max("l_tax").alias("tax"),
    )


def job_attempts(spark, folder):
    flag = F.col("flag")
    return _lines(spark, folder).select(
        "job_id", F.col("n").alias("attempt"),
        F.when(F.col("ls") == "O", F.col("n") * 10).otherwise(F.col("n") * 10 - 11).alias("token"),
        F.when(F.col("n") > 1, F.when(F.col("tax") < 0.07, F.col("n") * 10 - 10).otherwise(0)).alias("prior_token"),
        F.col("at").alias("acquired_at"),
        F.when(flag == "R", "retryable_failed").when(flag == "N", "stale_fenced").otherwise("succeeded").alias("outcome"),
        (F.col("at") - 40_000_000).alias("retry_at"), (F.col("at") + 60_000_000).alias("window_end"),
    )


@query(
    f"""WITH {_LINES}, a AS (SELECT job_id, n, CASE WHEN ls = 'O' THEN n * 10 ELSE n * 10 - 11 END AS token, CASE WHEN n > 1 THEN CASE WHEN tax < 0.07 THEN n * 10 - 10 ELSE 0 END END AS pt, at_s, flag FROM ln)
    SELECT a.job_id, CAST(a.n AS BIGINT) AS attempt, CASE WHEN a.n > 1 AND p.n IS NULL THEN 'ATTEMPT_GAP' WHEN a.token <= p.token THEN 'TOKEN_NOT_RISING' WHEN p.n IS NOT NULL AND a.pt <> p.token THEN 'PRIOR_TOKEN_MISMATCH'
      WHEN p.flag = 'A' THEN 'PRIOR_NOT_RETRYABLE' WHEN p.flag = 'R' AND NOT (a.at_s BETWEEN p.at_s - 40000000 AND p.at_s + 60000000) THEN 'RETRY_OUTSIDE_WINDOW' END AS issue
    FROM a LEFT JOIN a p ON p.job_id = a.job_id AND p.n = a.n - 1"""
)
def attempt_audit(spark, folder):
    return O.attempt_issues(job_attempts(spark, folder)).select("job_id", "attempt", "issue")


@query(
    f"""WITH {_LINES}, {_CJOBS}, l AS (SELECT job_id, count(*) AS k, CASE arg_max(flag, n) WHEN 'R' THEN 'retryable_failed' WHEN 'N' THEN 'stale_fenced' ELSE 'succeeded' END AS o FROM ln GROUP BY job_id)
    SELECT o_orderkey AS job_id, terminal, o AS last_outcome, coalesce(k, 0) AS attempts, CASE
      WHEN due = 'blocked' AND (coalesce(k, 0) <> 1) THEN 'BLOCKED_JOB_INVALID' WHEN due = 'not_due' AND coalesce(k, 0) <> 0 THEN 'NOT_DUE_JOB_INVALID' WHEN due = 'due' AND coalesce(k, 0) < 1 THEN 'ATTEMPT_MISSING'
      WHEN o IS NOT NULL AND terminal IN ('completed_changed', 'completed_with_review') AND o <> 'succeeded' THEN 'SUCCESS_WITHOUT_SUCCESS' WHEN o IS NOT NULL AND terminal = 'retry_exhausted' THEN 'EXHAUSTED_WITHOUT_EXHAUSTION'
      WHEN o IS NOT NULL AND terminal = 'operator_paused' THEN 'BLOCKED_WITHOUT_BLOCK' END AS issue FROM cj LEFT JOIN l ON l.job_id = o_orderkey"""
)
def terminal_audit(spark, folder):
    return O.terminal_issues(scheduled_jobs(spark, folder), job_attempts(spark, folder))


@query(
    f"""WITH {_CJOBS}, r AS (SELECT l_orderkey AS job_id, CASE min(l_returnflag) WHEN 'A' THEN 'completed_changed' ELSE CASE min(l_linestatus) WHEN 'F' THEN 'source_expired' ELSE 'operator_paused' END END AS expected
      FROM lineitem GROUP BY 1)
    SELECT coalesce(o_orderkey, r.job_id) AS job_id, CASE WHEN o_orderkey IS NULL THEN 'RECEIPT_WITHOUT_JOB' WHEN r.job_id IS NULL THEN 'JOB_WITHOUT_RECEIPT' WHEN terminal <> expected THEN 'TERMINAL_MISMATCH' END AS issue
    FROM (SELECT * FROM cj WHERE o_totalprice > 50000) c FULL JOIN r ON r.job_id = o_orderkey"""
)
def receipt_reconcile(spark, folder):
    jobs = scheduled_jobs(spark, folder).where("o_totalprice > 50000")
    receipts = D.table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    ).select(
        "job_id",
        F.when(F.col("f") == "A", "completed_changed").when(F.col("s") == "F", "policy_blocked").otherwise("operator_paused").alias("source_terminal"),
        F.when(F.col("s") == "F", "expired").otherwise("certified").alias("certification"),
    )
    return O.receipt_reconciliation(jobs, receipts)


@query(
    """SELECT class, balanced, count(*) AS n FROM (SELECT CASE WHEN p_size = 50 THEN 'blocked' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'completed_unchanged' WHEN l_returnflag = 'N' THEN 'failed'
        WHEN l_discount = 0 THEN 'schema_quarantined' WHEN l_tax = 0.0 THEN 'completed_changed' ELSE 'completed_with_review' END AS class, l_linenumber <= 5 AS balanced
      FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL"""
)
def check_classes(spark, folder):
    """Each line as one source check; the last line numbers lose a record."""
    li = D.table(spark, folder, "lineitem").join(
        D.table(spark, folder, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")
    )
    fresh, whole = F.col("l_returnflag") != "N", F.col("l_discount") == 0
    lost = F.when(F.col("l_linenumber") <= 5, 0).otherwise(1)
    spare = F.when(F.col("l_tax") > 0, 1).otherwise(0)
    observed = F.col("l_quantity").cast("long") + 2
    checks = li.select(
        F.when(F.col("p_size") == 50, "revoked").otherwise("certified").alias("certification"),
        F.when(fresh, 200).otherwise(304).alias("status_code"), fresh.alias("body_received"),
        (F.col("l_linestatus") == "O").alias("conditional"), F.col("l_suppkey").alias("previous_snapshot"),
        F.when(fresh, 10).otherwise(0).alias("bytes_received"),
        observed.alias("observed"), F.when(whole, observed).otherwise(0).alias("quarantined"),
        F.when(whole, 0).otherwise(spare).alias("rejected"), F.lit(0).alias("excluded"),
        (F.when(whole, 0).otherwise(observed - spare) - lost).alias("parsed"),
        observed.alias("candidates"), observed.alias("admitted"),
    )
    return checks.select(O.check_class().alias("class"), O.record_balance().alias("balanced")).groupBy(
        "class", "balanced"
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_TARGETS}, c AS (SELECT o_custkey AS target_id, count(*) AS found, count(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS new FROM orders GROUP BY 1)
    SELECT target_id, CASE WHEN disposition <> 'due' THEN disposition WHEN f IS NOT NULL THEN 'failed' WHEN rr THEN 'review_required' WHEN coalesce(new, 0) > 0 THEN 'changed' ELSE 'unchanged' END AS run_outcome,
      CASE WHEN disposition = 'due' THEN f END AS failure_code, CASE WHEN disposition = 'due' AND f IS NULL THEN coalesce(new, 0) ELSE 0 END AS new_candidates,
      CASE WHEN disposition = 'due' AND f IS NULL THEN coalesce(found, 0) - coalesce(new, 0) ELSE 0 END AS replayed
    FROM (SELECT p.target_id, disposition, c_acctbal > 9000 AS rr, CASE WHEN c_acctbal < -500 THEN 'CONNECTOR_UNKNOWN' WHEN c_acctbal < 0 THEN 'FIXTURE_UNREADABLE' END AS f
          FROM plan p JOIN customer ON c_custkey = p.target_id WHERE slot = 0) LEFT JOIN c USING (target_id)"""
)
def run_outcomes(spark, folder):
    observed = D.table(spark, folder, "customer").where("c_acctbal >= -500").select(
        F.col("c_custkey").alias("target_id"), F.when(F.col("c_acctbal") < 0, "FIXTURE_UNREADABLE").alias("failure"),
        (F.col("c_acctbal") > 9000).alias("review_required"),
    )
    o = D.table(spark, folder, "orders")
    candidates = o.select(F.col("o_custkey").alias("target_id"), F.col("o_orderkey").alias("fingerprint"))
    known = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("fingerprint"))
    return O.target_outcomes(plan(spark, folder).where("slot = 0"), observed, candidates, known)


def _deliveries(spark, folder):
    flag = F.col("flag")
    return _lines(spark, folder).select(
        F.col("job_id").alias("receipt_id"), F.col("n").alias("attempt"), F.col("at").alias("started_at"),
        (F.col("at") + F.when(F.col("tax") == 0.08, -5).otherwise(5)).alias("ended_at"),
        F.when(flag == "R", "failed_transient").when(flag == "N", "failed_permanent").otherwise("delivered").alias("outcome"),
        F.when((flag == "R") & (F.col("ls") == "O"), F.col("at") + 10).alias("retry_at"),
    )


_DEL = f"""{_LINES}, dl AS (SELECT job_id, n, at_s AS st, at_s + CASE WHEN tax = 0.08 THEN -5 ELSE 5 END AS en, flag, CASE WHEN flag = 'R' AND ls = 'O' THEN at_s + 10 END AS ra FROM ln)"""


@query(
    f"""WITH {_DEL} SELECT a.job_id AS receipt_id, CAST(a.n AS BIGINT) AS attempt, CASE WHEN a.n > 1 AND p.n IS NULL THEN 'ATTEMPT_GAP' WHEN a.en < a.st OR a.st < p.en THEN 'TIME_REVERSED'
      WHEN p.n IS NOT NULL AND (p.flag <> 'R' OR p.ra IS NULL) THEN 'PRIOR_NOT_RETRYABLE' WHEN a.st < p.ra THEN 'STARTED_BEFORE_RETRY' WHEN a.flag = 'R' AND a.n < 3 AND a.ra IS NULL THEN 'RETRY_TIME_MISSING'
      WHEN a.flag = 'R' AND a.n >= 3 AND a.ra IS NOT NULL THEN 'FOURTH_ATTEMPT_PLANNED' END AS issue FROM dl a LEFT JOIN dl p ON p.job_id = a.job_id AND p.n = a.n - 1"""
)
def notification_audit(spark, folder):
    return O.notification_issues(_deliveries(spark, folder)).select("receipt_id", "attempt", "issue")


@query(
    f"""WITH {_DEL}, l AS (SELECT job_id, count(*) AS k, arg_max(flag, n) AS f FROM dl GROUP BY 1)
    SELECT o_orderkey AS receipt_id, CASE WHEN f IS NULL THEN 'ATTEMPT_MISSING' WHEN f <> CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'R' ELSE 'N' END THEN 'OUTCOME_CONTRADICTS_ATTEMPT'
      WHEN o_orderstatus = 'O' AND k <> 3 THEN 'BUDGET_NOT_SPENT' WHEN o_orderpriority = '1-URGENT' THEN 'OUTCOME_NOT_ALLOWED_ON_ROUTE' END AS issue FROM orders LEFT JOIN l ON l.job_id = o_orderkey"""
)
def receipt_audit(spark, folder):
    s = F.col("o_orderstatus")
    receipts = D.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("receipt_id"),
        F.when(s == "F", "delivered").when(s == "O", "retry_exhausted").otherwise("dead_lettered").alias("outcome"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "local_fixture_only").otherwise("approved_external").alias("route"),
    )
    return O.receipt_issues(receipts, _deliveries(spark, folder))


@query(
    f"""WITH {_LINES} SELECT a.job_id, CAST(a.n AS BIGINT) AS token, CASE WHEN a.n > 1 AND p.n IS NULL THEN 'TOKEN_GAP' WHEN a.at_s < coalesce(CASE WHEN p.flag = 'A' THEN p.at_s - 30000000 END, p.at_s + 50000000) THEN 'LEASE_OVERLAP'
      WHEN a.tax = 0.08 THEN 'HEARTBEAT_OUTSIDE' END AS issue FROM ln a LEFT JOIN ln p ON p.job_id = a.job_id AND p.n = a.n - 1"""
)
def lease_audit(spark, folder):
    leases = _lines(spark, folder).select(
        "job_id", F.col("n").alias("token"), F.col("at").alias("acquired_at"),
        (F.col("at") + F.when(F.col("tax") == 0.08, 50_000_001).otherwise(10)).alias("heartbeat_at"),
        (F.col("at") + 50_000_000).alias("expires_at"), F.when(F.col("flag") == "A", F.col("at") - 30_000_000).alias("released_at"),
    )
    return O.lease_issues(leases).select("job_id", "token", "issue")


@query(
    """SELECT o_custkey AS run_id, count(*) FILTER (WHERE o_orderstatus <> 'P') AS attempted, count(*) FILTER (WHERE o_orderstatus = 'O') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
    count(*) FILTER (WHERE o_orderstatus = 'P') AS blocked, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN k ELSE 0 END) AS BIGINT) AS claims_extracted,
    CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = 0 THEN 'completed' WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 THEN 'partial' ELSE 'failed' END AS status
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey"""
)
def run_rollup(spark, folder):
    """Orders as sources of their customer's run; lines are extracted claims."""
    n = D.table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("claims_extracted"))
    o = D.table(spark, folder, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    s = F.col("o_orderstatus")
    outcomes = o.select(
        F.col("o_custkey").alias("run_id"), F.coalesce("claims_extracted", F.lit(0)).alias("claims_extracted"),
        F.when(s == "O", "succeeded").when(s == "F", "failed").otherwise("blocked").alias("outcome"),
    )
    return O.run_rollup(outcomes, ["claims_extracted"])


@query(
    f"""WITH d AS (SELECT DISTINCT l_orderkey AS event_id, 'intent-' || sha256(CAST(l_orderkey AS VARCHAR) || chr(31) || l_returnflag) AS intent_id FROM lineitem)
    {multiset_sql('d', 'event_id', 'intent_id', 'intents', 'batch_digest')}"""
)
def outbox_batches(spark, folder):
    intents = D.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), derived_id("intent", F.col("l_orderkey"), F.col("l_returnflag")).alias("intent_id")
    )
    return O.outbox_batches(intents)


@query(
    """WITH a AS (SELECT DISTINCT l_orderkey AS event_id, l_returnflag AS intent_id FROM lineitem), d AS (SELECT DISTINCT l_orderkey AS event_id, l_returnflag AS intent_id FROM lineitem WHERE l_tax < 0.08 UNION SELECT o_orderkey, 'A' FROM orders)
    SELECT coalesce(a.event_id, d.event_id) AS event_id, coalesce(a.intent_id, d.intent_id) AS intent_id, CASE WHEN a.event_id IS NULL THEN 'MISSING_INTENT' ELSE 'UNDECLARED_INTENT' END AS issue
    FROM a FULL JOIN d ON a.event_id = d.event_id AND a.intent_id = d.intent_id WHERE a.event_id IS NULL OR d.event_id IS NULL"""
)
def outbox_audit(spark, folder):
    li = D.table(spark, folder, "lineitem")
    actual = li.select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("intent_id"))
    declared = li.where("l_tax < 0.08").select(F.col("l_orderkey").alias("event_id"), F.col("l_returnflag").alias("intent_id")).unionByName(
        D.table(spark, folder, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("A").alias("intent_id"))
    )
    return O.outbox_issues(actual, declared)


@query(
    """SELECT lower(event_type) AS kind, user_id, count(*) AS n, 'incident-' || sha256(event_type || chr(31) || CAST(user_id AS VARCHAR) || chr(31) || 'prod') AS incident_key FROM events GROUP BY event_type, user_id"""
)
def incident_dedupe_keys(spark, folder):
    ev = D.table(spark, folder, "events")
    keyed = ev.withColumn("incident_key", derived_id("incident", F.col("event_type"), F.col("user_id"), F.lit("prod")))
    return keyed.groupBy(F.lower("event_type").alias("kind"), "user_id", "incident_key").agg(F.count(F.lit(1)).alias("n"))
