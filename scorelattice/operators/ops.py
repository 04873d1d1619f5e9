"""Scheduling, incident and run tables: plans, folds and audits.

An event's predecessor is found by joining on (entity, ordinal - 1), a unique
key, and folds are mergeable aggregates.  No step orders a whole entity in one
task, so an entity with most of all events is no special case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digests import derived_id
from ..functions.rules import first_failure, refuse
from ..functions.timegrid import duration_seconds, slot_start
from .audit import multiset_digest

# Planner outcome of each target status other than ``configured``.
STATUS_PLAN = {
    "draft": ("blocked", "SOURCE_POLICY_BLOCKED"),
    "paused": ("blocked", "OPERATOR_PAUSED"),
    "blocked_terms": ("blocked", "TERMS_POLICY_BLOCKED"),
    "blocked_permission": ("blocked", "TERMS_POLICY_BLOCKED"),
    "retired": ("not_due", "NOT_DUE_BY_POLICY"),
}
# Incident steps as event -> (states it may leave, state it enters).
INCIDENT_STEPS = {
    "OPENED": ((None,), "OPEN"),
    "ACKNOWLEDGED": (("OPEN",), "ACKNOWLEDGED"),
    "INVESTIGATION_STARTED": (("ACKNOWLEDGED",), "INVESTIGATING"),
    "MITIGATED": (("INVESTIGATING",), "MITIGATED"),
    "RESOLVED": (("MITIGATED",), "RESOLVED"),
    "CLOSED": (("RESOLVED",), "CLOSED"),
    "REOPENED": (("RESOLVED", "CLOSED"), "OPEN"),
}
# Work-item steps in the same form.
WORK_STEPS = {
    "CREATED": ((None,), "OPEN"),
    "CLAIMED": (("OPEN", "DEFERRED"), "CLAIMED"),
    "DEFERRED": (("OPEN", "CLAIMED"), "DEFERRED"),
    "RESOLVED": (("OPEN", "CLAIMED", "DEFERRED"), "RESOLVED"),
    "REJECTED": (("OPEN", "CLAIMED", "DEFERRED"), "REJECTED"),
    "BLOCKED": (("OPEN", "CLAIMED", "DEFERRED"), "BLOCKED"),
    "REOPENED": (("DEFERRED", "RESOLVED", "REJECTED", "BLOCKED"), "OPEN"),
}
WORK_TERMINAL = ("RESOLVED", "REJECTED", "BLOCKED")
# Seconds to acknowledge and to mitigate, where the clock runs.
SLA_SECONDS = {"SEV0": (900, 3600), "SEV1": (1800, 14400)}
# Severity of each incident family.
FAMILY_SEVERITY = {
    "SECURITY": "SEV0",
    "DATABASE": "SEV1", "ARTIFACT": "SEV1", "PUBLICATION": "SEV1", "NOTIFY": "SEV1",
    "SOURCE_POLICY": "SEV2", "FETCH": "SEV2", "SNAPSHOT": "SEV2", "STORAGE": "SEV2", "SCHEMA": "SEV2",
    "EVIDENCE": "SEV2", "VALIDATION": "SEV2", "CONFLICT": "SEV2", "SCHEDULER": "SEV2", "FRONTEND": "SEV2",
    "DISCOVERY": "SEV3", "IDENTITY": "SEV3",
}
# Incident codes by family.
FAMILY_CODES = {
    "DISCOVERY": ("NEW_CANDIDATE", "CANDIDATE_DRIFT", "ORIGIN_UNREACHABLE", "DUPLICATE"),
    "SOURCE_POLICY": ("TERMS_UNKNOWN", "TERMS_CHANGED", "PERMISSION_REQUIRED", "CERT_EXPIRED", "REVISION_UNCERTIFIED"),
    "FETCH": ("TRANSPORT_UNAVAILABLE", "TRANSIENT", "RATE_LIMITED", "POLICY_BLOCK", "CONTENT_MISMATCH", "UNSAFE_REDIRECT"),
    "SNAPSHOT": ("WRITE_FAILED", "HASH_MISMATCH", "OBJECT_MISSING"),
    "STORAGE": ("WRITE_FAILED", "HASH_MISMATCH", "OBJECT_MISSING", "RETENTION_VIOLATION", "ORPHAN_DETECTED"),
    "SCHEMA": ("SCHEMA_DRIFT", "CONTRACT_MISMATCH"),
    "EVIDENCE": ("LOCATOR_UNRESOLVABLE", "RAW_VALUE_MISMATCH", "CONTRACT_MISMATCH"),
    "VALIDATION": ("CLAIM_REJECTED", "NO_PASS", "NONFINITE_SCORE", "DIMENSION_UNAPPROVED"),
    "IDENTITY": ("MODEL_UNRESOLVED", "MODEL_AMBIGUOUS", "BENCHMARK_UNRESOLVED", "SYSTEM_COMPOSITION_UNKNOWN"),
    "CONFLICT": ("DISPLAY_CELL_DUPLICATE", "DECISION_CHAIN_AMBIGUOUS", "FINGERPRINT_COLLISION"),
    "SCHEDULER": ("DISPATCH_MISSED", "LEASE_LOST", "DUPLICATE_DELIVERY", "QUEUE_BACKLOG", "WATCHDOG_MISSING_RECEIPT"),
    "DATABASE": ("UNAVAILABLE", "CONSTRAINT_FAILED", "MIGRATION_FAILED", "RESTORE_FAILED"),
    "ARTIFACT": ("BUILD_FAILED", "DIGEST_MISMATCH", "UNAUTHORIZED", "REVOCATION_FAILED", "WITHDRAWAL_FAILED"),
    "PUBLICATION": ("BUILD_FAILED", "DIGEST_MISMATCH", "UNAUTHORIZED", "REVOCATION_FAILED", "WITHDRAWAL_FAILED"),
    "FRONTEND": ("ARTIFACT_LOAD_FAILED", "AUTHORIZATION_MISMATCH", "CACHE_STALE", "SILENT_FALLBACK_ATTEMPT"),
    "SECURITY": ("CREDENTIAL_EXPOSURE", "UNSAFE_EGRESS", "PRIVACY_POLICY_VIOLATION", "ALERT_INJECTION"),
    "NOTIFY": ("DELIVERY_FAILED", "DEAD_LETTERED", "WATCHDOG_FAILED"),
}
# Terminal dispositions of a scheduled job by kind.
SUCCEEDED = (
    "completed_unchanged", "completed_changed", "discovery_unchanged", "discovery_changed",
    "maintenance_completed",
)
REVIEW = ("completed_with_review", "identity_review_required")
FAILED = (
    "attempted_policy_failed", "retry_exhausted", "dispatch_missed", "snapshot_integrity_failed",
    "schema_quarantined", "extraction_incomplete", "display_conflict",
)
BLOCKED = (
    "policy_blocked", "terms_quarantined", "operator_paused", "source_uncertified", "source_expired",
)
# Last attempt outcome of each notification receipt outcome.
RECEIPT_LAST_ATTEMPT = {
    "local_fixture_recorded": "local_recorded", "blocked_authority": "blocked_authority",
    "delivered": "delivered", "retry_exhausted": "failed_transient",
    "dead_lettered": "failed_permanent", "suppressed_duplicate": "suppressed",
    "canary_failed": "failed_permanent", "recovery_delivered": "delivered",
}
# Receipt outcomes each route authority allows.
ROUTE_OUTCOMES = {
    "local_fixture_only": ("local_fixture_recorded", "suppressed_duplicate"),
    "externally_blocked": ("blocked_authority", "suppressed_duplicate"),
    "approved_external": (
        "delivered", "retry_exhausted", "dead_lettered", "suppressed_duplicate",
        "canary_failed", "recovery_delivered",
    ),
}


def text_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def list_map(values: Mapping[str, Sequence[str | None]]) -> Column:
    return F.create_map(
        *[c for k, vs in values.items() for c in (F.lit(k), F.array(*[F.coalesce(F.lit(v).cast("string"), F.lit("∅")) for v in vs]))]
    )


# --- schedules -------------------------------------------------------------

def due_plan(targets: DataFrame, first_slot: int, last_slot: int, slot_seconds: int) -> DataFrame:
    """Each target's one disposition in every slot of a range.

    The range is a parameter; slots are unfolded from each target's row.
    """
    cadence = duration_seconds(F.col("cadence"))
    plans = {k: F.struct(F.lit(d).alias("d"), F.lit(r).alias("r")) for k, (d, r) in STATUS_PLAN.items()}
    planned = targets.withColumn("cadence_seconds", cadence).select(
        "*", F.explode(F.sequence(F.lit(first_slot), F.lit(last_slot))).alias("slot")
    )
    due = (F.col("slot") * slot_seconds) % F.col("cadence_seconds") == 0
    status = F.col("status")
    by_status = F.coalesce(*[F.when(status == k, v) for k, v in plans.items()])
    configured = F.when(
        due, F.struct(F.lit("due").alias("d"), F.lit("DUE_BY_SCHEDULE").alias("r"))
    ).otherwise(F.struct(F.lit("not_due").alias("d"), F.lit("NOT_DUE_BY_POLICY").alias("r")))
    plan = F.when(status == "configured", configured).otherwise(by_status)
    return planned.select(
        "target_id", F.col("slot").cast("long").alias("slot"), plan["d"].alias("disposition"), plan["r"].alias("reason_code")
    )


def cycle_jobs(plan: DataFrame, environment: str, lane: str, anchor: int, slot_seconds: int) -> DataFrame:
    """One job row per planned target and slot with its derived ids."""
    cycle = derived_id("cycle", F.lit(environment), F.lit(lane), slot_start(F.col("slot"), anchor, slot_seconds))
    return plan.withColumn("cycle_id", cycle).withColumn(
        "job_id", derived_id("job", F.col("cycle_id"), F.col("target_id"))
    )


#: Jobs that one task tells apart.
JOBS_PER_TASK = 500_000


def cycle_sentinels(jobs: DataFrame) -> DataFrame:
    """Job count and order-free digest of every cycle, with repeated jobs counted.

    Jobs are told apart in parts of about ``JOBS_PER_TASK``, however many there are.
    """
    ids = jobs.select("cycle_id", "job_id")
    parts = 1 + jobs.count() // JOBS_PER_TASK
    per_job = ids.repartition(parts, "cycle_id", "job_id").groupBy("cycle_id", "job_id").agg(F.count(F.lit(1)).alias("n"))
    repeats = per_job.groupBy("cycle_id").agg(F.sum(F.col("n") - 1).alias("repeated_jobs"))
    return _cycle_digests(jobs).join(repeats, "cycle_id")


def _cycle_digests(jobs: DataFrame) -> DataFrame:
    return multiset_digest(jobs, ["cycle_id"], F.col("job_id"), "job_count", "job_digest")


def replay_differences(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Cycles whose recomputed sentinel is not the stored one."""
    own = _cycle_digests(jobs)
    kept = stored.select("cycle_id", F.col("job_count").alias("s_count"), F.col("job_digest").alias("s_digest"))
    same = F.col("job_count").eqNullSafe(F.col("s_count")) & F.col("job_digest").eqNullSafe(F.col("s_digest"))
    return own.join(kept, "cycle_id", "full").where(~same)


def cycle_counts(jobs: DataFrame) -> DataFrame:
    """Outcome counts per cycle with both balance equations checked."""
    t, due = F.col("terminal"), F.col("due")
    counted = jobs.groupBy("cycle_id").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count_if(due == "due").alias("due"),
        F.count_if(due == "not_due").alias("not_due"),
        F.count_if(due == "blocked").alias("blocked"),
        F.count_if(t.isin(*SUCCEEDED)).alias("succeeded"),
        F.count_if(t.isin(*REVIEW)).alias("review_required"),
        F.count_if(t.isin(*FAILED)).alias("failed"),
    )
    c = {n: F.col(n) for n in counted.columns}
    balanced = (c["expected"] == c["due"] + c["not_due"] + c["blocked"]) & (
        c["due"] == c["succeeded"] + c["review_required"] + c["failed"]
    )
    return counted.withColumn("balanced", balanced)


def latest_cycles(cycles: DataFrame) -> DataFrame:
    """Latest completed cycle per lane, and whether it is the only one then."""
    per_time = cycles.groupBy("lane", "scheduled_for").agg(
        F.count(F.lit(1)).alias("n"), F.min("cycle_id").alias("cycle_id")
    )
    latest = per_time.groupBy("lane").agg(F.max(F.struct("scheduled_for", "n", "cycle_id")).alias("l"))
    return latest.select(
        "lane", "l.scheduled_for", F.when(F.col("l.n") == 1, F.col("l.cycle_id")).alias("cycle_id"),
        (F.col("l.n") == 1).alias("unambiguous"),
    )


def lane_watermarks(cycles: DataFrame) -> DataFrame:
    """Count, first and last cycle and an order-free digest per lane."""
    order = F.struct("scheduled_for", "cycle_id")
    ends = cycles.groupBy("environment", "lane").agg(
        F.min("scheduled_for").alias("earliest"), F.min_by("cycle_id", order).alias("earliest_id"),
        F.max("scheduled_for").alias("latest"), F.max_by("cycle_id", order).alias("latest_id"),
        F.max_by("content_digest", order).alias("latest_digest"),
    )
    line = F.concat_ws("|", "cycle_id", "scheduled_for", "content_digest")
    sets = multiset_digest(cycles, ["environment", "lane"], line, "cycles", "set_digest")
    return ends.join(sets, ["environment", "lane"])


# --- event folds -----------------------------------------------------------

def with_prior(events: DataFrame, entity: str, ordinal: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the columns of the row one ordinal before as ``p_*``; as many rows as before.

    ``repeated`` marks rows that share their ordinal; as a prior, such rows are
    one row, the least of them.
    """
    places = events.groupBy(entity, ordinal).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*columns)).alias("_p"))
    prior = places.select(
        F.col(entity), (F.col(ordinal) + 1).alias(ordinal), F.lit(True).alias("has_prior"),
        *[F.col(f"_p.{c}").alias(f"p_{c}") for c in columns],
    )
    shared = places.where("_n > 1").select(entity, ordinal, F.lit(True).alias("repeated"))
    return events.join(prior, [entity, ordinal], "left").join(shared, [entity, ordinal], "left").withColumns(
        {"has_prior": F.coalesce("has_prior", F.lit(False)), "repeated": F.coalesce("repeated", F.lit(False))}
    )


def step_issues(events: DataFrame, steps: Mapping[str, tuple], occurrence: str | None = None) -> DataFrame:
    """First broken rule of each event: numbering, link, transition, time.

    Columns: ``entity, ordinal, event_id, prior_event_id, event_type,
    from_state, to_state, occurred_at``.
    """
    linked = with_prior(events, "entity", "ordinal", ["event_id", "to_state", "occurred_at"])
    kind, frm, to = F.col("event_type"), F.col("from_state"), F.col("to_state")
    before = F.when(F.col("ordinal") > 1, F.col("p_to_state"))
    froms = list_map({k: v[0] for k, v in steps.items()})
    enters = text_map({k: v[1] for k, v in steps.items()})
    may_leave = F.array_contains(F.element_at(froms, kind), F.coalesce(frm, F.lit("∅")))
    legal_step = F.coalesce(may_leave & (F.element_at(enters, kind) == to), F.lit(False))
    if occurrence is not None:
        keeps = before.isNotNull() & ~before.isin("RESOLVED", "CLOSED") & frm.eqNullSafe(before) & to.eqNullSafe(before)
        legal_step = F.when(kind == occurrence, F.coalesce(keeps, F.lit(False))).otherwise(legal_step)
    issue = first_failure(
        [
            (F.col("repeated"), "ORDINAL_REPEATED"),
            ((F.col("ordinal") < 1) | ((F.col("ordinal") > 1) & ~F.col("has_prior")), "ORDINAL_GAP"),
            (~F.col("prior_event_id").eqNullSafe(F.col("p_event_id")), "PRIOR_EVENT_MISMATCH"),
            (~legal_step, "ILLEGAL_TRANSITION"),
            (~frm.eqNullSafe(before), "STATE_DISCONTINUITY"),
            (F.col("occurred_at") < F.col("p_occurred_at"), "TIME_REVERSED"),
        ]
    )
    return linked.select(*events.columns, issue.alias("issue"))


def incident_fold(events: DataFrame) -> DataFrame:
    """State of each incident after all its events; times are of the current episode."""
    kind, at, no = F.col("event_type"), F.col("occurred_at"), F.col("ordinal")
    starts = kind.isin("OPENED", "REOPENED")
    occurs = kind.isin("OPENED", "REOPENED", "OCCURRENCE_RECORDED")
    # The last acknowledgement and mitigation are kept with their ordinals; they
    # count only when they come after the last reopening.
    def last(event: str) -> Column:
        return F.max(F.when(kind == event, F.struct(no.alias("no"), at.alias("at"))))

    folded = events.groupBy("entity").agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by("to_state", no).alias("state"),
        F.count_if(occurs).alias("occurrences"),
        F.min(F.when(occurs, F.struct(no.alias("no"), at.alias("at")))).alias("first"),
        F.max(F.when(occurs, F.struct(no.alias("no"), at.alias("at")))).alias("last"),
        F.max(F.when(starts, F.struct(no.alias("no"), at.alias("at")))).alias("episode"),
        F.max(F.when(kind == "REOPENED", no)).alias("reopened"),
        last("ACKNOWLEDGED").alias("ack"),
        last("MITIGATED").alias("mit"),
    )

    def current(c: str) -> Column:
        return F.when(F.col(f"{c}.no") > F.coalesce("reopened", F.lit(0)), F.col(f"{c}.at"))

    return folded.select(
        "entity", "events", "state", "occurrences",
        F.col("first.at").alias("first_at"), F.col("last.at").alias("last_at"),
        F.col("episode.at").alias("episode_at"),
        current("ack").alias("acknowledged_at"), current("mit").alias("mitigated_at"),
    )


def work_fold(events: DataFrame) -> DataFrame:
    """State of each work item; a deferral's review time counts while deferred."""
    no = F.col("ordinal")
    folded = events.groupBy("entity").agg(
        F.count(F.lit(1)).alias("events"),
        F.max_by(F.struct("to_state", "occurred_at", "event_type", "next_review_at"), no).alias("l"),
    )
    return folded.select(
        "entity", "events", F.col("l.to_state").alias("state"),
        F.when(F.col("l.event_type") == "DEFERRED", F.col("l.next_review_at")).alias("next_review_at"),
        F.when(F.col("l.to_state").isin(*WORK_TERMINAL), F.col("l.occurred_at")).alias("terminal_at"),
    )


def sla_assessment(folded: DataFrame) -> DataFrame:
    """Due times and on-time flags from the episode start and the severity's targets."""
    out = folded
    for i, (name, done) in enumerate((("acknowledge", "acknowledged_at"), ("mitigate", "mitigated_at"))):
        seconds = F.coalesce(*[F.when(F.col("severity") == s, v[i]) for s, v in SLA_SECONDS.items()])
        out = out.withColumn(f"{name}_due", F.col("episode_at") + seconds).withColumn(
            f"{done.removesuffix('_at')}_on_time", F.col(done) <= F.col(f"{name}_due")
        )
    return out


def severity_issues(incidents: DataFrame) -> DataFrame:
    """Severity against the default of family and code; raising it needs a decision.

    Columns: ``family, code, severity, basis, decision``.
    """
    default = F.element_at(text_map(FAMILY_SEVERITY), F.col("family"))
    as_default = F.col("basis") == "taxonomy_default"
    issue = first_failure(
        [
            (default.isNull(), "FAMILY_UNKNOWN"),
            refuse(~F.array_contains(F.element_at(list_map(FAMILY_CODES), F.col("family")), F.col("code")), "CODE_UNKNOWN"),
            (as_default & ((F.col("severity") != default) | F.col("decision").isNotNull()), "NOT_THE_DEFAULT"),
            (~as_default & F.col("decision").isNull(), "ESCALATION_WITHOUT_DECISION"),
            (~as_default & (F.col("severity") >= default), "ESCALATION_NOT_MORE_SEVERE"),
        ]
    )
    return incidents.withColumn("default_severity", default).withColumn("issue", issue)


# --- attempts, leases, receipts ---------------------------------------------

def attempt_issues(attempts: DataFrame) -> DataFrame:
    """Attempts of each job: contiguous, rising tokens, only after a retryable end.

    Columns: ``job_id, attempt, token, prior_token, acquired_at, outcome,
    retry_at, window_end``.
    """
    linked = with_prior(attempts, "job_id", "attempt", ["token", "outcome", "retry_at", "window_end"])
    prior_retry = F.col("p_outcome") == "retryable_failed"
    issue = first_failure(
        [
            (F.col("repeated"), "ATTEMPT_REPEATED"),
            ((F.col("attempt") < 1) | ((F.col("attempt") > 1) & ~F.col("has_prior")), "ATTEMPT_GAP"),
            (F.col("has_prior") & (F.col("token") <= F.col("p_token")), "TOKEN_NOT_RISING"),
            (F.col("has_prior") & ~F.col("prior_token").eqNullSafe(F.col("p_token")), "PRIOR_TOKEN_MISMATCH"),
            (F.col("has_prior") & ~F.col("p_outcome").isin("retryable_failed", "stale_fenced"), "PRIOR_NOT_RETRYABLE"),
            (
                prior_retry & ~F.col("acquired_at").between(F.col("p_retry_at"), F.col("p_window_end")),
                "RETRY_OUTSIDE_WINDOW",
            ),
        ]
    )
    return linked.select(*attempts.columns, issue.alias("issue"))


def terminal_issues(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each job's terminal disposition against its last attempt and attempt count."""
    last = attempts.groupBy("job_id").agg(
        F.max_by("outcome", "attempt").alias("last_outcome"), F.count(F.lit(1)).alias("attempts")
    )
    joined = jobs.join(last, "job_id", "left")
    t, o, due = F.col("terminal"), F.col("last_outcome"), F.col("due")
    n = F.coalesce("attempts", F.lit(0))
    tried = o.isNotNull()
    issue = first_failure(
        [
            ((due == "blocked") & ((n != 1) | ~t.isin(*BLOCKED)), "BLOCKED_JOB_INVALID"),
            ((due == "not_due") & ((n != 0) | (t != "not_due")), "NOT_DUE_JOB_INVALID"),
            ((due == "due") & (t.isin(*BLOCKED) | (t == "not_due")), "DUE_JOB_NOT_EXECUTED"),
            ((due == "due") & (t == "dispatch_missed") & (n != 0), "MISSED_JOB_HAS_ATTEMPTS"),
            ((due == "due") & (t != "dispatch_missed") & (n < 1), "ATTEMPT_MISSING"),
            (tried & t.isin(*SUCCEEDED, *REVIEW) & (o != "succeeded"), "SUCCESS_WITHOUT_SUCCESS"),
            (tried & (t == "retry_exhausted") & (o != "retry_exhausted"), "EXHAUSTED_WITHOUT_EXHAUSTION"),
            (tried & t.isin(*BLOCKED) & (o != "blocked"), "BLOCKED_WITHOUT_BLOCK"),
            (
                tried & t.isin(*FAILED) & (t != "retry_exhausted") & (o != "nonretryable_failed"),
                "FAILED_WITHOUT_FAILURE",
            ),
        ]
    )
    return joined.select("job_id", "terminal", "last_outcome", n.alias("attempts"), issue.alias("issue"))


def expected_terminal(source_terminal: Column, certification: Column) -> Column:
    """Job disposition a source check's own disposition must lead to."""
    return (
        F.when(source_terminal != "policy_blocked", source_terminal)
        .when(certification == "expired", "source_expired")
        .when(certification.isin("missing", "mismatch", "quarantined", "revoked"), "source_uncertified")
        .otherwise("policy_blocked")
    )


def receipt_reconciliation(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Jobs against check receipts, both ways, with the expected disposition."""
    r = receipts.select(
        "job_id", expected_terminal(F.col("source_terminal"), F.col("certification")).alias("expected"),
        F.lit(True).alias("has_receipt"),
    )
    j = jobs.select("job_id", "terminal", F.lit(True).alias("has_job"))
    issue = first_failure(
        [
            (F.col("has_job").isNull(), "RECEIPT_WITHOUT_JOB"),
            (F.col("has_receipt").isNull(), "JOB_WITHOUT_RECEIPT"),
            (F.col("terminal") != F.col("expected"), "TERMINAL_MISMATCH"),
        ]
    )
    return j.join(r, "job_id", "full").select("job_id", issue.alias("issue"))


def check_class() -> Column:
    """What a source check amounted to, from its request and extraction columns."""
    unchanged = (
        (F.col("status_code") == 304) & ~F.col("body_received") & F.col("conditional")
        & F.col("previous_snapshot").isNotNull()
    )
    fetched = (F.col("status_code") == 200) & F.col("body_received") & (F.col("bytes_received") >= 1)
    clean = (F.col("rejected") == 0) & (F.col("quarantined") == 0) & (F.col("admitted") == F.col("candidates"))
    return (
        F.when(F.col("certification") != "certified", "blocked")
        .when(unchanged, "completed_unchanged")
        .when(~fetched, "failed")
        .when(F.col("quarantined") == F.col("observed"), "schema_quarantined")
        .when(clean, "completed_changed")
        .otherwise("completed_with_review")
    )


def record_balance() -> Column:
    return F.col("observed") == F.col("parsed") + F.col("excluded") + F.col("rejected") + F.col("quarantined")


def target_outcomes(plan: DataFrame, observations: DataFrame, candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome per planned target: not run, failed, review, changed or unchanged.

    ``observations``: target_id, failure, review_required.  ``candidates``:
    target_id, fingerprint; those in ``known`` are replays.
    """
    marked = candidates.join(
        known.select("fingerprint").distinct().withColumn("seen", F.lit(True)), "fingerprint", "left"
    )
    found = marked.groupBy("target_id").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("seen").isNull()).alias("new")
    )
    joined = plan.join(observations, "target_id", "left").join(found, "target_id", "left")
    failure = F.when(F.col("review_required").isNull() & F.col("failure").isNull(), "CONNECTOR_UNKNOWN").otherwise(
        F.col("failure")
    )
    outcome = (
        F.when(F.col("disposition") != "due", F.col("disposition"))
        .when(failure.isNotNull(), "failed")
        .when(F.col("review_required"), "review_required")
        .when(F.coalesce("new", F.lit(0)) > 0, "changed")
        .otherwise("unchanged")
    )
    ran = outcome.isin("review_required", "changed", "unchanged")
    return joined.select(
        "target_id", outcome.alias("run_outcome"),
        F.when((F.col("disposition") == "due"), failure).alias("failure_code"),
        F.when(ran, F.coalesce("new", F.lit(0))).otherwise(0).alias("new_candidates"),
        F.when(ran, F.coalesce("found", F.lit(0)) - F.coalesce("new", F.lit(0))).otherwise(0).alias("replayed"),
    )


def notification_issues(attempts: DataFrame) -> DataFrame:
    """Delivery attempts in order: numbering, times and retry rules.

    Columns: ``receipt_id, attempt, started_at, ended_at, outcome, retry_at``.
    """
    linked = with_prior(attempts, "receipt_id", "attempt", ["ended_at", "outcome", "retry_at"])
    transient = F.col("outcome") == "failed_transient"
    issue = first_failure(
        [
            (F.col("repeated"), "ATTEMPT_REPEATED"),
            ((F.col("attempt") < 1) | ((F.col("attempt") > 1) & ~F.col("has_prior")), "ATTEMPT_GAP"),
            ((F.col("ended_at") < F.col("started_at")) | (F.col("started_at") < F.col("p_ended_at")), "TIME_REVERSED"),
            (F.col("has_prior") & ((F.col("p_outcome") != "failed_transient") | F.col("p_retry_at").isNull()), "PRIOR_NOT_RETRYABLE"),
            (F.col("started_at") < F.col("p_retry_at"), "STARTED_BEFORE_RETRY"),
            (transient & (F.col("attempt") < 3) & F.col("retry_at").isNull(), "RETRY_TIME_MISSING"),
            (transient & (F.col("attempt") >= 3) & F.col("retry_at").isNotNull(), "FOURTH_ATTEMPT_PLANNED"),
            (~transient & F.col("retry_at").isNotNull(), "RETRY_TIME_UNEXPECTED"),
            (F.col("retry_at") < F.col("ended_at"), "RETRY_BEFORE_END"),
        ]
    )
    return linked.select(*attempts.columns, issue.alias("issue"))


def receipt_issues(receipts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Receipt outcomes against the last attempt, the budget and the route."""
    last = attempts.groupBy("receipt_id").agg(
        F.max_by("outcome", "attempt").alias("last"), F.count(F.lit(1)).alias("n")
    )
    outcome = F.col("outcome")
    allowed = F.array_contains(F.element_at(list_map(ROUTE_OUTCOMES), F.col("route")), outcome)
    issue = first_failure(
        [
            (F.col("last").isNull(), "ATTEMPT_MISSING"),
            (F.col("last") != F.element_at(text_map(RECEIPT_LAST_ATTEMPT), outcome), "OUTCOME_CONTRADICTS_ATTEMPT"),
            ((outcome == "retry_exhausted") & (F.col("n") != 3), "BUDGET_NOT_SPENT"),
            (~F.coalesce(allowed, F.lit(False)), "OUTCOME_NOT_ALLOWED_ON_ROUTE"),
        ]
    )
    return receipts.join(last, "receipt_id", "left").select("receipt_id", issue.alias("issue"))


def lease_issues(leases: DataFrame) -> DataFrame:
    """Lease history per job: tokens rise by one, no overlap, heartbeats inside.

    Columns: ``job_id, token, acquired_at, heartbeat_at, expires_at, released_at``.
    """
    linked = with_prior(leases, "job_id", "token", ["expires_at", "released_at"])
    freed = F.coalesce("p_released_at", "p_expires_at")
    issue = first_failure(
        [
            (F.col("repeated"), "TOKEN_REPEATED"),
            ((F.col("token") < 1) | ((F.col("token") > 1) & ~F.col("has_prior")), "TOKEN_GAP"),
            (F.col("acquired_at") < freed, "LEASE_OVERLAP"),
            (~F.col("heartbeat_at").between(F.col("acquired_at"), F.col("expires_at")), "HEARTBEAT_OUTSIDE"),
        ]
    )
    return linked.select(*leases.columns, issue.alias("issue"))


def run_rollup(outcomes: DataFrame, counters: Sequence[str]) -> DataFrame:
    """Status and summed counters per ingestion run from its per-source outcomes."""
    failed, ok = F.col("outcome") == "failed", F.col("outcome") == "succeeded"
    rolled = outcomes.groupBy("run_id").agg(
        F.count_if(ok | failed).alias("attempted"), F.count_if(ok).alias("succeeded"),
        F.count_if(failed).alias("failed"), F.count_if(F.col("outcome") == "blocked").alias("blocked"),
        *[F.sum(F.when(ok, F.col(c)).otherwise(0)).alias(c) for c in counters],
    )
    status = F.when(F.col("failed") == 0, "completed").when(F.col("succeeded") > 0, "partial").otherwise("failed")
    return rolled.withColumn("status", status)


def outbox_batches(intents: DataFrame) -> DataFrame:
    """Per incident event: how many intents, and their order-free batch digest."""
    distinct = intents.select("event_id", "intent_id").distinct()
    return multiset_digest(distinct, ["event_id"], F.col("intent_id"), "intents", "batch_digest")


def outbox_issues(intents: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared and actual intents that lack a counterpart."""
    d = declared.select("event_id", "intent_id").distinct().withColumn("declared", F.lit(True))
    a = intents.select("event_id", "intent_id").distinct().withColumn("actual", F.lit(True))
    return (
        d.join(a, ["event_id", "intent_id"], "full")
        .where(F.col("declared").isNull() | F.col("actual").isNull())
        .select(
            "event_id", "intent_id",
            F.when(F.col("actual").isNull(), "MISSING_INTENT").otherwise("UNDECLARED_INTENT").alias("issue"),
        )
    )
