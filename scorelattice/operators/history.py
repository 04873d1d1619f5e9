"""Insert-if-new, slowly changing definitions and backfills."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.digests import derived_id
from ..functions.rules import first_failure


def insert_if_new(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows to append: one per key, none whose key is stored already.

    Which of several equal-keyed rows is kept does not matter to callers: the
    key is a content identity.  Counting per key first keeps a heavily repeated
    key from piling up in one task.  Where rows are nothing but their key, both
    sides meet in one aggregate instead, so neither is sorted for a join; a key with
    an absent part equals no stored one.
    """
    if set(incoming.columns) == set(keys):
        whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
        sides = incoming.select(*keys, F.lit(False).alias("_stored")).unionByName(
            existing.select(*keys, F.lit(True).alias("_stored")).where(whole)
        )
        return sides.groupBy(*keys).agg(F.bool_or("_stored").alias("_stored")).where("NOT _stored").select(*incoming.columns)
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def insert_outcomes(incoming: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each distinct incoming key with its arrivals and ``created`` or ``reused``."""
    stored = existing.select(*keys).distinct().withColumn("_stored", F.lit(True))
    return (
        incoming.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("arrivals"))
        .join(stored, list(keys), "left")
        .withColumn("outcome", F.when(F.col("_stored"), "reused").otherwise("created"))
        .drop("_stored")
    )


def new_aliases(batch: DataFrame, existing: DataFrame, entities: DataFrame) -> DataFrame:
    """Alias rows to insert: live targets only, each once, not stored yet."""
    live = batch.join(entities.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_semi")
    return insert_if_new(live, existing, ["entity_type", "entity_id", "alias_text"])


def dangling_aliases(batch: DataFrame, entities: DataFrame) -> DataFrame:
    return batch.join(entities.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Current rows with incoming non-key fields laid over them, new keys added."""
    c, n = current.alias("c"), incoming.alias("n")
    joined = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full")
    arrived = F.col(f"n.{key}").isNotNull()
    return joined.select(
        F.coalesce(f"n.{key}", f"c.{key}").alias(key),
        *[F.when(arrived, F.col(f"n.{f}")).otherwise(F.col(f"c.{f}")).alias(f) for f in fields],
        F.when(F.col(f"c.{key}").isNull(), "inserted").when(arrived, "updated").otherwise("kept").alias("change"),
    )


def reconcile_definitions(
    manifest: DataFrame, current: DataFrame, ordinals: DataFrame
) -> DataFrame:
    """Each managed or listed source with what a registry run does to it.

    ``manifest``: source_id, owner_id, url, definition_hash.  ``current`` adds
    status and managed.  ``ordinals``: source_id, last_ordinal.  A changed,
    returning, new or vanished source gets the next ordinal; the others keep
    theirs.
    """
    m = manifest.select("source_id", *[F.col(c).alias(f"m_{c}") for c in ("owner_id", "url", "definition_hash")])
    joined = current.join(m, "source_id", "full").join(ordinals, "source_id", "left")
    listed, known = F.col("m_definition_hash").isNotNull(), F.col("definition_hash").isNotNull()
    # Another source holding the same owner and address blocks the change.
    owners = current.select(
        F.col("owner_id").alias("m_owner_id"), F.col("url").alias("m_url"), F.col("source_id").alias("holder")
    ).groupBy("m_owner_id", "m_url").agg(F.min("holder").alias("low"), F.max("holder").alias("high"))
    joined = joined.join(owners, ["m_owner_id", "m_url"], "left")
    taken = (F.col("low") != F.col("source_id")) | (F.col("high") != F.col("source_id"))
    error = first_failure(
        [
            (listed & known & ~F.col("owner_id").eqNullSafe(F.col("m_owner_id")), "BENCHMARK_CHANGED"),
            (listed & taken, "URL_ALREADY_OWNED"),
        ]
    )
    retired = F.col("status") == "retired"
    disposition = (
        F.when(error.isNotNull(), "refused")
        .when(listed & ~known, "created")
        .when(~listed & F.col("managed") & ~retired, "retired")
        .when(~listed, "untouched")
        .when(F.col("definition_hash") == F.col("m_definition_hash"), "unchanged")
        .when(retired, "reactivated")
        .otherwise("revised")
    )
    moved = disposition.isin("created", "retired", "reactivated", "revised")
    last = F.coalesce("last_ordinal", F.lit(0))
    reason = (
        F.when(disposition == "created", "uncertified_source_revision")
        .when(disposition == "revised", "registry_definition_changed")
        .when(disposition == "reactivated", "source_reintroduced")
        .when(disposition == "retired", "removed_from_registry")
    )
    return joined.select(
        "source_id",
        disposition.alias("disposition"),
        error.alias("error"),
        F.when(moved, last + 1).otherwise(last).alias("ordinal"),
        reason.alias("decision_reason"),
        F.when(moved, F.when(disposition == "retired", "revoked").otherwise("quarantined")).alias("decision_outcome"),
    )


def reconcile_counters(reconciled: DataFrame) -> DataFrame:
    kinds = ("created", "revised", "reactivated", "retired", "unchanged", "refused")
    return reconciled.agg(
        F.count_if(F.col("disposition") != "untouched").alias("processed"),
        *[F.count_if(F.col("disposition") == k).alias(k) for k in kinds],
    )


def check_appends(proposals: DataFrame, leaves: DataFrame) -> DataFrame:
    """Proposed decisions with ``accepted`` or why they do not fit the chain.

    A proposal must supersede the entity's effective decision, or nothing when
    there is none; two proposals for one entity cannot both be next.
    """
    rivals = proposals.groupBy("entity").agg(F.count(F.lit(1)).alias("rivals"))
    joined = proposals.join(leaves, "entity", "left").join(rivals, "entity")
    verdict = F.coalesce(
        first_failure(
            [
                (F.col("chain_error").isNotNull(), F.col("chain_error")),
                (F.trim(F.coalesce("reason_code", F.lit(""))) == "", "REASON_MISSING"),
                (F.col("leaf_id").isNull() & F.col("supersedes").isNotNull(), "FIRST_DECISION_HAS_PARENT"),
                (~F.col("supersedes").eqNullSafe(F.col("leaf_id")), "NOT_ON_EFFECTIVE_DECISION"),
                (F.col("rivals") > 1, "RIVAL_PROPOSALS"),
            ]
        ),
        F.lit("accepted"),
    )
    return joined.withColumn("verdict", verdict).drop("rivals", "leaf_id", "chain_error")


def replay_conflicts(receipts: DataFrame, key: str, digest: str) -> DataFrame:
    """Ids stored with more than one content digest."""
    return (
        receipts.groupBy(key)
        .agg(F.min(digest).alias("low"), F.max(digest).alias("high"), F.count(F.lit(1)).alias("receipts"))
        .where(F.col("low") != F.col("high"))
        .select(key, "receipts")
    )


def backfill_history(sources: DataFrame, snapshots: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """First history rows for data that predates it.

    Every source gets revision 1 and a quarantined decision, its snapshots point
    at that revision, every claim gets a review and a publication decision.
    """
    def made(prefix: str, *parts: Column) -> Column:
        return derived_id(prefix, *parts)

    revisions = sources.select(
        made("revision", F.col("source_id")).alias("revision_id"),
        "source_id",
        F.lit(1).cast("long").alias("ordinal"),
        "definition_hash",
    )
    decisions = revisions.select(
        made("decision", F.col("revision_id")).alias("decision_id"),
        "revision_id",
        F.lit("quarantined").alias("outcome"),
    )
    pointed = snapshots.join(revisions.select("source_id", "revision_id"), "source_id")
    reviews = claims.select(
        made("review", F.col("claim_id")).alias("review_id"), "claim_id", F.lit("needs_review").alias("outcome")
    )
    publications = reviews.select(
        made("publication", F.col("claim_id")).alias("publication_id"),
        "claim_id",
        "review_id",
        F.lit("quarantined").alias("outcome"),
    )
    return {
        "revisions": revisions, "decisions": decisions, "snapshots": pointed,
        "reviews": reviews, "publications": publications,
    }
