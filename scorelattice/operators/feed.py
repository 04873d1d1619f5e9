"""From reviewed claims to a conflict-free feed of display cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import first_failure, refuse
from ..functions.scores import is_finite
from ..functions.text import is_sha256
from .ordering import sequential_position

CELL = ("model_id", "benchmark_id", "metric", "split", "setting", "evaluation_version")


def _blank(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) == ""


def provenance_reason() -> Column:
    """First reason a claim's source provenance fails, over joined columns."""
    return first_failure(
        [
            (F.col("decision_id").isNull(), "SOURCE_DECISION_MISSING"),
            (F.col("snapshot_source_id").isNull() | F.col("decision_revision_id").isNull(), "SOURCE_PROVENANCE_MISSING"),
            (F.col("revision_source_id").isNull() | F.col("known_source_id").isNull(), "SOURCE_PROVENANCE_MISSING"),
            refuse(
                (F.col("snapshot_source_id") != F.col("source_id"))
                | (F.col("revision_source_id") != F.col("source_id"))
                | (F.col("decision_revision_id") != F.col("snapshot_revision_id")),
                "SOURCE_PROVENANCE_LINK_MISMATCH",
            ),
            (F.col("source_chain_error").isNotNull(), F.concat(F.lit("SOURCE_DECISION_"), F.col("source_chain_error"))),
            refuse(
                ~F.col("source_leaf_id").eqNullSafe(F.col("decision_id")) | (F.col("decision_outcome") != "certified"),
                "SOURCE_DECISION_NOT_CERTIFIED",
            ),
            (~F.coalesce("policy_complete", F.lit(False)), "SOURCE_CERTIFICATION_POLICY_INVALID"),
            (
                ~F.coalesce(is_sha256(F.col("content_hash")), F.lit(False))
                | ~F.coalesce(is_sha256(F.col("definition_hash")), F.lit(False)),
                "SNAPSHOT_HASH_INVALID",
            ),
            (F.col("captured_at").isNull(), "SNAPSHOT_CAPTURE_TIME_MISSING"),
        ]
    )


def display_reason() -> Column:
    """First reason a claim cannot be displayed once its provenance holds."""
    return first_failure(
        [
            (F.coalesce("validations", F.lit(0)) == 0, "VALIDATION_MISSING"),
            refuse(F.col("not_passed") > 0, "VALIDATION_NOT_ALL_PASS"),
            (F.col("review_error").isNotNull(), "REVIEW_CHAIN_INVALID"),
            (F.col("review_id").isNull(), "REVIEW_DECISION_MISSING"),
            refuse(F.col("review_outcome") != "validation_reviewed", "REVIEW_NOT_VALIDATION_REVIEWED"),
            (F.col("model_id").isNull() | F.col("benchmark_id").isNull(), "DISPLAY_IDENTITY_UNRESOLVED"),
            (F.col("publication_error").isNotNull(), "PUBLICATION_CHAIN_INVALID"),
            refuse(
                F.col("publication_id").isNull()
                | (F.col("publication_outcome") != "approved")
                | ~F.col("published_review_id").eqNullSafe(F.col("review_id")),
                "PUBLICATION_NOT_APPROVED",
            ),
            refuse(~is_finite(F.col("score_numeric")), "SCORE_NOT_FINITE_NUMERIC"),
            (
                _blank("model_raw") | _blank("benchmark_raw") | _blank("score_raw") | _blank("capture_method"),
                "RAW_CLAIM_FIELDS_INCOMPLETE",
            ),
            (_blank("locator_type"), "EVIDENCE_LOCATION_INCOMPLETE"),
            (~F.coalesce("locator_ok", F.lit(False)), "EVIDENCE_LOCATION_CONTRACT_MISMATCH"),
            refuse(~F.col("model_known") | ~F.col("benchmark_known"), "DISPLAY_IDENTITY_MISSING"),
        ]
    )


def claim_context(
    claims: DataFrame,
    snapshots: DataFrame,
    revisions: DataFrame,
    sources: DataFrame,
    source_decisions: DataFrame,
    source_leaves: DataFrame,
    validations: DataFrame,
    reviews: DataFrame,
    review_leaves: DataFrame,
    publications: DataFrame,
    publication_leaves: DataFrame,
    identities: DataFrame,
    models: DataFrame,
    benchmarks: DataFrame,
) -> DataFrame:
    """Claims with everything their display looks at and the verdict on their source, one row each.

    Sources come first: their snapshots have keys of their own, and only the verdict
    travels on to the claim-keyed sides (validations, reviews, publications,
    identities), which share one partitioning by claim.  These and the snapshots grow
    with the claims and are merged, as their compressed files look small enough to
    broadcast; registries are joined by their own ids and Spark broadcasts those it
    measures as small.
    """
    per_claim = validations.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("validations"), F.count_if(F.col("outcome") != "pass").alias("not_passed")
    )
    review = review_leaves.join(
        reviews.select(F.col("id").alias("leaf_id"), F.col("outcome").alias("review_outcome")).hint("merge"), "leaf_id", "left"
    ).select(
        F.col("entity").alias("claim_id"), F.col("leaf_id").alias("review_id"), "review_outcome",
        F.col("chain_error").alias("review_error"),
    )
    publication = publication_leaves.join(
        publications.select(
            F.col("id").alias("leaf_id"), F.col("outcome").alias("publication_outcome"),
            F.col("review_id").alias("published_review_id"),
        ).hint("merge"),
        "leaf_id",
        "left",
    ).select(
        F.col("entity").alias("claim_id"), F.col("leaf_id").alias("publication_id"),
        "publication_outcome", "published_review_id", F.col("chain_error").alias("publication_error"),
    )
    ident = identities.select("claim_id", *CELL)
    known_model = models.select("model_id", F.lit(True).alias("model_known")).distinct()
    known_benchmark = benchmarks.select("benchmark_id", F.lit(True).alias("benchmark_known")).distinct()
    snap = snapshots.select(
        "snapshot_id", F.col("source_id").alias("snapshot_source_id"),
        F.col("revision_id").alias("snapshot_revision_id"), "content_hash", "captured_at",
    )
    rev = revisions.select(
        F.col("revision_id").alias("snapshot_revision_id"), F.col("source_id").alias("revision_source_id"),
        "definition_hash",
    )
    dec = source_decisions.select(
        F.col("id").alias("decision_id"), F.col("entity").alias("decision_revision_id"),
        F.col("outcome").alias("decision_outcome"), "policy_complete",
    )
    leaf = source_leaves.select(
        F.col("entity").alias("snapshot_revision_id"), F.col("leaf_id").alias("source_leaf_id"),
        F.col("chain_error").alias("source_chain_error"),
    )
    sourced = (
        claims.join(snap.hint("merge"), "snapshot_id", "left")
        .join(rev, "snapshot_revision_id", "left")
        .join(leaf, "snapshot_revision_id", "left")
        .join(dec, "decision_id", "left")
        .join(sources.select("source_id", F.col("source_id").alias("known_source_id")), "source_id", "left")
    )
    return (
        sourced.select(*claims.columns, provenance_reason().alias("provenance"))
        .join(per_claim.hint("merge"), "claim_id", "left")
        .join(review.hint("merge"), "claim_id", "left")
        .join(publication.hint("merge"), "claim_id", "left")
        .join(ident.hint("merge"), "claim_id", "left")
        .join(known_model, "model_id", "left")
        .join(known_benchmark, "benchmark_id", "left")
        .withColumn("model_known", F.coalesce("model_known", F.lit(False)))
        .withColumn("benchmark_known", F.coalesce("benchmark_known", F.lit(False)))
    )


def eligibility(context: DataFrame) -> DataFrame:
    """``reason`` is null for claims fit to be shown."""
    return context.withColumn("reason", F.coalesce("provenance", display_reason()))


def cell_conflicts(eligible: DataFrame) -> DataFrame:
    """Eligible claims whose display cell holds more than one; no winner is picked.

    Cells compare null-safely: an absent part equals an absent part.
    """
    return _cell_counts(eligible).where("claims_in_cell > 1")


def _cell_counts(eligible: DataFrame) -> DataFrame:
    marked = eligible.withColumn("_cell", F.to_json(F.struct(*CELL), {"ignoreNullFields": "false"}))
    counts = marked.groupBy("_cell").agg(F.count(F.lit(1)).alias("claims_in_cell"))
    return marked.join(counts.hint("merge"), "_cell").drop("_cell")


def dispositions(judged: DataFrame) -> DataFrame:
    """Every claim once: candidate, conflicted, or omitted with its reason."""
    counted = _cell_counts(judged.where("reason is null")).select(
        "claim_id",
        F.when(F.col("claims_in_cell") > 1, "conflicted").otherwise("candidate").alias("disposition"),
        F.when(F.col("claims_in_cell") > 1, "DISPLAY_CELL_CONFLICT").alias("omission_reason"),
    )
    omitted = judged.where("reason is not null").select(
        "claim_id", F.lit("omitted").alias("disposition"), F.col("reason").alias("omission_reason")
    )
    return counted.unionByName(omitted)


def accounting_gaps(claims: DataFrame, disposed: DataFrame) -> DataFrame:
    """Claims not accounted for exactly once."""
    counted = disposed.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"))
    return claims.select("claim_id").join(counted, "claim_id", "full").where(
        F.coalesce("n", F.lit(0)) != 1
    )


def feed_scores(eligible: DataFrame) -> DataFrame:
    """Score rows of a feed, or none at all while any cell is in conflict."""
    conflicts = cell_conflicts(eligible).agg(F.count(F.lit(1)).alias("n")).scalar()
    return eligible.where(conflicts == 0)


def without_conflicts(eligible: DataFrame) -> DataFrame:
    """Only the cells that one claim holds (a preview, never a feed)."""
    return _cell_counts(eligible).where("claims_in_cell = 1").drop("claims_in_cell")


def feed_counts(scores: DataFrame) -> DataFrame:
    """The manifest's counts."""
    return scores.agg(
        F.count(F.lit(1)).alias("score_count"),
        F.count_distinct("model_id").alias("model_count"),
        F.count_distinct("benchmark_id").alias("benchmark_count"),
        F.count_distinct("source_id", "snapshot_id").alias("source_snapshot_count"),
    )


def referenced(registry: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Registry rows some score refers to."""
    return registry.join(scores.select(key), key, "left_semi")


def feed_issues(
    scores: DataFrame, models: DataFrame, benchmarks: DataFrame, manifest: DataFrame, excluded: DataFrame
) -> DataFrame:
    """Broken rules of an assembled feed, with how many rows break each.

    Both sides of a rule are counted by key and their counts meet in one aggregate,
    so no side is sized, collected or broadcast.  A key with an absent part has no
    counterpart.
    """
    def met(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
        """``l`` and ``r``, the rows with a key on either side, and whether the key is ``whole``."""
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        both = left.select(*keys, one.alias("l"), none.alias("r")).unionByName(right.select(*keys, none.alias("l"), one.alias("r")))
        whole = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
        return both.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).withColumn("whole", whole)

    def counts(groups: DataFrame, codes: Mapping[str, Column]) -> DataFrame:
        row = groups.agg(*[F.coalesce(n, F.lit(0)).cast("long").alias(code) for code, n in codes.items()])
        pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(code).alias("n")) for code in codes])
        return row.select(F.inline(pairs))

    l, r = F.col("l"), F.col("r")
    only_l = F.sum(F.when((r == 0) | ~F.col("whole"), l))
    only_r = F.sum(F.when((l == 0) | ~F.col("whole"), r))
    parts = [
        counts(
            met(scores, models, "model_id"),
            {"MODEL_ID_REPEATED": F.count_if(r > 1), "SCORE_MODEL_MISSING": only_l, "MODEL_UNREFERENCED": only_r},
        ),
        counts(
            met(scores, benchmarks, "benchmark_id"),
            {"BENCHMARK_ID_REPEATED": F.count_if(r > 1), "SCORE_BENCHMARK_MISSING": only_l, "BENCHMARK_UNREFERENCED": only_r},
        ),
        counts(
            met(scores, manifest, "source_id", "snapshot_id"),
            {"SCORE_PROVENANCE_MISSING": only_l, "MANIFEST_UNREFERENCED": only_r},
        ),
        counts(
            met(scores, excluded, "claim_id"),
            {"CLAIM_REPEATED": F.count_if(l > 1), "CLAIM_SELECTED_AND_EXCLUDED": F.sum(F.when((r > 0) & F.col("whole"), l))},
        ),
        counts(
            scores.groupBy("model_id", "benchmark_id").agg(F.count(F.lit(1)).alias("l")), {"PAIR_REPEATED": F.count_if(l > 1)}
        ),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def release_mismatches(candidates: DataFrame, stored: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Release candidates against the stored rows they bind to, both ways."""
    c = candidates.select("claim_id", F.struct(*fields).alias("c"))
    s = stored.select("claim_id", F.struct(*fields).alias("s"))
    issue = first_failure(
        [
            (F.col("c").isNull(), "STORED_WITHOUT_CANDIDATE"),
            (F.col("s").isNull(), "CANDIDATE_WITHOUT_STORED"),
            (~F.col("c").eqNullSafe(F.col("s")), "FIELDS_DIFFER"),
        ]
    )
    return c.join(s, "claim_id", "full").select("claim_id", issue.alias("issue")).where("issue is not null")


def order_breaks(rows: DataFrame, position: str, keys: Sequence[Column]) -> DataFrame:
    """Rows of a numbered list that do not come strictly after the row before.

    Neighbours meet by number in a join, so the list may be of any length.
    """
    now = rows.select(F.col(position), F.struct(*keys).alias("k"))
    prior = now.select((F.col(position) + 1).alias(position), F.col("k").alias("pk"))
    return now.join(prior, position).where(~(F.col("pk") < F.col("k"))).select(position)


def evidence_lookup(scores: DataFrame, manifest: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Scores with whether the manifest row of their key agrees in every field."""
    m = manifest.select("manifest_key", F.struct(*fields).alias("m"))
    own = F.struct(*fields)
    return scores.join(m, "manifest_key", "left").withColumn(
        "evidence",
        F.when(F.col("m").isNull(), "missing").when(F.col("m").eqNullSafe(own), "verified").otherwise("differs"),
    ).drop("m")


def in_cell_order(cells: DataFrame, row_id: str, place: str = "place") -> DataFrame:
    """Rows with their 1-based place in display order.

    Cells are in byte order of their parts, absent parts first; rows of one cell
    are in the order of ``row_id``.
    """
    return sequential_position(cells, [], [*map(F.col, CELL), F.col(row_id)], place)
