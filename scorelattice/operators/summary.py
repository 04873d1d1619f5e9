"""Frequency tables, conditional counts and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import visible_cursor

# Categories in display order.
GENERAL_CATEGORIES = (
    "knowledge", "reasoning", "math", "coding", "agentic", "instruction", "chat", "vision", "other",
)


def frequencies(rows: DataFrame, code: str) -> DataFrame:
    return rows.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def list_frequencies(rows: DataFrame, codes: str) -> DataFrame:
    return frequencies(rows.select(F.explode(codes).alias("code")), "code")


def conditional_counts(rows: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """All counts in one pass over the rows."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def children_per_parent(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Number of children of every parent, zero included."""
    n = children.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    return parents.select(key).join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def counts_by(rows: DataFrame, group: str, kinds: Sequence[str], kind: str) -> DataFrame:
    """One row per group and one count column per kind."""
    return rows.groupBy(group).agg(
        *[F.count_if(F.col(kind) == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total")
    )


def category_order(benchmarks: DataFrame) -> DataFrame:
    """Categories to show, in order: the embedding one last, or alone."""
    named = F.array(*[F.lit(c) for c in GENERAL_CATEGORIES])
    only = F.array(F.lit("embedding"))
    is_embedding = F.col("category") == "embedding"
    present = benchmarks.agg(
        F.coalesce(F.bool_or(is_embedding), F.lit(False)).alias("e"),
        F.coalesce(F.bool_or(~is_embedding), F.lit(False)).alias("g"),
    )
    shown = F.when(F.col("e") & ~F.col("g"), only).when(F.col("e"), F.concat(named, only)).otherwise(named)
    return present.select(F.posexplode(shown).alias("position", "category"))


def vendors(models: DataFrame) -> DataFrame:
    return models.select("vendor").distinct().orderBy("vendor")


def queue_reasons() -> Column:
    """Why a claim is in the review queue, joined by ``;`` (empty: it is not)."""
    broken = F.col("chain_error").isNotNull()
    unresolved = ~broken & F.col("model_id").isNull()
    corrected = ~broken & F.col("model_id").isNotNull() & F.col("captured_model_id").isNull()
    first = (
        F.when(broken, "REVIEW_CHAIN_INVALID").when(unresolved, "MODEL_IDENTITY_UNRESOLVED")
        .when(corrected, "MODEL_IDENTITY_REVIEWED")
    )
    due = F.when(F.col("capture_status") == "needs_review", "CAPTURE_NEEDS_REVIEW")
    return F.concat_ws(";", first, due)


def review_queue(claims: DataFrame) -> DataFrame:
    """Claims whose chain is broken, whose model is unknown, or that need review."""
    queued = (
        F.col("chain_error").isNotNull() | F.col("model_id").isNull() | (F.col("capture_status") == "needs_review")
    )
    return claims.where(queued).withColumn("queue_reason_codes", queue_reasons())


def keyset_page(
    rows: DataFrame, created: str, row_id: str, limit: int, after: tuple | None = None
) -> DataFrame:
    """One page newest first, strictly after the given (created, id)."""
    if after is not None:
        rows = rows.where(
            (F.col(created) < F.lit(after[0]))
            | ((F.col(created) == F.lit(after[0])) & (F.col(row_id) < F.lit(after[1])))
        )
    return rows.orderBy(F.desc(created), F.desc(row_id)).limit(limit)


def page_state(page: DataFrame, created: str, row_id: str, limit: int) -> DataFrame:
    """Rows scanned, whether the table is used up, and the next page's cursor."""
    last = F.min(F.struct(created, row_id)).alias("l")
    return page.agg(F.count(F.lit(1)).alias("scanned"), last).select(
        "scanned",
        (F.col("scanned") < limit).alias("exhausted"),
        F.when(
            F.col("scanned") >= limit,
            visible_cursor(F.col(f"l.{created}").cast("string"), F.col(f"l.{row_id}").cast("string")),
        ).alias("next_cursor"),
    )


def cap_verdicts(rows: DataFrame, caps: Sequence[int]) -> DataFrame:
    """(cap, refused): whether ``guarded`` refuses the rows, for each cap; the largest cap bounds what is counted."""
    n = rows.limit(max(caps) + 1).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.explode(F.array(*[F.lit(c).cast("long") for c in caps])).alias("cap"), "n").select("cap", (F.col("n") > F.col("cap")).alias("refused"))


def guarded(rows: DataFrame, cap: int) -> DataFrame:
    """All rows, or an error as soon as there are more than ``cap`` of them.

    A refusal, not a truncation: nothing is returned from an oversized input.
    """
    n = rows.limit(cap + 1).agg(F.count(F.lit(1)).alias("n")).scalar()
    refuse = F.raise_error(f"more than {cap} rows").cast("boolean")
    return rows.where(F.when(n <= cap, True).otherwise(refuse))
