"""Writers with a fixed text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import visible_text
from .tables import canonical_rows

# The review file's columns, in file order.
REVIEW_COLUMNS = (
    "record_type", "claim_id", "official_source_id", "source_snapshot_id",
    "source_revision_decision_id", "benchmark_id", "captured_model_entity_id",
    "effective_model_entity_id", "effective_decision_id", "capture_status",
    "queue_reason_codes", "model_raw_b64", "model_raw_sha256", "model_raw_display",
    "next_cursor", "exhausted", "scanned", "emitted",
)


def review_rows(queue: DataFrame) -> DataFrame:
    """Queue rows in the review file's columns; absent values are empty text."""
    made = {
        "record_type": F.lit("claim"),
        "model_raw_b64": F.regexp_replace(F.base64(F.encode("model_raw", "UTF-8")), r"[\r\n]", ""),
        "model_raw_sha256": F.sha2("model_raw", 256),
        "model_raw_display": visible_text(F.col("model_raw")),
    }
    columns = []
    for name in REVIEW_COLUMNS:
        value = made.get(name)
        if value is None:
            value = F.col(name).cast("string") if name in queue.columns else F.lit(None)
        columns.append(F.coalesce(value, F.lit("")).alias(name))
    return queue.select(*columns)


def review_page_row(page: DataFrame) -> DataFrame:
    """The one page row of a review file."""
    given = {"record_type": F.lit("page"), **{c: F.col(c).cast("string") for c in page.columns}}
    return page.select(
        *[F.coalesce(given.get(n, F.lit(None)), F.lit("")).alias(n) for n in REVIEW_COLUMNS]
    )


def write_review_csv(page: DataFrame, queue: DataFrame, path: str) -> None:
    """Page row first, every field quoted, CRLF line ends.

    A review page is bounded by its page size, so it is one file.
    """
    rows = review_page_row(page).withColumn("_o", F.lit(0)).unionByName(
        review_rows(queue).withColumn("_o", F.lit(1))
    )
    rows.coalesce(1).sortWithinPartitions("_o", "claim_id").drop("_o").write.option(
        "header", True
    ).option("quoteAll", True).option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_canonical_json(df: DataFrame, path: str, order_by: list[str]) -> None:
    """Canonical JSON lines in key order, as many files as the data needs."""
    canonical_rows(df.orderBy(*order_by)).write.text(path)


def markdown_row(*cells: Column) -> Column:
    """One table row; pipes, line ends and backslashes are escaped."""

    def safe(cell: Column) -> Column:
        text = F.coalesce(cell.cast("string"), F.lit(""))
        return F.replace(
            F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")),
            F.lit("\n"),
            F.lit(" "),
        )

    return F.concat(F.lit("| "), F.concat_ws(" | ", *[safe(c) for c in cells]), F.lit(" |"))


def write_markdown(df: DataFrame, path: str) -> None:
    """Rows as a Markdown table body, one line each."""
    df.select(markdown_row(*[F.col(c) for c in df.columns]).alias("value")).write.text(path)
