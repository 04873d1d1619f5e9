"""Scans that keep where each row came from, and their header checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.digests import canonical_json
from ..functions.lexemes import real_lexeme
from ..functions.text import is_json
from .csvblocks import csv_records, csv_split


def lexeme(df: DataFrame, name: str) -> Column:
    """A cell as source text: text and numbers keep their spelling, others are null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        # A 32-bit value is spelled as the double it is, in the shortest text that reads back.
        return F.when(F.col(name).isNotNull(), real_lexeme(F.col(name).cast("double")))
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.decode(F.col(name), "UTF-8")
    return F.lit(None).cast("string")


def parquet_cells(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns as lexemes with an exact ``(file_path, row_index)`` locator."""
    df = spark.read.parquet(path)
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return df.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.row_index").alias("row_index"),
        *[lexeme(df, c).alias(c) for c in columns],
    )


def row_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows per file; no column is read."""
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file_path"))
    return files.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_rows"))


def numbered_records(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """CSV records as text with their 0-based number within each file, and ``bad`` for a wrong width.

    Files are read in blocks, side by side, whether or not quoted fields span
    lines.  Empty cells are empty text; blank lines are no records.
    """
    return _fields(csv_records(spark, path), names)


def _fields(records: DataFrame, names: Sequence[str]) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in (*names, "bad"))
    options = {
        "quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\x00", "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": "bad", "maxCharsPerColumn": "-1",
    }
    read = records.select("file_path", "record_no", F.from_csv("record", schema, options).alias("r"))
    bad = F.col("r.bad")
    # The reader gives null for an empty cell; in a record of the right width no cell is missing.
    cells = [F.when(bad.isNull(), F.coalesce(F.col(f"r.{n}"), F.lit(""))).otherwise(F.col(f"r.{n}")).alias(n) for n in names]
    return read.select("file_path", *cells, bad.alias("bad"), "record_no")


def csv_cells(
    spark: SparkSession, path: str, columns: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """CSV rows as text with ``(file_path, row_index)``; the header must be exact.

    Every file's first record must equal the declared header.  Rows of another
    width carry ``well_formed = false``; cells they lack are null.
    """
    if len(set(columns)) < len(columns) or "" in columns:
        raise ValueError("header names must be unique and not empty")
    if set(required) - set(columns):
        raise ValueError(f"required columns missing: {sorted(set(required) - set(columns))}")
    names = [f"c{i}" for i in range(len(columns))]
    few, others = csv_split(spark, path)
    rows = _fields(others.unionByName(few), names)
    header_ok = F.col("bad").isNull() & (
        F.struct(*names) == F.struct(*[F.lit(c).alias(n) for c, n in zip(columns, names)])
    )
    wrong = _fields(few, names).where((F.col("record_no") == 0) & ~F.coalesce(header_ok, F.lit(False))).agg(
        F.count(F.lit(1)).alias("n")
    ).scalar()
    refuse = F.raise_error("unexpected CSV header").cast("boolean")
    return rows.where("record_no > 0").where(F.when(wrong == 0, True).otherwise(refuse)).select(
        "file_path",
        (F.col("record_no") - 1).alias("row_index"),
        *[F.col(n).alias(c) for n, c in zip(names, columns)],
        # Always true; Spark refuses to read the column of malformed records alone.
        (F.col("bad").isNull() & (F.char_length(F.coalesce(names[0], F.lit(""))) >= 0)).alias("well_formed"),
    )


def json_lines(lines: DataFrame, text: str, schema: str) -> DataFrame:
    """Parsed lines as ``record``; blank and malformed lines are left out."""
    parsed = F.from_json(F.trim(text), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    usable = is_json(F.trim(text))
    return lines.where(usable).withColumn("record", parsed)


def content_snapshots(artifacts: DataFrame, source: str, revision: str, content: str) -> DataFrame:
    """Artifacts keyed by source, revision and the digest of their bytes."""
    return artifacts.select(
        F.col(source).alias("source_id"),
        F.col(revision).alias("revision_id"),
        F.sha2(F.col(content).cast("binary"), 256).alias("content_hash"),
        F.col(content).alias("content"),
    )


def binary_artifacts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("content_hash"), "content")


def registry_union(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Registry parts as one set, each row tagged with the part it came from."""
    tagged = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def repeated_registry_ids(registry: DataFrame, id_column: str = "id") -> DataFrame:
    """Ids listed more than once over all parts, with the parts' count."""
    per_part = registry.groupBy(id_column, "part").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_part.groupBy(id_column)
        .agg(F.sum("n").alias("listed"), F.count(F.lit(1)).alias("parts"))
        .where("listed > 1")
    )


def registry_row_issues(registry: DataFrame) -> DataFrame:
    """Rows that break the registry shape, each with its first problem."""
    aliases = F.col("aliases")
    issue = (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "ID_BLANK")
        .when(aliases.isNull(), "ALIASES_NOT_A_LIST")
        .when(F.exists(aliases, lambda a: a.isNull() | (F.trim(a) == "")), "ALIAS_BLANK")
    )
    return registry.withColumn("issue", issue).where(F.col("issue").isNotNull())


def accepted_registry(registry: DataFrame, issues: DataFrame) -> DataFrame:
    """The whole registry when nothing is wrong with it, otherwise no row."""
    return registry.where(issues.agg(F.count(F.lit(1)).alias("n")).scalar() == 0)


def active_sources(sources: DataFrame, source_id: str | None = None, benchmark_id: str | None = None) -> DataFrame:
    kept = sources.where(F.col("status") == "active")
    if source_id is not None:
        kept = kept.where(F.col("source_id") == source_id)
    if benchmark_id is not None:
        kept = kept.where(F.col("benchmark_id") == benchmark_id)
    return kept.orderBy("source_id")


def newest_first(rows: DataFrame, created: str, row_id: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(created), F.desc(row_id)).limit(limit)


def canonical_rows(df: DataFrame) -> DataFrame:
    """Each row as one canonical JSON line."""
    return df.select(canonical_json({c: F.col(c) for c in df.columns}).alias("value"))
