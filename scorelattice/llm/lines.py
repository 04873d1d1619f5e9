"""Lines that many documents repeat (operator 10, built-in functions only).

The long lines of all documents become rows (two hashes of the line's key, the
document, the position).  They are range-partitioned by hash with the document
and position as secondary sort; a window streams through each range, marks the
first occurrence in every document and so counts documents.  A line that a
third of all documents share is split over ``SALTS`` ranges by document; the few
counts per line are then added up.  What comes back is not text but, for each
document, the runs of lines to keep: a run-length compressed bitmap.

Defined results: a null text is one empty line; a null id counts as one
document with the smallest id; rows that repeat an id are one document, each row
with its own lines; a line that occurs twice in a document counts once; an
empty table gives an empty result; other columns of the input are carried along
untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .common import BLANKS, LOWER, NO_ID, UPPER, fresh, whole_text

MIN_CHARS = 40
MIN_DOCS = 5
#: Ranges over which the documents of one line are dealt.
SALTS = 64


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (h1, h2, doc, body, pos) of all lines whose key is long enough."""
    folded = F.translate(F.col("text"), UPPER, LOWER)
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), whole_text().alias("text")
    ).select("doc", F.xxhash64("text").alias("body"), F.posexplode(F.split(folded, "\n", -1)).alias("pos", "line"))
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    return (
        lines.select("doc", "body", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "doc", "body", "pos")
    )


def repeated_keys(keys: DataFrame, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """Rows (h1, h2, last): the keys that ``min_docs`` documents hold, and the largest of those."""
    part = ["h1", "h2", "salt"]
    ranged = keys.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts))).repartitionByRange(*part)
    ordered = Window.partitionBy(*part).orderBy(F.desc("doc"), "body", "pos")
    before = F.lag("doc").over(ordered)
    first = ranged.withColumn("first", (before.isNull() | (before != F.col("doc"))).cast("long"))
    counted = first.groupBy(*part).agg(F.sum("first").alias("n"), F.max("doc").alias("last"))
    return (
        counted.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.max("last").alias("last"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last")
    )


def keep_runs(dropped: Column, n_lines: Column) -> Column:
    """The runs of kept lines (start from 0, length) between sorted dropped positions."""
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(-1)), dropped).alias("a"), F.concat(dropped, F.array(n_lines)).alias("b")
    )
    runs = F.transform(gaps, lambda g: F.struct((g["a"] + 1).alias("start"), (g["b"] - g["a"] - 1).alias("length")))
    return F.filter(runs, lambda r: r["length"] > 0)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """Rows (doc, body, dropped): the sorted positions that each document loses, if any.

    ``body`` is a hash of the text: rows that repeat an id keep their own lines.
    """
    keys = staged(line_keys(docs, min_chars))
    # Stored, so that the join reads two plain tables: its hot keys can be split, or the small side broadcast.
    repeated = staged(repeated_keys(keys, min_docs, salts))
    lost = (
        keys.join(repeated, ["h1", "h2"])
        .where(F.col("doc") < F.col("last"))
        .select("doc", "body", "pos")
    )
    return lost.groupBy("doc", "body").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def mark_lines(docs: DataFrame, out: str = "lines", **settings) -> DataFrame:
    """``docs`` with a struct ``out`` (n_lines, n_dropped, keep_runs) for each row."""
    doc, body, dropped = (fresh(docs, x) for x in ("_doc", "_body", "_dropped"))
    lost = dropped_lines(docs, **settings).toDF(doc, body, dropped)
    named = docs.withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), body: F.xxhash64(whole_text())}
    )
    joined = named.join(lost, [doc, body], "left")
    count = F.size(F.split(whole_text(), "\n", -1))
    gone = F.coalesce(F.col(dropped), F.array().cast("array<int>"))
    marks = F.struct(
        count.cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_dropped"),
        keep_runs(gone, count).alias("keep_runs"),
    )
    return joined.select(*docs.columns, marks.alias(out))


def kept_text(marks: str = "lines") -> Column:
    """The text without the lines that were dropped."""
    lines = F.split(whole_text(), "\n", -1)
    pieces = F.transform(F.col(f"{marks}.keep_runs"), lambda r: F.array_join(F.slice(lines, r["start"] + 1, r["length"]), "\n"))
    return F.when(F.col(f"{marks}.n_dropped") == 0, whole_text()).otherwise(F.array_join(pieces, "\n"))


def drop_repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the kept text in place of ``text``; all rows and columns stay."""
    marks = fresh(docs, "_marks")
    marked = mark_lines(docs, marks, **settings)
    return marked.withColumn("text", kept_text(marks)).select(*docs.columns)
