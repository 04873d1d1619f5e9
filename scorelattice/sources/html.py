"""Pages of a snapshot table taken apart into tables and inline scripts.

Python only tokenises one page at a time; choosing tables, matching columns and
turning cells into claims is column work on the arrays that come out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import fold_header


class _Tables(HTMLParser):
    """Cell texts by table and row; nested tables count as tables of their own.

    Each open table remembers whether it is inside a cell, so a cell's text goes
    on after a table within it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[str]]] = []
        self.open: list[list] = []  # rows, and whether a cell takes text

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([[], False])
            self.done.append(self.open[-1][0])
        elif self.open and tag == "tr":
            self.open[-1][0].append([])
            self.open[-1][1] = False
        elif self.open and tag in ("td", "th") and self.open[-1][0]:
            self.open[-1][0][-1].append("")
            self.open[-1][1] = True

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        elif tag in ("td", "th", "tr") and self.open:
            self.open[-1][1] = False

    def handle_data(self, data):
        if self.open and self.open[-1][1] and self.open[-1][0][-1]:
            self.open[-1][0][-1][-1] += data


class _Scripts(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.found: list[dict] = []
        self.ids: list[str] = []
        self.inside = False

    def handle_starttag(self, tag, attrs):
        names = [name for name, _ in attrs]
        values = dict(reversed(attrs))
        if values.get("id") is not None:
            self.ids.append(values["id"])
        if tag == "script":
            self.inside = True
            self.found.append(
                {
                    "script_id": values.get("id"),
                    "script_type": values.get("type"),
                    "has_src": "src" in names,
                    "repeated_attribute": len(set(names)) < len(names),
                    "content": "",
                }
            )

    def handle_startendtag(self, tag, attrs):
        self.ids += [v for n, v in attrs if n == "id" and v is not None][:1]

    def handle_data(self, data):
        if self.inside:
            self.found[-1]["content"] += data

    def handle_endtag(self, tag):
        self.inside = False if tag == "script" else self.inside


def _feed(parser: HTMLParser, html: str | None):
    if html is not None:
        parser.feed(html)
        parser.close()
    return parser


# Tags whose content is markup like any other.
_PLAIN = frozenset(
    "td tr th table thead tbody tfoot caption html head body main section article div span p br hr a b i u em strong small "
    "sub sup code h1 h2 h3 h4 h5 h6 ul ol li".split()
)
# A tag in its plainest spelling, or the text up to the next tag.
_TOKEN = re.compile(
    r'<(?:([a-z][a-z0-9]*)(?:[ \t\n\r\f]+[a-z][a-z-]*(?:="[^"<>]*")?)*|/([a-z][a-z0-9]*))>|([^<]+)', re.IGNORECASE | re.ASCII
)


def _tables_of(html: str | None) -> list[list[list[str]]]:
    """The tables of a page; markup that is not of the plainest goes to the full parser.

    Does what the handlers of ``_Tables`` do, without their calls.
    """
    html = html or ""
    done, outer, rows, taking, end = [], [], None, False, 0
    for token in _TOKEN.finditer(html):
        if token.start() != end:
            break
        opened, closed, text = token.groups()
        if text is not None:
            if taking:
                rows[-1][-1] += unescape(text) if "&" in text else text
        elif opened is not None:
            tag = opened.lower()
            if tag not in _PLAIN:
                break
            if tag == "table":
                outer.append((rows, taking))
                rows, taking = [], False
                done.append(rows)
            elif rows is not None:
                if tag == "tr":
                    rows.append([])
                    taking = False
                elif rows and tag in ("td", "th"):
                    rows[-1].append("")
                    taking = True
        else:
            tag = closed.lower()
            if tag not in _PLAIN:
                break
            if tag == "table":
                if outer:
                    rows, taking = outer.pop()
            elif tag in ("td", "th", "tr"):
                taking = False
        end = token.end()
    return done if end == len(html) else _feed(_Tables(), html).done


def page_tables(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``(page id, tables)`` with tables as rows of cell texts."""
    key = pages.select(page_id).schema[0]

    cells = pa.list_(pa.list_(pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tables = pa.array([_tables_of(h) for h in batch.column(1).to_pylist()], type=cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), tables], names=[page_id, "tables"])

    schema = f"{page_id} {key.dataType.simpleString()}, tables array<array<array<string>>>"
    return pages.select(page_id, html).mapInArrow(run, schema)


def page_scripts(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """One row per script element, with how often its id occurs on the page."""
    key = pages.select(page_id).schema[0]
    columns = [
        page_id, "ordinal", "script_id", "script_type", "has_src", "repeated_attribute",
        "id_count", "content",
    ]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for pid, text in zip(batch[page_id], batch[html]):
                page = _feed(_Scripts(), text)
                rows += [
                    {page_id: pid, "ordinal": i, "id_count": page.ids.count(s["script_id"]), **s}
                    for i, s in enumerate(page.found)
                ]
            yield pd.DataFrame(rows, columns=columns)

    schema = (
        f"{page_id} {key.dataType.simpleString()}, ordinal int, script_id string, "
        "script_type string, has_src boolean, repeated_attribute boolean, id_count int, "
        "content string"
    )
    return pages.select(page_id, html).mapInPandas(run, schema)


def choose_script(scripts: DataFrame, page_id: str, script_id: str, script_type: str) -> DataFrame:
    """The one usable script of each page, or the reason there is none.

    Grouping is by page, and a page's scripts all came from that one page.
    """
    wanted = F.col("script_id") == script_id
    first = F.min_by(F.struct("has_src", "repeated_attribute", "script_type", "content"), F.when(wanted, F.col("ordinal")))
    per_page = scripts.groupBy(page_id).agg(
        F.count_if(wanted).alias("hits"),
        F.coalesce(F.max(F.when(wanted, F.col("id_count"))), F.lit(0)).alias("id_count"),
        first.alias("s"),
    )
    unusable = (
        F.col("s.has_src") | F.col("s.repeated_attribute")
        | ~F.col("s.script_type").eqNullSafe(F.lit(script_type))
    )
    reason = (
        F.when((F.col("id_count") > 1) | (F.col("hits") > 1), "EVIDENCE_SCRIPT_AMBIGUOUS")
        .when(F.col("hits") == 0, "EVIDENCE_NOT_FOUND")
        .when(unusable, "EVIDENCE_LOCATOR_INVALID")
    )
    return per_page.select(
        page_id, reason.alias("reason"), F.when(reason.isNull(), F.col("s.content")).alias("content")
    )


def _header_key(cell: Column) -> Column:
    return F.lower(fold_header(cell))


def table_claims(
    tables: DataFrame,
    page_id: str,
    model_column: str = "Model",
    score_column: str = "Score",
    table_index: int = 0,
    table_hint: str | None = None,
    optional: dict[str, str] | None = None,
) -> DataFrame:
    """One claim per usable row of the chosen table.

    The asked-for table is used if it has both columns; then the first table
    whose text holds the hint; then the first table with both columns.
    """
    optional = optional or {}
    wanted = [_header_key(F.lit(c)) for c in (model_column, score_column)]

    def headers(t: Column) -> Column:
        return F.transform(F.coalesce(F.get(t, F.lit(0)), F.array().cast("array<string>")), _header_key)

    def has_both(t: Column) -> Column:
        # An array of one, so that its header is folded once for both names.
        return F.exists(F.array(headers(t)), lambda h: F.array_contains(h, wanted[0]) & F.array_contains(h, wanted[1]))

    def table_text(t: Column) -> Column:
        return _header_key(F.array_join(F.flatten(t), " "))

    indexed = F.transform(F.col("tables"), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    # Only the table asked for is looked at here, so that its header is read once.
    at = F.lit(table_index)
    own = F.get(F.col("tables"), at)
    asked = F.array(F.when((at < F.size("tables")) & has_both(own), F.struct(at.cast("int").alias("i"), own.alias("t"))))
    hinted = (
        F.filter(indexed, lambda x: F.contains(table_text(x["t"]), _header_key(F.lit(table_hint))))
        if table_hint
        else F.filter(indexed, lambda x: F.lit(False))
    )
    scanned = F.filter(indexed, lambda x: has_both(x["t"]))
    chosen = F.coalesce(F.get(asked, F.lit(0)), F.get(hinted, F.lit(0)), F.get(scanned, F.lit(0)))
    # Kept one projection apart: the header positions are read once per page.
    picked = tables.select(page_id, chosen.alias("c")).where(F.col("c").isNotNull())

    def place(name: str) -> Column:
        at = F.array_position(F.col("h"), _header_key(F.lit(name)))
        return F.when(at > 0, at - 1)

    placed = (
        picked.withColumn("h", headers(F.col("c.t")))
        .withColumn("m", place(model_column))
        .withColumn("s", place(score_column))
    )
    for field, name in optional.items():
        placed = placed.withColumn(f"o_{field}", place(name))
    widest = F.greatest("m", "s", *[F.coalesce(f"o_{f}", F.lit(0)) for f in optional]) if optional else F.greatest("m", "s")
    rows = placed.where(F.col("m").isNotNull() & F.col("s").isNotNull()).withColumn(
        "widest", widest
    )
    body = rows.select("*", F.posexplode(F.slice(F.col("c.t"), 2, 1_000_000_000)).alias("row_index", "cells"))

    def cell(at: str) -> Column:
        text = F.trim(F.get("cells", F.col(at).cast("int")))
        return F.when(text != "", text)

    return (
        body.where(F.size("cells") > F.col("widest"))
        .select(
            page_id,
            F.col("c.i").alias("table_index"),
            "row_index",
            cell("m").alias("model_raw"),
            cell("s").alias("score_raw"),
            *[cell(f"o_{f}").alias(f) for f in optional],
        )
        .where(F.col("model_raw").isNotNull() & F.col("score_raw").isNotNull())
    )
