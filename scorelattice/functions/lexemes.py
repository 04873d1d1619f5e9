"""Exact spellings that Spark's own readers and formatters would change.

A JSON number such as ``71.2500`` or ``1e-3`` must stay as the source wrote it,
and a computed mean must be spelled with exact binary rounding.  Both need
Python, but for JSON in plain spelling; everything after them stays in built-in
expressions.
"""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import arrow_udf, pandas_udf


# Plain spelling: no blanks between tokens; no escapes, no colons and ASCII only within texts.
# A colon then always stands before a value, and what stands there can be told without a parser.
_TEXT = r'"[ !#-9;-\[\]-~]*+"'
_NUMBER = r"-?+(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+"
_VALUE = f"(?:{_TEXT}|{_NUMBER})"


def _listed(item: str) -> str:
    return rf"\[{item}(?:,{item})*+\]"


_SCORED = rf'(?:,"mean":{_VALUE})?+(?:,"value":{_VALUE})?+\}}'
_METRIC = rf'\{{"name":{_TEXT}(?:,"split":{_TEXT})?+{_SCORED}'
_STAT = rf'\{{"name":\{{"name":{_TEXT}(?:,"split":{_TEXT})?+\}}{_SCORED}'
_GROUPED_RUN = rf'\{{"(?:run_name|model)":{_TEXT},"metrics":{_listed(_METRIC)}\}}'
_GROUP = rf'\{{"runs":{_listed(_GROUPED_RUN)}\}}'
_LISTED_RUN = rf'\{{"run_spec":\{{"adapter_spec":\{{"model":{_TEXT}\}}\}},"stats":{_listed(_STAT)}\}}'
#: Evaluation runs, grouped or listed, without further keys; no key can repeat.
_RUNS = rf'\A(?:\{{"groups":{_listed(_GROUP)}\}}|{_listed(_LISTED_RUN)})\z'
#: Java's matcher recurses over repeated groups, so longer documents go to the parser.
_PLAIN_LENGTH = 4000


def _is_plain(document: Column, shape: str) -> Column:
    return F.coalesce((F.length(document) <= _PLAIN_LENGTH) & document.rlike(shape), F.lit(False))


class _Number(str):
    """Text of a JSON number token."""


def _refuse_constant(name: str):
    raise ValueError(name)


def _no_repeats(pairs):
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _decoder(number) -> json.JSONDecoder:
    return json.JSONDecoder(
        parse_int=number, parse_float=number, parse_constant=_refuse_constant, object_pairs_hook=_no_repeats
    )


_TAGGING, _SPELLING = _decoder(_Number), _decoder(str)
_QUICK = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse_constant)
_ENCODER = json.JSONEncoder(ensure_ascii=False)


def _tagged(value) -> str | None:
    """``n:`` for numbers, ``s:`` for text, ``o:`` for anything else but null."""
    if value is None:
        return None
    if isinstance(value, str):
        return ("n:" if isinstance(value, _Number) else "s:") + value
    return "o:" + json.dumps(value, ensure_ascii=False)


def _flat_keys(node) -> int:
    """Keys of an object of lists of objects, not looking deeper."""
    if not isinstance(node, dict):
        return -1
    return len(node) + sum(len(row) for rows in node.values() if isinstance(rows, list) for row in rows if isinstance(row, dict))


def _collection(text: str | None, path: list[str]) -> list[list[tuple[str, str | None]] | None] | None:
    try:
        node = _QUICK.decode(text)
        # With as many keys as colons none was repeated; otherwise keys are compared.
        if _flat_keys(node) != text.count(":"):
            node = _TAGGING.decode(text)
    except (TypeError, ValueError, RecursionError):
        return None
    for step in path:
        if isinstance(node, list) and step.isdigit() and int(step) < len(node):
            node = node[int(step)]
        elif isinstance(node, dict) and step in node:
            node = node[step]
        else:
            return None
    if not isinstance(node, list):
        return None
    return [
        [
            (k, ("n:" if type(v) is _Number else "s:") + v if isinstance(v, str) else _tagged(v))
            for k, v in row.items()
        ] if isinstance(row, dict) else None
        for row in node
    ]


def _spelled(text: str | None) -> str | None:
    try:
        node = _SPELLING.decode(text)
    except (TypeError, ValueError, RecursionError):
        return None
    return _ENCODER.encode(node)


@arrow_udf(T.StringType())
def _spell_numbers(documents: pa.Array) -> pa.Array:
    return pa.array([None if d is None else _spelled(d) for d in documents.to_pylist()], type=pa.string())


_spell_numbers = _spell_numbers.asNondeterministic()


def with_spelled_numbers(documents: DataFrame, name: str) -> DataFrame:
    """Documents with the numbers of a JSON column as text, spelled as the source spells them.

    Null for a document that is malformed or repeats a key.  Evaluation runs that
    are written plainly need no parser: their numbers are put in quotes.
    """
    plain = F.when(_is_plain(F.col(name), _RUNS), F.regexp_replace(name, f":({_NUMBER})", ':"$1"'))
    marked = documents.withColumn("_plain", plain)
    return marked.withColumn(
        name, F.coalesce("_plain", _spell_numbers(F.when(F.col("_plain").isNull(), F.col(name))))
    ).drop("_plain")


_RECORDS = pa.list_(pa.map_(pa.string(), pa.string()))


@arrow_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
def _decode(documents: pa.Array, paths: pa.Array) -> pa.Array:
    found = [
        None if d is None or p is None else _collection(d, p)
        for d, p in zip(documents.to_pylist(), paths.to_pylist())
    ]
    return pa.array(found, type=_RECORDS)


# Spark copies deterministic expressions into filters it derives, and so would
# decode every document twice.
_decode = _decode.asNondeterministic()


def exact_records(document: Column | str, path: Column) -> Column:
    """Records of the list at each document's path (an array of steps as text).

    Null for a document that is malformed, repeats a key, or has no such list;
    list entries that are no objects come out as null maps so that positions
    keep their meaning.
    """
    return _decode(document, path)


def text_field(record: Column, name: Column | str) -> Column:
    """The field's value when the source wrote it as text."""
    value = F.element_at(record, F.lit(name) if isinstance(name, str) else name)
    return F.when(value.startswith("s:"), F.substr(value, F.lit(3)))


def score_field(record: Column, name: Column | str) -> Column:
    """The field's spelling when the source wrote it as text or as a number."""
    value = F.element_at(record, F.lit(name) if isinstance(name, str) else name)
    return F.when(
        value.startswith("s:") | value.startswith("n:"), F.substr(value, F.lit(3))
    )


def fixed_text(value: Column, digits: int) -> Column:
    """``%.Nf`` text rounded on the exact binary value."""

    @pandas_udf(T.StringType())
    def spell(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else f"{v:.{digits}f}")

    return spell(value)


@pandas_udf(T.StringType())
def real_lexeme(values: pd.Series) -> pd.Series:
    """Shortest text that reads back as the double: 12345678.5, 0.0001, 1e+16."""
    return values.map(repr)
