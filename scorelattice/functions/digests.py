"""Identity digests over canonical text.

The canonical form of a record is a JSON object whose keys are in alphabetical
order and whose nulls are kept, so equal records always give equal text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

_NULL = "∅"


def canonical_json(fields: Mapping[str, Column]) -> Column:
    """Alphabetical keys, nulls kept; non-text values by their own JSON form."""
    parts = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def identity_digest(fields: Mapping[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def json_string(value: Column) -> Column:
    """The value as a JSON string, null as ``null``; spelled as any JSON writer would."""
    quoted = F.to_json(F.array(value.cast("string")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def spaced_object(fields: Mapping[str, Column]) -> Column:
    """A JSON object in key order with a blank after each comma and colon; values are JSON text already."""
    parts = [F.concat(F.lit(f'"{name}": '), fields[name]) for name in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def spaced_map(entries: Column) -> Column:
    """A map of text as a JSON object in key order, null as ``null``."""
    ordered = F.array_sort(F.map_entries(entries))
    parts = F.transform(ordered, lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])))
    return F.when(entries.isNull(), F.lit("null")).otherwise(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")))


#: The fields that make a claim the same claim, besides its place in the evidence.
CLAIM_FIELDS = (
    "official_source_id", "source_snapshot_id", "source_revision_decision_id", "model_raw", "benchmark_raw", "score_raw",
    "metric_raw", "split_raw", "setting_raw", "evaluation_version_raw", "rank_raw", "date_raw", "score_unit",
)


def claim_fingerprint(location: Column, fields: Mapping[str, Column] | None = None) -> Column:
    """Digest of a claim's fourteen identifying fields; fields that are not given are null.

    ``location`` is the place in the evidence, a map of text.
    """
    given = fields or {}
    unknown = sorted(set(given) - set(CLAIM_FIELDS))
    if unknown:
        raise ValueError(f"no fields of a claim: {unknown}")
    texts = {name: json_string(given[name]) if name in given else F.lit("null") for name in CLAIM_FIELDS}
    return F.sha2(spaced_object({**texts, "evidence_location": spaced_map(location)}), 256)


def set_like(values: Column) -> Column:
    """Order-free view of an array column, for use inside a digest."""
    return F.array_sort(F.array_distinct(values))


def typed_text(kind: str, value: Column) -> Column:
    """``kind:text`` with its own mark for null, so 1, '1' and null all differ."""
    return F.coalesce(F.concat(F.lit(f"{kind}:"), value.cast("string")), F.lit(_NULL))


def row_text(columns: Mapping[str, Column]) -> Column:
    """One line per row: name=typed text, in name order, unit-separated."""
    return F.concat_ws(
        "\x1f", *[F.concat(F.lit(f"{n}="), columns[n]) for n in sorted(columns)]
    )


def derived_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the digest of the parts in the given order."""
    return F.concat(
        F.lit(f"{prefix}-"),
        F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit(_NULL)) for p in parts]), 256),
    )
