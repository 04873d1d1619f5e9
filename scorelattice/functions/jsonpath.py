"""The small JSON path subset evidence locators use: ``$``, ``.name``, ``[n]``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The path spelling.
PATH_PATTERN = r"^\$(?:\.[A-Za-z_][A-Za-z0-9_-]*|\[[0-9]+\])*$"
STEP_PATTERN = r"\.([A-Za-z_][A-Za-z0-9_-]*)|\[([0-9]+)\]"


def is_path(path: Column) -> Column:
    return F.coalesce(path.rlike(PATH_PATTERN), F.lit(False))


def resolve_error(document: Column, path: Column) -> Column:
    """``EVIDENCE_LOCATOR_INVALID``, ``EVIDENCE_NOT_FOUND`` or null."""
    found = F.call_function("get_json_object", document, path)
    return F.when(~is_path(path), "EVIDENCE_LOCATOR_INVALID").when(
        found.isNull(), "EVIDENCE_NOT_FOUND"
    )


def resolve(document: Column, path: Column) -> Column:
    return F.when(is_path(path), F.call_function("get_json_object", document, path))


def steps(path: Column) -> Column:
    """Array of the path's names and indexes as text, null for a bad path."""
    whole = F.regexp_extract_all(path, F.lit(STEP_PATTERN), F.lit(0))
    bare = F.transform(whole, lambda s: F.regexp_replace(s, r"[.\[\]]", ""))
    return F.when(is_path(path), bare)


def pointer(path: Column) -> Column:
    """JSON pointer of a path with ``~`` and ``/`` escaped; root is ``/``."""
    escaped = F.transform(
        steps(path),
        lambda s: F.concat(
            F.lit("/"), F.replace(F.replace(s, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
        ),
    )
    joined = F.array_join(escaped, "")
    return F.when(joined == "", "/").otherwise(joined)


def matches_template(path: Column, template: Column) -> Column:
    """Path equals the template with ``{row_index}`` replaced by one plain index."""
    parts = F.split(template, r"\{row_index\}")
    head, tail = parts[0], parts[1]
    index = F.substr(
        path,
        F.length(head) + 1,
        F.greatest(F.length(path) - F.length(head) - F.length(tail), F.lit(0)),
    )
    return F.coalesce(
        (F.size(parts) == 2)
        & path.startswith(head)
        & path.endswith(tail)
        & index.rlike("^(?:0|[1-9][0-9]*)$")
        & (path == F.concat(head, index, tail))
        & is_path(path),
        F.lit(False),
    )
