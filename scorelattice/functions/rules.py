"""Ordered rule lists as columns.

A rule is a ``(condition, code)`` pair, or a column that already is a code or
null.  ``first_failure`` keeps the code of the first rule that holds;
``all_failures`` keeps every one.  A null condition counts as not holding, so
rules can look at columns that come from outer joins.  A rule that guards what
may pass says so with ``refuse``: there a null, an unknown fact, refuses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Rule = tuple[Column, "str | Column"] | Column


def refuse(condition: Column, code: str | Column) -> tuple[Column, str | Column]:
    """A rule that also holds where its condition is unknown."""
    return F.coalesce(condition, F.lit(True)), code


def _code(rule: Rule) -> Column:
    if isinstance(rule, Column):
        return rule
    condition, code = rule
    return F.when(condition, F.lit(code) if isinstance(code, str) else code)


def first_failure(rules: Sequence[Rule]) -> Column:
    return F.coalesce(*[_code(rule) for rule in rules])


def all_failures(rules: Sequence[Rule]) -> Column:
    """Sorted array of the distinct codes whose condition holds."""
    hits = F.array(*[_code(rule) for rule in rules])
    return F.array_sort(F.array_distinct(F.array_compact(hits)))

