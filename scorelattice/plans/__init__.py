"""Registered queries, by family."""

from . import admission, audits, changes, extraction, governance, identity, leaderboard, operations, scalars, streams  # noqa: F401
from .registry import CHECK_SQL, QUERIES  # noqa: F401
