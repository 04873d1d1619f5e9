"""Durations and slot arithmetic on whole seconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The accepted duration spelling.
DURATION_PATTERN = r"^P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less UTC timestamp."""
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("MICROSECOND", origin, ts)


def epoch_seconds(ts: Column) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(1_000_000)).cast("long")


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 day/time duration; null when malformed or zero."""

    def unit(group: int, size: int) -> Column:
        digits = F.regexp_extract(text, DURATION_PATTERN, group)
        return F.coalesce(digits.try_cast("long"), F.lit(0)) * size

    total = unit(1, 86_400) + unit(2, 3_600) + unit(3, 60) + unit(4, 1)
    return F.when(text.rlike(DURATION_PATTERN) & (total >= 1), total)


def slot_ordinal(seconds: Column, anchor: int, cadence: int) -> Column:
    """Ordinal of the latest slot at or before a moment; null before the anchor."""
    return F.when(
        seconds >= anchor, F.floor((seconds - anchor) / F.lit(cadence)).cast("long")
    )


def slot_start(ordinal: Column, anchor: int, cadence: int) -> Column:
    return F.lit(anchor) + ordinal * cadence
