"""Presentation arithmetic on score columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOT_SUPPLIED = "Not supplied"
NO_SCORE = "—"


def is_finite(value: Column) -> Column:
    inf = F.lit(float("inf"))
    return value.isNotNull() & ~F.isnan(value) & (value < inf) & (value > -inf)


def half_up(value: Column, digits: int = 0) -> Column:
    """floor(x + 0.5) on the binary double, the rounding browsers use."""
    scale = 10.0**digits
    return F.floor(value * scale + 0.5).cast("double") / scale


def raw_only(norm_kind: Column) -> Column:
    return F.coalesce(norm_kind == "raw_only", F.lit(False))


def presentation_value(
    value: Column,
    higher_is_better: Column,
    scale_max: Column,
    norm_kind: Column,
    norm_min: Column,
    norm_max: Column,
) -> Column:
    """Score on 0..1, larger is better; null where no declared domain holds it."""
    bounded = F.when(
        (norm_kind == "bounded") & value.between(norm_min, norm_max),
        (value - norm_min) / (norm_max - norm_min),
    )
    fallback = F.when(
        norm_kind.isNull() & (scale_max > 0) & value.between(F.lit(0.0), scale_max),
        value / scale_max,
    )
    unit = F.when(is_finite(value), F.coalesce(bounded, fallback))
    return F.when(higher_is_better, unit).otherwise(1 - unit)


def percent(unit: Column) -> Column:
    return half_up(unit * 100, 1)


def format_score(value: Column, scale_max: Column) -> Column:
    """One decimal on ten-point scales, whole numbers elsewhere, a dash for none."""
    tenths = F.format_string("%.1f", value)
    whole = half_up(value).cast("long").cast("string")
    return F.when(value.isNull(), NO_SCORE).when(scale_max == 10, tenths).otherwise(whole)


def format_context_window(thousands: Column) -> Column:
    return F.coalesce(F.concat(thousands.cast("string"), F.lit("k")), F.lit(NOT_SUPPLIED))


def format_open_weights(flag: Column) -> Column:
    return F.when(flag.isNull(), NOT_SUPPLIED).when(flag, "yes").otherwise("no")


def format_price_pair(price_in: Column, price_out: Column) -> Column:
    def shown(price: Column) -> Column:
        return F.coalesce(F.concat(F.lit("$"), price.cast("string")), F.lit(NOT_SUPPLIED))

    return F.concat(F.lit("in "), shown(price_in), F.lit(" / out "), shown(price_out))


def comparison_class(category: Column) -> Column:
    return F.when(category == "embedding", "embedding").otherwise("general")


def heat_position(value: Column, low: Column, high: Column, higher_is_better: Column) -> Column:
    """Place of a value between its column's extremes; null when they are equal."""
    span = F.when(high != low, (value - low) / (high - low))
    return F.when(higher_is_better, span).otherwise(1 - span)


def heat_alpha(position: Column) -> Column:
    return 0.24 + position * 0.58
