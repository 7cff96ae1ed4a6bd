"""Numeric, date and bucket expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Left-closed age buckets.
AGE_EDGES = (0, 18, 30, 45, 55, 65, 75, 85, 200)
AGE_LABELS = ("<18", "18-29", "30-44", "45-54", "55-64", "65-74", "75-84", "85+")


def parse_ts_coerce(value: Column) -> Column:
    """Timestamp of a string; anything unreadable gives null."""
    return F.try_to_timestamp(value.cast("string"))


def year_of(value: Column) -> Column:
    """Calendar year, null for anything unreadable."""
    return F.year(parse_ts_coerce(value))


def length_of_stay(admitted: Column, discharged: Column) -> Column:
    """Days between two timestamps, with fraction; null if either is null."""
    micros = F.unix_micros(discharged) - F.unix_micros(admitted)
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def numeric_coerce(value: Column) -> Column:
    """Number of a string; anything unreadable gives 0."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def age_bucket(age: Column) -> Column:
    """Label of the bucket an age falls in, null outside all of them."""
    tests = zip(AGE_EDGES, AGE_EDGES[1:], AGE_LABELS)
    labels = [F.when((age >= low) & (age < high), F.lit(name)) for low, high, name in tests]
    return F.coalesce(*labels)


def clip_upper(value: Column, limit: int) -> Column:
    """The value, at most ``limit``; null stays null."""
    return F.when(value > limit, F.lit(limit)).otherwise(value)


def real_year_approx(admitted: Column, anchor_year: Column, year_group: Column) -> Column:
    """Undo a per-person date shift to within the width of the anchor group.

    ``year_group`` reads like ``2014 - 2016``; its midpoint stands for the anchor year.
    """
    bounds = [F.regexp_extract(year_group, r"(\d{4})\s*-\s*(\d{4})", i) for i in (1, 2)]
    total = reduce(lambda a, b: a + b, [b.try_cast("int") for b in bounds])
    return F.year(admitted) - anchor_year + total / 2


def percent(part: Column, total: Column, digits: int | None = None) -> Column:
    """``part`` as a percentage of ``total``; an empty total counts as 1. Unrounded by default."""
    value = part / F.greatest(total, F.lit(1)) * F.lit(100.0)
    return value if digits is None else F.round(value, digits)


def sigmoid(margin: Column) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def safe_ratio(part: Column, total: Column) -> Column:
    """``part / total`` as a double, 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part.cast("double") / total.cast("double"))
