"""Functions of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evseq import schema
from evseq.functions.codes import col


def whole_hours(start, end) -> Column:
    """Whole seconds over 3600, as for subjects."""
    return F.timestamp_diff("SECOND", col(start), col(end)) / F.lit(3600.0)


def hours(start, end) -> Column:
    """With fractions of seconds, as for stays; null counts as 0."""
    return F.coalesce(F.timestamp_diff("MICROSECOND", col(start), col(end)) / F.lit(3.6e9), F.lit(0.0))


def age_at(time, anchor_age="anchor_age", anchor_year="anchor_year", year_of_birth="year_of_birth") -> Column:
    y = F.year(col(time))
    return F.greatest(F.coalesce(col(anchor_age) + y - col(anchor_year), y - col(year_of_birth)), F.lit(0))


def died_within(death, start, days: int = 28) -> Column:
    """1 if death is between start and start + days, both included; else, and for nulls, 0."""
    return F.coalesce(col(death).between(col(start), col(start) + F.expr(f"interval {days} days")), F.lit(False)).cast("int")


def age_from_elapsed(elapsed) -> Column:
    """Years since the first event (not since birth), for each element."""
    return F.transform(col(elapsed), lambda x: F.floor(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)) / schema.HOURS_PER_YEAR).cast("int"))


def estimated_age(tokens, elapsed) -> Column:
    """age_from_elapsed above the age at MEDS_BIRTH, or above 25 without it."""
    at = F.array_position(col(tokens), "MEDS_BIRTH")
    base = F.coalesce(F.when(at > 0, F.floor(F.get(col(elapsed), (at - 1).cast("int")) / schema.HOURS_PER_YEAR)), F.lit(schema.DEFAULT_AGE)).cast("int")
    return F.transform(age_from_elapsed(elapsed), lambda x: x + base)


def in_icu(time, intime) -> Column:
    return (col(time) >= col(intime)).cast("int")
