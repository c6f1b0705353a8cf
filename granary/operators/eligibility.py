"""Predicates that decide which evidence and which profile a request may use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_place(owner: tuple[Column, Column, Column], asked: tuple[Column, Column, Column]) -> Column:
    """A place (country, canton, municipality) covers those below it; a null level is a wildcard, never the other way up."""
    country, *below = zip(owner, asked, strict=True)
    out = country[0] == country[1]
    for mine, theirs in below:
        out = out & (mine.isNull() | mine.eqNullSafe(theirs))
    return out


def specificity(canton: Column, municipality: Column) -> Column:
    return F.when(municipality.isNotNull(), 2).when(canton.isNotNull(), 1).otherwise(0)


def covers_day(first: Column, last: Column, day: Column) -> Column:
    """Closed on both sides; a null bound is open."""
    return (first.isNull() | (first <= day)) & (last.isNull() | (day <= last))


def holds(operator: Column, value: Column, expected: Column) -> Column:
    """A context condition on values as text; a missing value fails all but ``absent``, negations too."""
    there = value.isNotNull()
    inside = F.coalesce(F.array_contains(expected, value), F.lit(False))
    return (
        F.when(operator == "present", there)
        .when(operator == "absent", ~there)
        .when(operator.isin("equals", "in"), there & inside)
        .when(operator.isin("not_equals", "not_in"), there & ~inside)
        .otherwise(F.lit(False))
    )


def first_failure(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that isn't true, null if all are."""
    out = None
    for name, ok in checks:
        failed = ~F.coalesce(ok, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out
