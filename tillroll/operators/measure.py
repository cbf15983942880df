"""Flags, first-match rules and shares of a total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column, yes: str = "Yes", no: str = "No") -> Column:
    """Two-valued text flag; a NULL condition falls to ``no`` (CASE semantics)."""
    return F.when(cond, F.lit(yes)).otherwise(F.lit(no))


def first_match(rules: Sequence[tuple[Column, Column]], default: Column) -> Column:
    """Searched CASE: the first rule whose condition holds gives the value."""
    out = None
    for cond, value in rules:
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return default if out is None else out.otherwise(default)


def price_of(name: Column, prices: dict[str, float | int], default: float | int) -> Column:
    """Price looked up from a name -> price map, ``default`` for other names."""
    return first_match([(name == k, F.lit(v)) for k, v in prices.items()], F.lit(default))


def share(part: Column, total: Column, scale: int = 0, integer: bool = False) -> Column:
    """100 * part / total rounded half-up to ``scale`` places.

    ``integer=True`` keeps integer division (the quotient is cut before rounding,
    so 2/3 gives 66); otherwise the division is exact decimal arithmetic.
    """
    hundred = F.lit(100).cast("bigint") * part.cast("bigint")
    if integer:
        return F.call_function("div", hundred, total.cast("bigint")).cast("double")
    q = hundred.cast("decimal(20,0)") / total.cast("decimal(20,0)")  # decimal(38,18)
    return F.round(q, scale).cast("double")


def round_ratio(part: Column, whole: Column, scale: int) -> Column:
    """part / whole rounded half-up (away from zero) to ``scale`` places, once.

    A decimal quotient has already been rounded to the places its type has room for, and rounding
    it again can cross a half.  So the hundredths (say) are found by integer division: both numbers
    are scaled to whole numbers first.  NULL if either is NULL or ``whole`` is 0.
    """
    exact = "decimal(38,0)"
    top = F.abs(part.cast("decimal(32,6)") * 1_000_000).cast(exact)
    bottom = F.abs(whole.cast("decimal(32,6)") * 1_000_000).cast(exact)
    bottom = F.when(bottom != 0, bottom)
    steps = F.call_function("div", top * (2 * 10 ** scale) + bottom, bottom * 2)
    sign = F.when((part < 0) != (whole < 0), -1).otherwise(1)
    return (sign * steps).cast("double") / F.lit(float(10 ** scale))
