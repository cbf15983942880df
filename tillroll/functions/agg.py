"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_concat(value: str, *order: str, sep: str = ", ") -> Column:
    """string_agg(value, sep) in a stated order: the ``order`` columns, then the
    value itself (``listagg ... WITHIN GROUP (ORDER BY ...)``).  NULL values are
    skipped; a group without values gives NULL.

    Arguments are column names.  Used on groups whose size is bounded by
    construction (the toppings of one recipe or one order item).
    """
    if "'" in sep:
        raise ValueError("separator may not contain a quote")
    keys = ", ".join(f"`{k}`" for k in (*order, value))
    return F.expr(f"listagg(`{value}`, '{sep}') WITHIN GROUP (ORDER BY {keys})")


def name_key(value: str | Column, collation: str = "UNICODE") -> Column:
    """Sort key for names, by a collation (ICU's root order by default, as language-aware databases
    sort: 'Bacon' < 'BBQ Sauce' < 'Beef'; 'Tomato Sauce' < 'Tomatoes'; 'Eclair' < 'Éclair' < 'Edam')."""
    v = F.col(value) if isinstance(value, str) else value
    return F.collate(v, collation)
