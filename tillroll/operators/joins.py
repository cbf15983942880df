"""Joins that compare a date with a per-key reference date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    "==": lambda a, b: a == b,
}


def join_relative_to(df: DataFrame, ref: DataFrame, key: str, date: str, ref_date: str,
                     op: str) -> DataFrame:
    """Inner join on ``key`` keeping rows whose ``date`` stands in relation ``op`` to
    the key's ``ref_date`` (sales on/after or before the join date).

    Planned as an equi-join on ``key`` with a residual filter -- hash or sort-merge,
    never a nested loop.  ``ref`` has one row per key.  Every row of ``df`` meets its
    key, so a key that holds a large share of ``df`` stays in one task when what
    follows needs the rows of a key together; reduce ``df`` first then
    (``dates_relative_to``).
    """
    cond = _OPS[op](df[date], ref[ref_date])
    return df.join(ref, on=[df[key] == ref[key]], how="inner").filter(cond).drop(ref[key])


def dates_relative_to(df: DataFrame, ref: DataFrame, key: str, date: str, ref_date: str, op: str) -> DataFrame:
    """The distinct (key, date) of ``df`` in relation ``op`` to the key's ``ref_date``, which is kept.

    Reduced before the join: a key sends a row per task and date, however many rows it has.
    """
    return join_relative_to(df.select(key, date).distinct(), ref.select(key, ref_date), key, date, ref_date, op)


def rows_on_edge_date(df: DataFrame, ref: DataFrame, key: str, date: str, ref_date: str, op: str,
                      edge: Callable[[str], Column] = F.min) -> DataFrame:
    """The rows of ``df`` on each key's first (``F.max``: last) date in relation ``op`` to ``ref_date``.

    The date is found on distinct dates and joined back on (key, date), so only the rows of one
    date of a key ever meet.
    """
    found = dates_relative_to(df, ref, key, date, ref_date, op).groupBy(key).agg(edge(date).alias(date))
    return df.join(found, [key, date], "left_semi")
