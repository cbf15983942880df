"""Ranking, top-k and keep-the-maximum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def top_ranked(df: DataFrame, by: Sequence[str], order: Sequence[str | Column],
               n: int = 1, ties: bool = True, rank_col: str | None = None) -> DataFrame:
    """Rows ranked within ``n`` places per ``by`` group (``rank()``, so ties are all
    kept; ``ties=False`` uses ``row_number()``).

    The filter on the rank lets Catalyst insert a WindowGroupLimit.  Where ``df`` is
    not yet partitioned by ``by``, a partial one runs before the shuffle: every map
    task keeps only the leading rows of each group, so a group holding a third of
    all rows is cut down before it reaches one task.  After a join on ``by`` there
    is no such shuffle; reduce the rows before the join instead.
    """
    w = Window.partitionBy(*by).orderBy(*_cols(order))
    fn = F.rank() if ties else F.row_number()
    name = rank_col or "_rank"
    ranked = df.withColumn(name, fn.over(w)).filter(F.col(name) <= n)
    return ranked if rank_col else ranked.drop(name)


def top_n(df: DataFrame, order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """Global top ``n`` (ORDER BY ... LIMIT n).  Put a unique tie-break last in
    ``order`` so the kept rows do not depend on the plan.  Planned as
    TakeOrderedAndProject: each task keeps its own ``n`` best rows."""
    return df.orderBy(*_cols(order)).limit(n)


def keep_max(df: DataFrame, col: str) -> DataFrame:
    """Rows whose ``col`` equals the overall maximum, ties kept.  The maximum is an
    uncorrelated scalar subquery (a one-row partial/final aggregate), never a
    window over the whole table."""
    top = df.agg(F.max(col)).scalar()
    return df.filter(F.col(col) == top)
