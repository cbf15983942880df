"""List columns: explode to rows, apply removals and additions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_list


def explode_list(df: DataFrame, col: str, as_: str, keep: Sequence[str] = (),
                 sep: str = ",", element_type: str | None = "int") -> DataFrame:
    """One row per list element ('1, 5' -> rows 1 and 5).  Empty and NULL lists give
    no row (``explode``, not ``explode_outer``)."""
    return df.select(*keep, F.explode(split_list(col, sep, element_type)).alias(as_))


# Kinds of rows in ``apply_tagged``.
BASE, REMOVED, ADDED = 0, 1, 2


def tagged(ids: Column, tag: int) -> Column:
    """Array of (id, tag) for an array of ids."""
    return F.arrays_zip(ids.alias("id"), F.array_repeat(F.lit(tag), F.size(ids)).alias("tag"))


def repeat_rows(df: DataFrame, times: str, chunk: int = 100_000) -> DataFrame:
    """Every row as often as its ``times`` says (dropped), by arrays of ``chunk`` elements at most."""
    n = F.col(times).cast("bigint")
    last = F.call_function("div", n - 1, F.lit(chunk))
    chunks = df.filter(n > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    size = F.least(F.lit(chunk).cast("bigint"), n - F.col("_chunk") * chunk).cast("int")
    return chunks.withColumn("_one", F.explode(F.array_repeat(F.lit(1), size))).drop(times, "_chunk", "_one")


def apply_tagged(rows: DataFrame, tag: str = "_tag") -> DataFrame:
    """(base EXCEPT removed) UNION ALL added for rows that say in ``tag`` which of the three they belong to.

    One aggregate over all other columns (null-safe, combined before its one shuffle): a row of the
    base stays once unless it is removed, and comes again for every time it is added.
    """
    cols = [c for c in rows.columns if c != tag]
    seen = rows.groupBy(*cols).agg(F.max(F.col(tag) == BASE).alias("_base"), F.max(F.col(tag) == REMOVED).alias("_removed"),
                                   F.count(F.when(F.col(tag) == ADDED, 1)).alias("_added"))
    kept = F.when(F.col("_base") & ~F.col("_removed"), 1).otherwise(0)
    return repeat_rows(seen.select(*cols, (kept + F.col("_added")).alias("_times")), "_times")


def apply_changes(base: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(base EXCEPT removed) UNION ALL added, by column name.

    EXCEPT is distinct and null-safe; the added rows keep their multiplicity, which
    is what the quantity of an ingredient counts.  The three meet in one union and one
    aggregate (``apply_tagged``).
    """
    cols = base.columns
    parts = [part.select(*cols, F.lit(tag).alias("_tag")) for part, tag in ((base, BASE), (removed, REMOVED), (added, ADDED))]
    return apply_tagged(parts[0].unionByName(parts[1]).unionByName(parts[2]))
