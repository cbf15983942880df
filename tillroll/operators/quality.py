"""Data-quality operators: missing-value profiles, schema assertions, ratings checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FAKE_NULLS, is_fake_null


def missing_rows(df: DataFrame, cols: Sequence[str], text_cols: Sequence[str] = (),
                 sentinels: Iterable[str] = ("null",)) -> DataFrame:
    """Rows where any column is NULL, or any text column holds a fake null."""
    sentinels = list(sentinels)
    cond = None
    for c in cols:
        one = is_fake_null(c, sentinels) if c in text_cols else F.col(c).isNull()
        cond = one if cond is None else (cond | one)
    return df.filter(cond)


def missing_counts(df: DataFrame, cols: Sequence[str], text_cols: Sequence[str] = (),
                   sentinels: Iterable[str] = FAKE_NULLS) -> DataFrame:
    """One row: for every column the number of NULL / fake-null values."""
    sentinels = list(sentinels)
    aggs = []
    for c in cols:
        cond = is_fake_null(c, sentinels) if c in text_cols else F.col(c).isNull()
        aggs.append(F.count(F.when(cond, 1)).alias(f"{c}_missing"))
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs)


def parse_counts(df: DataFrame, unreadable: dict[str, Column], table: str,
                 sentinels: Iterable[str] = FAKE_NULLS) -> DataFrame:
    """table_name, column_name, rows, missing, unparseable: a row per column of ``unreadable``, which
    says when a value that is not missing cannot be read.  One aggregate over the table."""
    sentinels = list(sentinels)
    aggs = []
    for c, bad in unreadable.items():
        gone = is_fake_null(c, sentinels, blank=True)
        aggs += [F.count(F.when(gone, 1)).alias(f"{c}_missing"), F.count(F.when(~gone & bad, 1)).alias(f"{c}_bad")]
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    per_column = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_missing").alias("missing"),
                                    F.col(f"{c}_bad").alias("unparseable")) for c in unreadable])
    return counts.select("rows", F.explode(per_column).alias("x")).select(
        F.lit(table).alias("table_name"), "x.column_name", "rows", "x.missing", "x.unparseable")


def schema_of(df: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def assert_schema(df: DataFrame, expected: dict[str, str], table: str = "table") -> DataFrame:
    """Raise if ``df`` does not have exactly the ``expected`` column -> type map
    (types in Spark's simple form: 'int', 'decimal(10,2)', 'timestamp_ntz')."""
    actual = dict(schema_of(df))
    if actual != expected:
        missing = {k: v for k, v in expected.items() if actual.get(k) != v}
        extra = {k: v for k, v in actual.items() if k not in expected}
        raise AssertionError(f"{table}: schema differs; expected {missing}, unexpected {extra}")
    return df


def check_ratings(ratings: DataFrame, deliveries: DataFrame, key: str = "order_id",
                  rating: str = "rating", delivered: str = "pickup_time",
                  lo: int = 1, hi: int = 5) -> DataFrame:
    """Every rating with its checks: in range, one rating per key, key delivered.

    The per-key count is an aggregate joined back on the key (no window), and the
    delivery lookup is a left join, so no rating row is dropped.
    """
    per_key = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("ratings_per_order"))
    d = deliveries.select(key, F.col(delivered).isNotNull().alias("_delivered"))
    out = (ratings.join(per_key, key, "left")
                  .join(d, key, "left"))
    return out.select(
        key, rating,
        F.when(F.col(rating).between(lo, hi), "Y").otherwise("N").alias("rating_in_range"),
        F.when(F.col("ratings_per_order") == 1, "Y").otherwise("N").alias("unique_order"),
        F.when(F.col("_delivered"), "Y").otherwise("N").alias("delivered"),
    )
