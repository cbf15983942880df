"""Cleaning raw order tables.

Raw ``customer_orders``: order_id, customer_id, pizza_id, exclusions, extras
(comma lists as text, with fake nulls), order_time.  Raw ``runner_orders``:
order_id, runner_id and text columns pickup_time, distance, duration,
cancellation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.text import (FAKE_NULLS, clean_sentinels, list_is_bad, parse_measure, parse_timestamp,
                              replace_fake_null)
from ..operators import assert_schema, missing_counts, missing_rows, parse_counts, schema_of, surrogate_key

ORDER_COLUMNS = ["order_id", "customer_id", "pizza_id", "exclusions", "extras", "order_time"]


def profile_missing(customer_orders: DataFrame) -> DataFrame:
    """J13 -> raw rows with a NULL anywhere or the text 'null' in a list column."""
    return missing_rows(customer_orders, ["customer_id", "pizza_id", "exclusions", "extras", "order_time"],
                        text_cols=["exclusions", "extras"], sentinels=("null",))


def missing_profile_counts(customer_orders: DataFrame) -> DataFrame:
    """J13 (counts) -> one row: rows and missing values per column ('null' and
    'NaN' text count as missing)."""
    return missing_counts(customer_orders, ["customer_id", "pizza_id", "exclusions", "extras", "order_time"],
                          text_cols=["exclusions", "extras"], sentinels=FAKE_NULLS)


def clean_customer_orders(customer_orders: DataFrame, with_key: bool = True) -> DataFrame:
    """J14 -> order_item_id, order_id, customer_id, pizza_id, exclusions, extras,
    order_time.  Fake nulls in the list columns become '' ("nothing asked").

    ``order_item_id`` numbers the pizzas 1..n in (order, customer, pizza, lists,
    time) order; identical pizzas of one order are separate items.  Jobs that do
    not need the key pass ``with_key=False``.
    """
    clean = clean_sentinels(customer_orders, {"exclusions": (FAKE_NULLS, ""), "extras": (FAKE_NULLS, "")}) \
        .select(*ORDER_COLUMNS)
    if not with_key:
        return clean
    keyed = surrogate_key(clean, ORDER_COLUMNS, "order_item_id")
    return keyed.select("order_item_id", *ORDER_COLUMNS)


def clean_runner_orders(runner_orders: DataFrame) -> DataFrame:
    """J15 -> order_id, runner_id, pickup_time timestamp_ntz, distance_km and
    duration_mins decimal(24,6) (digits and dots kept, units dropped),
    cancellation (NULL for '', 'null', 'NaN')."""
    return runner_orders.select(
        "order_id", "runner_id",
        parse_timestamp("pickup_time").alias("pickup_time"),
        parse_measure("distance").alias("distance_km"),
        parse_measure("duration").alias("duration_mins"),
        replace_fake_null("cancellation", None, blank=True).alias("cancellation"))


def distance_by_replace(runner_orders: DataFrame) -> DataFrame:
    """J16 -> order_id, distance: the unit text removed by replacement."""
    return runner_orders.select("order_id", parse_measure("distance", mode="replace", unit="km").alias("distance"))


def duration_by_prefix(runner_orders: DataFrame) -> DataFrame:
    """J17 -> order_id, duration: the leading number, of any length."""
    return runner_orders.select("order_id", parse_measure("duration", mode="left").alias("duration"))


def column_types(df: DataFrame, expected: dict[str, str], table: str = "table") -> list[tuple[str, str]]:
    """J18 -> (column, type) of a cleaned table, after asserting them against ``expected``."""
    return schema_of(assert_schema(df, expected, table))


def unparseable_counts(customer_orders: DataFrame, runner_orders: DataFrame) -> DataFrame:
    """J18 on the raw rows -> table_name, column_name, rows, missing, unparseable: for every dirty
    column how many values are missing, and how many hold text that its parser cannot read (and
    the cleaning jobs therefore turn into NULL)."""
    lists = {c: list_is_bad(c) for c in ("exclusions", "extras")}
    bad = {"pickup_time": parse_timestamp("pickup_time").isNull(), "distance": parse_measure("distance").isNull(),
           "duration": parse_measure("duration").isNull()}
    return parse_counts(customer_orders, lists, "customer_orders").unionByName(
        parse_counts(runner_orders, bad, "runner_orders"))
