"""Order metrics over cleaned pizza orders.

``items`` is a cleaned customer_orders table (one row per pizza), ``deliveries``
a cleaned runner_orders table (one row per order; delivered = pickup_time set),
``names`` maps pizza_id -> pizza_name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import weekday_name, weekday_number
from ..operators import flag, keep_max


def _delivered_items(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    d = deliveries.filter(F.col("pickup_time").isNotNull()).select("order_id")
    return items.join(d, "order_id", "left_semi")


def pizzas_ordered(items: DataFrame) -> DataFrame:
    """J19 -> pizzas_ordered (one row per pizza)."""
    return items.agg(F.count(F.lit(1)).alias("pizzas_ordered"))


def orders_made(items: DataFrame) -> DataFrame:
    """J20 -> orders_made (distinct orders)."""
    return items.agg(F.countDistinct("order_id").alias("orders_made"))


def delivered_per_runner(deliveries: DataFrame) -> DataFrame:
    """J21 -> runner_id, orders_delivered."""
    return (deliveries.filter(F.col("pickup_time").isNotNull())
                      .groupBy("runner_id").agg(F.count("order_id").alias("orders_delivered")))


def delivered_per_type(items: DataFrame, deliveries: DataFrame, names: DataFrame) -> DataFrame:
    """J22 -> pizza_name, pizzas_ordered (delivered pizzas only).

    The per-pizza counts are pre-aggregated before the name lookup, so the join
    to the name table sees one row per pizza id instead of one per item."""
    per_pizza = _delivered_items(items, deliveries).groupBy("pizza_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per_pizza.join(names, "pizza_id")
                     .groupBy("pizza_name").agg(F.sum("_n").alias("pizzas_ordered")))


def per_customer_type(items: DataFrame, names: DataFrame) -> DataFrame:
    """J23 -> customer_id, pizza_name, pizzas_ordered (cancelled orders included)."""
    per_pizza = items.groupBy("customer_id", "pizza_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per_pizza.join(names, "pizza_id")
                     .groupBy("customer_id", "pizza_name").agg(F.sum("_n").alias("pizzas_ordered")))


def biggest_orders(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """J24 -> order_id, pizzas_delivered for the order(s) with the most delivered
    pizzas; ties kept."""
    counts = _delivered_items(items, deliveries).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("pizzas_delivered"))
    return keep_max(counts, "pizzas_delivered")


def changes_per_customer(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """J25 -> customer_id, with_changes ('Yes' if any extra or exclusion),
    pizzas_delivered."""
    unchanged = (F.col("extras") == "") & (F.col("exclusions") == "")
    d = _delivered_items(items, deliveries).select("customer_id", flag(unchanged, "No", "Yes").alias("with_changes"))
    return d.groupBy("customer_id", "with_changes").agg(F.count(F.lit(1)).alias("pizzas_delivered"))


def both_changes(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """J26 -> with_both_changes ('Yes' if extras and exclusions), pizzas_delivered."""
    both = (F.col("extras") != "") & (F.col("exclusions") != "")
    d = _delivered_items(items, deliveries).select(flag(both, "Yes", "No").alias("with_both_changes"))
    return d.groupBy("with_both_changes").agg(F.count(F.lit(1)).alias("pizzas_delivered"))


def volume_by_hour(df: DataFrame, ts: str = "order_time", counted: str = "pizza_id") -> DataFrame:
    """J27 -> hour_of_order, pizzas_ordered (hours without orders are absent)."""
    return df.groupBy(F.hour(ts).cast("bigint").alias("hour_of_order")).agg(
        F.count(counted).alias("pizzas_ordered"))


def volume_by_weekday(df: DataFrame, ts: str = "order_time", counted: str = "pizza_id",
                      as_number: bool = False, padded: bool = False) -> DataFrame:
    """J28 -> day_of_week, pizzas_ordered.  The day is the English name (blank-
    padded to 9 characters with ``padded``), or with ``as_number`` 0 = Sunday ..
    6 = Saturday."""
    day = weekday_number(ts) if as_number else weekday_name(ts, padded)
    return df.groupBy(day.alias("day_of_week")).agg(F.count(counted).alias("pizzas_ordered"))
