"""Courier sign-ups, waiting, distance, speed and success.

Times are measured in whole seconds; "minutes" results are the minute field of
the average interval (whole hours cut off), total minutes with ``unit='total'``,
or the average interval in seconds with ``unit='seconds'``.  Decimal inputs stay
exact until the final rounding.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import mean_time, minute_field, period_start, seconds_between, time_between, total_minutes
from ..operators import round_ratio, share


def _minutes(avg_seconds, unit: str):
    """``field``: minute field of the average (0-59); ``total``: whole minutes;
    ``seconds``: the average interval itself, in seconds."""
    if unit == "field":
        return minute_field(avg_seconds)
    if unit == "total":
        return total_minutes(avg_seconds)
    if unit == "seconds":
        return avg_seconds.cast("double")
    raise ValueError(f"unknown unit {unit!r}")


def signups_per_period(runners: DataFrame, anchor: str | dt.date, days: int = 7) -> DataFrame:
    """J29 -> start_of_week, signups: registrations per ``days``-day period
    counted from ``anchor``."""
    return runners.groupBy(period_start("registration_date", anchor, days).alias("start_of_week")).agg(
        F.count("runner_id").alias("signups"))


def _weighed_orders(items: DataFrame, deliveries: DataFrame, per: str) -> DataFrame:
    """order_id, runner_id, pickup_time, order_time, _n: every order and how often it counts."""
    if per == "order":
        orders = items.groupBy("order_id").agg(F.min("order_time").alias("order_time"), F.lit(1).cast("bigint").alias("_n"))
    else:
        orders = items.groupBy("order_id", "order_time").agg(F.count(F.lit(1)).alias("_n"))
    return deliveries.select("order_id", "runner_id", "pickup_time").join(orders, "order_id")


def avg_wait_per_runner(items: DataFrame, deliveries: DataFrame, unit: str = "field",
                        per: str = "item") -> DataFrame:
    """J30 -> runner_id, avg_arrival_minutes: average time from order to pickup.

    ``per='item'`` weighs each order by its pizzas (which are counted before the
    join); ``per='order'`` counts each order once.  Cancelled orders
    (no pickup) are skipped by the average.
    """
    j = _weighed_orders(items, deliveries, per)
    secs = seconds_between("pickup_time", "order_time")
    mean = F.sum(secs * F.col("_n")) / F.sum(F.when(secs.isNotNull(), F.col("_n")))
    return j.groupBy("runner_id").agg(_minutes(mean, unit).alias("avg_arrival_minutes"))


def mean_wait_per_runner(items: DataFrame, deliveries: DataFrame, per: str = "item") -> DataFrame:
    """J30 as an interval -> runner_id, mean_wait (day-time interval): ``avg_wait_per_runner`` without a unit."""
    j = _weighed_orders(items, deliveries, per).withColumn("_wait", time_between("pickup_time", "order_time"))
    return j.groupBy("runner_id").agg(mean_time("_wait", "_n").alias("mean_wait"))


def time_to_pickup(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """order_id, time_to_pickup (day-time interval) of every delivered order; J47 gives the same in seconds."""
    j = _weighed_orders(items, deliveries.filter(F.col("pickup_time").isNotNull()), "order")
    return j.select("order_id", time_between("pickup_time", "order_time").alias("time_to_pickup"))


def prep_time_by_size(items: DataFrame, deliveries: DataFrame, unit: str = "field") -> DataFrame:
    """J31 -> pizzas_ordered, avg_time_minutes: order-to-pickup time by order size."""
    sizes = items.groupBy("order_id", "order_time").agg(F.count("pizza_id").alias("pizzas_ordered"))
    d = deliveries.filter(F.col("pickup_time").isNotNull()).select("order_id", "pickup_time")
    j = d.join(sizes, "order_id")
    secs = seconds_between("pickup_time", "order_time")
    return j.groupBy("pizzas_ordered").agg(_minutes(F.avg(secs), unit).alias("avg_time_minutes"))


def avg_distance_per_runner(deliveries: DataFrame) -> DataFrame:
    """J32 -> runner_id, avg_distance_km rounded to 2 places (NULLs skipped)."""
    per_runner = deliveries.groupBy("runner_id").agg(F.sum("distance_km").alias("_km"), F.count("distance_km").alias("_n"))
    return per_runner.select("runner_id", round_ratio(F.col("_km"), F.col("_n"), 2).alias("avg_distance_km"))


def delivery_time_spread(deliveries: DataFrame) -> DataFrame:
    """J33 -> difference_mins = longest - shortest delivery duration."""
    return deliveries.agg((F.max("duration_mins") - F.min("duration_mins")).cast("double")
                          .alias("difference_mins"))


def speed_per_delivery(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    """J34 -> order_id, runner_id, pizzas_ordered, distance_km, duration_mins,
    avg_speed (km/h, 2 places) for every delivered order."""
    sizes = items.groupBy("order_id").agg(F.count("pizza_id").alias("pizzas_ordered"))
    d = deliveries.filter(F.col("pickup_time").isNotNull())
    j = d.join(sizes, "order_id")
    speed = round_ratio(F.lit(60) * F.col("distance_km"), F.col("duration_mins"), 2)
    return j.select("order_id", "runner_id", "pizzas_ordered", "distance_km", "duration_mins",
                    speed.alias("avg_speed"))


def success_rate(deliveries: DataFrame) -> DataFrame:
    """J35 -> runner_id, total, delivered, delivery_pct (integer percentage of
    orders picked up, as the integer quotient)."""
    g = deliveries.groupBy("runner_id").agg(F.count("order_id").alias("total"),
                                            F.count("pickup_time").alias("delivered"))
    return g.withColumn("delivery_pct", share(F.col("delivered"), F.col("total"), integer=True))
