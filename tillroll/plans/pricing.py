"""Revenue, ratings and profit.

Prices come from a name -> price map with a default for other names; money is
summed exactly (integers and decimals) and returned as double.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import seconds_between
from ..functions.text import split_list
from ..operators import check_ratings, price_of
from ..sources.sinks import publish_checked


def _delivered(items: DataFrame, deliveries: DataFrame) -> DataFrame:
    d = deliveries.filter(F.col("pickup_time").isNotNull()).select("order_id")
    return items.join(d, "order_id", "left_semi")


def revenue(items: DataFrame, deliveries: DataFrame, names: DataFrame,
            prices: dict, default=10) -> DataFrame:
    """J44 -> revenue_total of delivered pizzas at fixed prices.  Pizzas are counted per id before
    the names, a row per id, join."""
    per_pizza = _delivered(items, deliveries).groupBy("pizza_id").agg(F.count(F.lit(1)).alias("_n")).join(names, "pizza_id")
    return per_pizza.agg(F.sum(price_of(F.col("pizza_name"), prices, default) * F.col("_n")).cast("double").alias("revenue_total"))


def revenue_with_extras(items: DataFrame, deliveries: DataFrame, names: DataFrame,
                        toppings: DataFrame, prices: dict, default=10, extra_price=1) -> DataFrame:
    """J45 -> total_price: J44 plus ``extra_price`` for every known extra topping
    of a delivered pizza.

    One pass: every extra is a row, and the pizza's price counts with its first row
    (a pizza without extras has one), so no per-pizza key is needed.
    """
    priced = _delivered(items, deliveries).join(names, "pizza_id").withColumn("_price", price_of(F.col("pizza_name"), prices, default))
    rows = priced.select("_price", F.posexplode_outer(split_list("extras")).alias("_at", "_extra"))
    known = rows.join(toppings.select(F.col("topping_id").alias("_extra"), F.lit(extra_price).alias("_cost")), "_extra", "left")
    price = F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_price"))
    return known.agg((F.sum(price) + F.coalesce(F.sum("_cost"), F.lit(0))).cast("double").alias("total_price"))


def ratings_check(ratings: DataFrame, deliveries: DataFrame, lo: int = 1, hi: int = 5) -> DataFrame:
    """J46 -> order_id, rating, rating_in_range, unique_order, delivered ('Y'/'N'):
    the new ratings table with its checks (range, one rating per order, a
    rating only for delivered orders)."""
    return check_ratings(ratings, deliveries, lo=lo, hi=hi)


def save_ratings(ratings: DataFrame, deliveries: DataFrame, path: str, lo: int = 1, hi: int = 5) -> int:
    """J46 (create the table) -> write ``ratings`` as Parquet at ``path`` if the checks
    hold; raises, and leaves nothing, if a rating is out of range or an order is rated twice.
    Returns the number of ratings given to orders that were not delivered
    (kept, and reported, as the case's own ratings for cancelled orders are).

    ``ratings`` is evaluated once: its rows meet per order, the checks are observed while
    the table is staged, and it is published by a rename (``publish_checked``).
    """
    n, off = F.count(F.lit(1)).alias("_n"), F.count(F.when(~F.coalesce(F.col("rating").between(lo, hi), F.lit(False)), 1)).alias("_off")
    row = F.any_value(F.struct(*ratings.columns)).alias("_row")
    delivered = deliveries.select("order_id", F.col("pickup_time").isNotNull().alias("_delivered"))
    per_order = ratings.groupBy("order_id").agg(n, off, row).join(delivered, "order_id", "left").select("_row.*", "_n", "_off", "_delivered")

    def accept(seen: dict) -> None:
        if seen["off"] or seen["duplicates"]:
            raise ValueError(f"ratings rejected: {seen['off'] or 0} out of [{lo}, {hi}], {seen['duplicates'] or 0} duplicated")

    metrics = {"off": F.sum("_off"), "duplicates": F.sum(F.when(F.col("_n") > 1, F.col("_n"))),
               "undelivered": F.sum(F.when(~F.coalesce(F.col("_delivered"), F.lit(False)), F.col("_n")))}
    return publish_checked(per_order, path, metrics, accept, ratings.columns)["undelivered"] or 0


def ratings_table(ratings: DataFrame, deliveries: DataFrame, path: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """J46 (the table) -> order_id, rating as read back after ``save_ratings`` wrote them to ``path``."""
    save_ratings(ratings, deliveries, path, lo, hi)
    return ratings.sparkSession.read.parquet(path)


def delivery_facts(items: DataFrame, deliveries: DataFrame, ratings: DataFrame) -> DataFrame:
    """J47 -> one row per successful delivery: customer_id, order_id, runner_id,
    rating, order_time, pickup_time, time_to_pickup_secs, duration_mins,
    average_speed_km_min, num_pizzas."""
    orders = items.groupBy("order_id", "customer_id").agg(
        F.count("pizza_id").alias("num_pizzas"), F.min("order_time").alias("order_time"))
    d = deliveries.filter(F.col("pickup_time").isNotNull())
    j = orders.join(d, "order_id").join(ratings, "order_id")
    speed = F.col("distance_km").cast("double") / F.col("duration_mins").cast("double")
    return j.select("customer_id", "order_id", "runner_id", "rating", "order_time", "pickup_time",
                    seconds_between("pickup_time", "order_time").alias("time_to_pickup_secs"),
                    "duration_mins", speed.alias("average_speed_km_min"), "num_pizzas")


def profit(items: DataFrame, deliveries: DataFrame, names: DataFrame, prices: dict,
           default=10, fee_per_km: str | Decimal = "0.30") -> DataFrame:
    """J48 -> total_profit: delivered pizza sales minus ``fee_per_km`` per km.

    Prices are summed per order before the deliveries, which are read once, join."""
    priced = items.join(names, "pizza_id").withColumn("_price", price_of(F.col("pizza_name"), prices, default))
    sales = priced.groupBy("order_id").agg(F.sum("_price").alias("_sales"))
    fee = F.lit(Decimal(str(fee_per_km)))
    j = deliveries.filter(F.col("pickup_time").isNotNull()).join(sales, "order_id")
    return j.agg(F.sum(F.col("_sales") - F.col("distance_km") * fee).cast("double").alias("total_profit"))
