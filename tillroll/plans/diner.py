"""Restaurant sales, favourites and the membership programme.

Inputs are shaped like ``sales(customer_id, order_date, product_id)``,
``menu(product_id, product_name, price)`` and ``members(customer_id, join_date)``.
Money totals are summed exactly (integer or decimal) and returned as double.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import (dates_relative_to, first_match, flag, join_relative_to, rows_on_edge_date, top_n,
                         top_ranked)


def spend_per_customer(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """J01 -> customer, spending_total."""
    j = sales.join(menu, "product_id")
    return j.groupBy(F.col("customer_id").alias("customer")).agg(
        F.sum("price").cast("double").alias("spending_total"))


def visit_days(sales: DataFrame) -> DataFrame:
    """J02 -> customer, days_visited (distinct order dates)."""
    return sales.groupBy(F.col("customer_id").alias("customer")).agg(
        F.countDistinct("order_date").alias("days_visited"))


def first_purchase(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """J03 -> customer, first_purchase: items of each customer's first day, each
    item once; every item bought that day is kept."""
    first = top_ranked(sales, ["customer_id"], ["order_date"], n=1)
    return (first.join(menu, "product_id")
                 .select(F.col("customer_id").alias("customer"),
                         F.col("product_name").alias("first_purchase"))
                 .distinct())


def most_purchased(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """J04 -> product, purchases: the single most bought item (name breaks ties).
    Counted per product id first, so a row per product meets the menu."""
    per_id = sales.groupBy("product_id").agg(F.count("product_id").alias("_n"))
    counts = per_id.join(menu, "product_id").groupBy(F.col("product_name").alias("product")).agg(
        F.sum("_n").alias("purchases"))
    return top_n(counts, [F.col("purchases").desc(), F.col("product").asc()], 1)


def favourite_items(sales: DataFrame, menu: DataFrame) -> DataFrame:
    """J05 -> customer, most_popular_item, purchases; ties all kept."""
    counts = sales.join(menu, "product_id").groupBy("customer_id", "product_name").agg(
        F.count("product_id").alias("purchases"))
    best = top_ranked(counts, ["customer_id"], [F.col("purchases").desc()], n=1)
    return best.select(F.col("customer_id").alias("customer"),
                       F.col("product_name").alias("most_popular_item"), "purchases")


def first_after_joining(sales: DataFrame, members: DataFrame, menu: DataFrame) -> DataFrame:
    """J06 -> customer, first_purchase: first item(s) on or after the join date."""
    first = rows_on_edge_date(sales, members, "customer_id", "order_date", "join_date", ">=")
    return first.join(menu, "product_id").select(
        F.col("customer_id").alias("customer"), F.col("product_name").alias("first_purchase"))


def last_before_joining(sales: DataFrame, members: DataFrame, menu: DataFrame) -> DataFrame:
    """J07 -> customer, last_purchase_before_member: item(s) of the last day
    before joining, ties kept."""
    last = rows_on_edge_date(sales, members, "customer_id", "order_date", "join_date", "<", edge=F.max)
    return last.join(menu, "product_id").select(
        F.col("customer_id").alias("customer"),
        F.col("product_name").alias("last_purchase_before_member"))


def spend_before_joining(sales: DataFrame, members: DataFrame, menu: DataFrame) -> DataFrame:
    """J08 -> customer, orders_num, spending_total before the join date."""
    before = join_relative_to(sales, members, "customer_id", "order_date", "join_date", "<")
    return before.join(menu, "product_id").groupBy(F.col("customer_id").alias("customer")).agg(
        F.count("product_id").alias("orders_num"),
        F.sum("price").cast("double").alias("spending_total"))


def points(sales: DataFrame, menu: DataFrame, double_item: str = "sushi",
           per_unit: int = 10, multiplier: int = 2) -> DataFrame:
    """J09 -> customer, points_total: ``per_unit`` points per unit of price,
    ``multiplier`` times that for ``double_item``."""
    j = sales.join(menu, "product_id")
    pts = first_match([(F.col("product_name") == double_item, F.col("price") * (per_unit * multiplier))],
                      F.col("price") * per_unit)
    return j.groupBy(F.col("customer_id").alias("customer")).agg(
        F.sum(pts).cast("double").alias("points_total"))


def member_points(sales: DataFrame, menu: DataFrame, members: DataFrame,
                  until: str | dt.date, double_item: str = "sushi", window_days: int = 7,
                  per_unit: int = 10, multiplier: int = 2) -> DataFrame:
    """J10 -> customer, points_total for members, sales up to ``until``.

    First matching rule wins (they do not stack): the ``window_days`` days from
    the join date (inclusive) earn ``multiplier`` on everything, then
    ``double_item`` earns ``multiplier``, anything else the base rate.  The rules
    look at the date and the item only, so prices are summed per customer, date and
    kind of item before the members join: a few rows per customer and date meet them.
    """
    upto = sales.filter(F.col("order_date") <= F.lit(until).cast("date")).join(menu, "product_id")
    daily = upto.groupBy("customer_id", "order_date", F.coalesce(F.col("product_name") == double_item, F.lit(False))
                         .alias("_double_item")).agg(F.sum("price").alias("_price"))
    j = daily.join(members, "customer_id")
    in_window = F.col("order_date").between(F.col("join_date"),
                                            F.date_add(F.col("join_date"), window_days - 1))
    double = F.col("_price") * (per_unit * multiplier)
    pts = first_match([(in_window, double), (F.col("_double_item"), double)], F.col("_price") * per_unit)
    return j.groupBy(F.col("customer_id").alias("customer")).agg(
        F.sum(pts).cast("double").alias("points_total"))


def joined_table(sales: DataFrame, menu: DataFrame, members: DataFrame) -> DataFrame:
    """J11 -> customer_id, order_date, product_name, price, member ('Y' once the
    sale is on or after the customer's join date, else 'N')."""
    j = sales.join(menu, "product_id").join(members, "customer_id", "left")
    is_member = F.col("join_date").isNotNull() & (F.col("order_date") >= F.col("join_date"))
    return j.select("customer_id", "order_date", "product_name", "price",
                    flag(is_member, "Y", "N").alias("member"))


def ranked_table(sales: DataFrame, menu: DataFrame, members: DataFrame) -> DataFrame:
    """J12 -> J11 plus ranking: dense rank of the order date among the customer's
    member sales, NULL for non-member sales.

    A dense rank depends on the distinct dates alone, so those of member sales are
    ranked (at most one row per customer and day) and joined back on customer and
    date; a sale is a member sale exactly where its date has a rank.
    """
    dates = dates_relative_to(sales, members, "customer_id", "order_date", "join_date", ">=")
    by_date = Window.partitionBy("customer_id").orderBy("order_date")
    ranks = dates.select("customer_id", "order_date", F.dense_rank().over(by_date).cast("bigint").alias("ranking"))
    ranked = sales.join(menu, "product_id").join(ranks, ["customer_id", "order_date"], "left")
    return ranked.select("customer_id", "order_date", "product_name", "price",
                         flag(F.col("ranking").isNotNull(), "Y", "N").alias("member"), "ranking")
