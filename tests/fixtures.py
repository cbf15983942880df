"""Small literal tables with known answers (schemas declared, never inferred)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


def _ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


# ---------------------------------------------------------------- F1 diner ---
# Restaurant sales (customer, date, product), menu and members.
SALES = [
    ("A", "2021-01-01", 1), ("A", "2021-01-01", 2), ("A", "2021-01-07", 2),
    ("A", "2021-01-10", 3), ("A", "2021-01-11", 3), ("A", "2021-01-11", 3),
    ("B", "2021-01-01", 2), ("B", "2021-01-02", 2), ("B", "2021-01-04", 1),
    ("B", "2021-01-11", 1), ("B", "2021-01-16", 3), ("B", "2021-02-01", 3),
    ("C", "2021-01-01", 3), ("C", "2021-01-01", 3), ("C", "2021-01-07", 3),
]
MENU = [(1, "sushi", 10), (2, "curry", 15), (3, "ramen", 12)]
MEMBERS = [("A", "2021-01-07"), ("B", "2021-01-09")]


def diner(spark: SparkSession) -> dict[str, DataFrame]:
    sales = spark.createDataFrame(
        [(c, _d(d), p) for c, d, p in SALES],
        "customer_id string, order_date date, product_id int")
    menu = spark.createDataFrame(MENU, "product_id int, product_name string, price int")
    members = spark.createDataFrame([(c, _d(d)) for c, d in MEMBERS],
                                    "customer_id string, join_date date")
    return {"sales": sales, "menu": menu, "members": members}


# --------------------------------------------------------------- F2 pizza ---
# Raw pizza orders in file order; None is SQL NULL, 'null' is text.
CUSTOMER_ORDERS = [
    (1, 101, 1, "", "", "2020-01-01 18:05:02"),
    (2, 101, 1, "", "", "2020-01-01 19:00:52"),
    (3, 102, 1, "", "", "2020-01-02 23:51:23"),
    (3, 102, 2, "", None, "2020-01-02 23:51:23"),
    (4, 103, 1, "4", "", "2020-01-04 13:23:46"),
    (4, 103, 1, "4", "", "2020-01-04 13:23:46"),
    (4, 103, 2, "4", "", "2020-01-04 13:23:46"),
    (5, 104, 1, "null", "1", "2020-01-08 21:00:29"),
    (6, 101, 2, "null", "null", "2020-01-08 21:03:13"),
    (7, 105, 2, "null", "1", "2020-01-08 21:20:29"),
    (8, 102, 1, "null", "null", "2020-01-09 23:54:33"),
    (9, 103, 1, "4", "1, 5", "2020-01-10 11:22:59"),
    (10, 104, 1, "null", "null", "2020-01-11 18:34:49"),
    (10, 104, 1, "2, 6", "1, 4", "2020-01-11 18:34:49"),
]
# Raw runner orders (order, runner, pickup, distance, duration, cancellation).
RUNNER_ORDERS = [
    (1, 1, "2020-01-01 18:15:34", "20km", "32 minutes", ""),
    (2, 1, "2020-01-01 19:10:54", "20km", "27 minutes", ""),
    (3, 1, "2020-01-03 00:12:37", "13.4km", "20 mins", None),
    (4, 2, "2020-01-04 13:53:03", "23.4", "40", None),
    (5, 3, "2020-01-08 21:10:57", "10", "15", None),
    (6, 3, "null", "null", "null", "Restaurant Cancellation"),
    (7, 2, "2020-01-08 21:30:45", "25km", "25mins", "null"),
    (8, 2, "2020-01-10 00:15:02", "23.4 km", "15 minute", "null"),
    (9, 2, "null", "null", "null", "Customer Cancellation"),
    (10, 1, "2020-01-11 18:50:20", "10km", "10minutes", "null"),
]
RUNNERS = [(1, "2021-01-01"), (2, "2021-01-03"), (3, "2021-01-08"), (4, "2021-01-15")]
PIZZA_NAMES = [(1, "Meatlovers"), (2, "Vegetarian")]
PIZZA_RECIPES = [(1, "1, 2, 3, 4, 5, 6, 8, 10"), (2, "4, 6, 7, 9, 11, 12")]
PIZZA_TOPPINGS = [
    (1, "Bacon"), (2, "BBQ Sauce"), (3, "Beef"), (4, "Cheese"), (5, "Chicken"),
    (6, "Mushrooms"), (7, "Onions"), (8, "Pepperoni"), (9, "Peppers"), (10, "Salami"),
    (11, "Tomatoes"), (12, "Tomato Sauce"),
]
ORDER_RATINGS = [(1, 4), (2, 4), (3, 5), (4, 3), (5, 5), (6, 1), (7, 3), (8, 4), (9, 2), (10, 5)]


def pizza(spark: SparkSession) -> dict[str, DataFrame]:
    co = spark.createDataFrame(
        [(o, c, p, ex, ext, _ts(t)) for o, c, p, ex, ext, t in CUSTOMER_ORDERS],
        "order_id int, customer_id int, pizza_id int, exclusions string, extras string, "
        "order_time timestamp_ntz")
    ro = spark.createDataFrame(
        RUNNER_ORDERS,
        "order_id int, runner_id int, pickup_time string, distance string, duration string, "
        "cancellation string")
    return {
        "customer_orders": co,
        "runner_orders": ro,
        "runners": spark.createDataFrame([(r, _d(d)) for r, d in RUNNERS],
                                         "runner_id int, registration_date date"),
        "pizza_names": spark.createDataFrame(PIZZA_NAMES, "pizza_id int, pizza_name string"),
        "pizza_recipes": spark.createDataFrame(PIZZA_RECIPES, "pizza_id int, toppings string"),
        "pizza_toppings": spark.createDataFrame(PIZZA_TOPPINGS, "topping_id int, topping_name string"),
        "order_ratings": spark.createDataFrame(ORDER_RATINGS, "order_id int, rating int"),
    }


# ------------------------------------------------------- F3 subscriptions ---
# Plans, and the published journeys of eight sample customers.
PLANS = [(0, "trial", "0.00"), (1, "basic monthly", "9.90"), (2, "pro monthly", "19.90"),
         (3, "pro annual", "199.00"), (4, "churn", None)]
SAMPLE_SUBSCRIPTIONS = [
    (1, 0, "2020-08-01"), (1, 1, "2020-08-08"),
    (2, 0, "2020-09-20"), (2, 3, "2020-09-27"),
    (11, 0, "2020-11-19"), (11, 4, "2020-11-26"),
    (13, 0, "2020-12-15"), (13, 1, "2020-12-22"), (13, 2, "2021-03-29"),
    (15, 0, "2020-03-17"), (15, 2, "2020-03-24"), (15, 4, "2020-04-29"),
    (16, 0, "2020-05-31"), (16, 1, "2020-06-07"), (16, 3, "2020-10-21"),
    (18, 0, "2020-07-06"), (18, 2, "2020-07-13"),
    (19, 0, "2020-06-22"), (19, 2, "2020-06-29"), (19, 3, "2020-08-29"),
]


def subscriptions(spark: SparkSession) -> dict[str, DataFrame]:
    plans = spark.createDataFrame(
        [(i, n, Decimal(p) if p is not None else None) for i, n, p in PLANS],
        T.StructType([T.StructField("plan_id", T.IntegerType()),
                      T.StructField("plan_name", T.StringType()),
                      T.StructField("price", T.DecimalType(5, 2))]))
    subs = spark.createDataFrame([(c, p, _d(s)) for c, p, s in SAMPLE_SUBSCRIPTIONS],
                                 "customer_id int, plan_id int, start_date date")
    return {"plans": plans, "subscriptions": subs}
