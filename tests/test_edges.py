"""Edge cases: empty input, NULL lists, long waits, extras equal to exclusions,
malformed numbers, keys across many partitions, relational EXCEPT/UNION ALL."""

import datetime as dt

from conftest import rows
from pyspark.sql import functions as F
from tillroll.functions import parse_measure, split_list
from tillroll.operators import apply_changes, round_ratio, surrogate_key
from tillroll.plans import couriers as R
from tillroll.plans import diner as D
from tillroll.plans import ingredients as I
from tillroll.plans import order_metrics as M
from tillroll.plans import subscriptions as S

ITEMS = "order_item_id long, order_id int, customer_id int, pizza_id int, exclusions string, " \
        "extras string, order_time timestamp_ntz"


def test_empty_inputs(spark):
    sales = spark.createDataFrame([], "customer_id string, order_date date, product_id int")
    menu = spark.createDataFrame([], "product_id int, product_name string, price int")
    assert D.spend_per_customer(sales, menu).count() == 0
    assert D.most_purchased(sales, menu).count() == 0
    items = spark.createDataFrame([], ITEMS)
    # a global aggregate still returns its one row
    assert rows(M.pizzas_ordered(items)) == [(0,)]


def test_null_and_blank_lists_give_no_elements(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("3,4",), ("3, 4",)], "x string")
    got = [r.a for r in df.select(split_list("x").alias("a")).collect()]
    assert got == [[], [], [], [3, 4], [3, 4]]


def test_malformed_measures_become_null(spark):
    df = spark.createDataFrame([("1.2.3",), ("km",), ("12.5 km",), (None,)], "x string")
    got = [r.v for r in df.select(parse_measure("x").alias("v")).collect()]
    assert got[0] is None and got[1] is None and float(got[2]) == 12.5 and got[3] is None


def test_minute_field_cuts_whole_hours(spark):
    items = spark.createDataFrame(
        [(1, 1, 1, 1, "", "", dt.datetime(2020, 1, 1, 10, 0, 0))], ITEMS)
    deliveries = spark.createDataFrame(
        [(1, 7, dt.datetime(2020, 1, 1, 11, 15, 30))], "order_id int, runner_id int, pickup_time timestamp_ntz")
    assert rows(R.avg_wait_per_runner(items, deliveries)) == [(7, 15)]
    assert rows(R.avg_wait_per_runner(items, deliveries, unit="total")) == [(7, 75)]
    assert rows(R.avg_wait_per_runner(items, deliveries, unit="seconds")) == [(7, 4530.0)]


def test_extra_equal_to_excluded_topping_counts_once(spark):
    items = spark.createDataFrame([(1, 1, 1, 1, "2", "2, 3", dt.datetime(2020, 1, 1))], ITEMS)
    recipes = spark.createDataFrame([(1, "1, 2")], "pizza_id int, toppings string")
    names = spark.createDataFrame([(1, "P")], "pizza_id int, pizza_name string")
    tops = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "topping_id int, topping_name string")
    got = I.ingredient_lists(items, recipes, names, tops).collect()[0].ingredient_list
    assert got == "P: a, b, c"


def test_item_without_known_toppings_has_no_list(spark):
    items = spark.createDataFrame([(1, 1, 1, 9, "", "", dt.datetime(2020, 1, 1))], ITEMS)
    recipes = spark.createDataFrame([(1, "1")], "pizza_id int, toppings string")
    names = spark.createDataFrame([(9, "Q")], "pizza_id int, pizza_name string")
    tops = spark.createDataFrame([(1, "a")], "topping_id int, topping_name string")
    assert I.ingredient_lists(items, recipes, names, tops).collect()[0].ingredient_list is None
    assert I.order_item_text(items, names, tops).collect()[0].order_item == "Q"


def test_surrogate_key_is_consecutive_across_partitions(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS v", "id % 3 AS g")
    keyed = surrogate_key(df, ["g", "v"], "k", ranges=5).collect()
    ordered = sorted(keyed, key=lambda r: r.k)
    assert [r.k for r in ordered] == list(range(1, 1001))
    assert [(r.g, r.v) for r in ordered] == sorted((r.g, r.v) for r in keyed)


def test_apply_changes_is_except_distinct_then_union_all(spark):
    base = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None)], "item int, t int")
    removed = spark.createDataFrame([(1, 2)], "item int, t int")
    added = spark.createDataFrame([(1, 1), (1, 1)], "item int, t int")
    got = sorted((r.t if r.t is not None else -1) for r in apply_changes(base, removed, added).collect())
    assert got == [-1, 1, 1, 1]


def test_surrogate_key_splits_a_large_group_of_copies(spark):
    # a third of the rows are copies of one row; chunks of 7 split them
    df = spark.range(0, 300).selectExpr("CASE WHEN id < 100 THEN 0 ELSE id END AS v")
    keyed = surrogate_key(df, ["v"], "k", ranges=4, chunk=7).collect()
    assert sorted(r.k for r in keyed) == list(range(1, 301))
    by_key = sorted(keyed, key=lambda r: r.k)
    assert [r.v for r in by_key] == sorted(r.v for r in keyed)


def test_leading_number_of_any_length_is_read(spark):
    df = spark.createDataFrame([("2447 minutes",), ("15mins",), ("null",), (" 7",), ("x9",), (None,)], "x string")
    got = [r.v for r in df.select(parse_measure("x", mode="left").alias("v")).collect()]
    assert [None if v is None else float(v) for v in got] == [2447.0, 15.0, None, 7.0, None, None]


def test_large_and_fine_measures_keep_their_value(spark):
    df = spark.createDataFrame([("123456789012.345678 km",)], "x string")
    assert str(df.select(parse_measure("x").alias("v")).first().v) == "123456789012.345678"


def test_mean_distance_is_rounded_once(spark):
    # 399 x 1.00 and one 2.999: the mean 1.0049975 rounds to 1.00, its six-place form 1.004998 too;
    # 4,000,000-fold groups are stood in for by the ratio itself
    one = spark.createDataFrame([(1,)], "x int")
    ratio = round_ratio(F.lit("401999999").cast("decimal(24,6)"), F.lit(400000000), 2)
    assert one.select(ratio.alias("v")).first().v == 1.0
    half = round_ratio(F.lit("2.01").cast("decimal(24,6)"), F.lit(2), 2)
    assert one.select(half.alias("v")).first().v == 1.01
    minus = round_ratio(F.lit("-2.01").cast("decimal(24,6)"), F.lit(2), 2)
    assert one.select(minus.alias("v")).first().v == -1.01


def test_surrogate_key_orders_nulls_text_and_times(spark):
    df = spark.createDataFrame([(None, 1), ("b", 1), ("a", 2), ("a", 1), ("ab", 1), ("", 1)], "v string, w int")
    got = sorted(surrogate_key(df, ["v", "w"], "k", ranges=3).collect(), key=lambda r: r.k)
    assert [(r.v, r.w) for r in got] == [(None, 1), ("", 1), ("a", 1), ("a", 2), ("ab", 1), ("b", 1)]


def test_upgrades_before_the_trial_ends_count_with_negative_days(spark):
    subs = spark.createDataFrame([(1, 0, dt.date(2020, 1, 1)), (1, 3, dt.date(2020, 1, 4)), (2, 0, dt.date(2020, 1, 1)),
                                  (2, 3, dt.date(2020, 2, 27)), (3, 0, dt.date(2020, 1, 1))],
                                 "customer_id int, plan_id int, start_date date")
    assert rows(S.avg_days_to_annual(subs)) == [(23.0,)]
    assert rows(S.days_to_annual_periods(subs)) == [("0-30 days", 1, -4.0), ("31-60 days", 1, 50.0)]
