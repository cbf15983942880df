"""Case 2 jobs against the published answers on the pizza fixture."""

import datetime as dt
from decimal import Decimal

import pytest

from conftest import rows
from fixtures import pizza
from tillroll.plans import cleaning as C
from tillroll.plans import couriers as R
from tillroll.plans import ingredients as I
from tillroll.plans import order_metrics as M
from tillroll.plans import pricing as P

# The expected rows below are the published answers to the published sample rows.
PRICES = {"Meatlovers": 12}


@pytest.fixture(scope="module")
def t(spark):
    raw = pizza(spark)
    items = C.clean_customer_orders(raw["customer_orders"])
    deliveries = C.clean_runner_orders(raw["runner_orders"])
    return dict(raw, items=items, deliveries=deliveries)


# ---- cleaning ----------------------------------------------------------------

def test_j13_rows_with_missing_values(t):
    out = C.profile_missing(t["customer_orders"])
    assert sorted(r.order_id for r in out.collect()) == [3, 5, 6, 7, 8, 10]


def test_j13_counts(t):
    r = C.missing_profile_counts(t["customer_orders"]).collect()[0]
    assert (r.rows, r.exclusions_missing, r.extras_missing) == (14, 5, 4)


def test_j14_clean_customer_orders(t):
    got = rows(t["items"], "order_item_id", "order_id", "pizza_id", "exclusions", "extras")
    assert got == [
        (1, 1, 1, "", ""), (2, 2, 1, "", ""), (3, 3, 1, "", ""), (4, 3, 2, "", ""),
        (5, 4, 1, "4", ""), (6, 4, 1, "4", ""), (7, 4, 2, "4", ""), (8, 5, 1, "", "1"),
        (9, 6, 2, "", ""), (10, 7, 2, "", "1"), (11, 8, 1, "", ""), (12, 9, 1, "4", "1, 5"),
        (13, 10, 1, "", ""), (14, 10, 1, "2, 6", "1, 4")]


def test_j15_clean_runner_orders(t):
    got = {r.order_id: r for r in t["deliveries"].collect()}
    assert got[1].pickup_time == dt.datetime(2020, 1, 1, 18, 15, 34)
    assert (got[3].distance_km, got[3].duration_mins) == (Decimal("13.40"), Decimal("20.00"))
    assert (got[8].distance_km, got[8].duration_mins) == (Decimal("23.40"), Decimal("15.00"))
    assert got[6].pickup_time is None and got[6].distance_km is None
    assert got[6].cancellation == "Restaurant Cancellation"
    assert [got[i].cancellation for i in (1, 3, 7, 10)] == [None, None, None, None]


def test_j16_j17_alternative_parsers(t):
    d = {r.order_id: r.distance for r in C.distance_by_replace(t["runner_orders"]).collect()}
    u = {r.order_id: r.duration for r in C.duration_by_prefix(t["runner_orders"]).collect()}
    assert [float(d[i]) for i in (1, 3, 4, 8)] == [20.0, 13.4, 23.4, 23.4] and d[6] is None
    assert [float(u[i]) for i in (1, 3, 7, 8, 10)] == [32, 20, 25, 15, 10] and u[9] is None


def test_j18_types(spark, t):
    out = C.column_types(t["deliveries"], {"order_id": "int", "runner_id": "int", "pickup_time": "timestamp_ntz",
                                           "distance_km": "decimal(24,6)", "duration_mins": "decimal(24,6)",
                                           "cancellation": "string"})
    assert len(out) == 6
    with pytest.raises(AssertionError):
        C.column_types(t["deliveries"], {"order_id": "bigint"})


def test_j18_counts_what_the_parsers_cannot_read(spark):
    orders = spark.createDataFrame([("1, 2", "x"), ("", None), ("1, y", "3"), ("null", "4,"), ("5", "NaN")],
                                   "exclusions string, extras string")
    runs = spark.createDataFrame([("2020-01-01 10:00:00", "12km", "1.2.3"), ("soon", "null", "20 mins"), (None, "km", "")],
                                 "pickup_time string, distance string, duration string")
    assert rows(C.unparseable_counts(orders, runs), "column_name", "rows", "missing", "unparseable") == [
        ("distance", 3, 1, 1), ("duration", 3, 1, 1), ("exclusions", 5, 2, 1), ("extras", 5, 2, 2),
        ("pickup_time", 3, 1, 1)]


# ---- order metrics -------------------------------------------------------------

def test_j19_j20_counts(t):
    assert rows(M.pizzas_ordered(t["items"])) == [(14,)]
    assert rows(M.orders_made(t["items"])) == [(10,)]


def test_j21_delivered_per_runner(t):
    assert rows(M.delivered_per_runner(t["deliveries"])) == [(1, 4), (2, 3), (3, 1)]


def test_j22_j23_per_type(t):
    assert rows(M.delivered_per_type(t["items"], t["deliveries"], t["pizza_names"])) == [
        ("Meatlovers", 9), ("Vegetarian", 3)]
    assert rows(M.per_customer_type(t["items"], t["pizza_names"])) == [
        (101, "Meatlovers", 2), (101, "Vegetarian", 1), (102, "Meatlovers", 2), (102, "Vegetarian", 1),
        (103, "Meatlovers", 3), (103, "Vegetarian", 1), (104, "Meatlovers", 3), (105, "Vegetarian", 1)]


def test_j24_biggest_order(t):
    assert rows(M.biggest_orders(t["items"], t["deliveries"])) == [(4, 3)]


def test_j25_j26_changes(t):
    assert rows(M.changes_per_customer(t["items"], t["deliveries"])) == sorted([
        (101, "No", 2), (102, "No", 3), (103, "Yes", 3), (104, "Yes", 2), (104, "No", 1), (105, "Yes", 1)])
    assert rows(M.both_changes(t["items"], t["deliveries"])) == [("No", 11), ("Yes", 1)]


def test_j27_j28_timing(t):
    assert rows(M.volume_by_hour(t["items"])) == [(11, 1), (13, 3), (18, 3), (19, 1), (21, 3), (23, 3)]
    assert rows(M.volume_by_weekday(t["items"])) == [
        ("Friday", 1), ("Saturday", 5), ("Thursday", 3), ("Wednesday", 5)]
    assert rows(M.volume_by_weekday(t["items"], as_number=True)) == [(3, 5), (4, 3), (5, 1), (6, 5)]
    assert rows(M.volume_by_weekday(t["items"], padded=True)) == [
        ("Friday   ", 1), ("Saturday ", 5), ("Thursday ", 3), ("Wednesday", 5)]


# ---- couriers --------------------------------------------------------------------

def test_j29_signups_per_week(t):
    d = dt.date
    assert rows(R.signups_per_period(t["runners"], "2021-01-01")) == [
        (d(2021, 1, 1), 2), (d(2021, 1, 8), 1), (d(2021, 1, 15), 1)]


def test_j29_dates_before_anchor_use_their_own_period(spark):
    df = spark.createDataFrame([(1, dt.date(2020, 12, 31))], "runner_id int, registration_date date")
    assert rows(R.signups_per_period(df, "2021-01-01")) == [(dt.date(2020, 12, 25), 1)]


def test_j30_j31_waiting(t):
    assert rows(R.avg_wait_per_runner(t["items"], t["deliveries"])) == [(1, 15), (2, 23), (3, 10)]
    assert rows(R.avg_wait_per_runner(t["items"], t["deliveries"], per="order")) == [(1, 14), (2, 20), (3, 10)]
    assert rows(R.prep_time_by_size(t["items"], t["deliveries"])) == [(1, 12), (2, 18), (3, 29)]


def test_j32_j33_distance(t):
    assert rows(R.avg_distance_per_runner(t["deliveries"])) == [(1, 15.85), (2, 23.93), (3, 10.0)]
    assert rows(R.delivery_time_spread(t["deliveries"])) == [(30.0,)]


def test_j34_speed(t):
    got = rows(R.speed_per_delivery(t["items"], t["deliveries"]), "order_id", "pizzas_ordered", "avg_speed")
    assert got == [(1, 1, 37.5), (2, 1, 44.44), (3, 2, 40.2), (4, 3, 35.1), (5, 1, 40.0),
                   (7, 1, 60.0), (8, 1, 93.6), (10, 2, 60.0)]


def test_j35_success_rate(t):
    assert rows(R.success_rate(t["deliveries"])) == [(1, 4, 4, 100.0), (2, 4, 3, 75.0), (3, 2, 1, 50.0)]


# ---- ingredients -------------------------------------------------------------------

def test_j36_j37_recipes(t):
    assert len(I.recipe_toppings(t["pizza_recipes"]).collect()) == 14
    assert rows(I.standard_toppings(t["pizza_recipes"], t["pizza_names"], t["pizza_toppings"])) == [
        ("Meatlovers", "Bacon, BBQ Sauce, Beef, Cheese, Chicken, Mushrooms, Pepperoni, Salami"),
        ("Vegetarian", "Cheese, Mushrooms, Onions, Peppers, Tomatoes, Tomato Sauce")]


def test_j38_j39_most_common(t):
    assert rows(I.most_common(t["items"], t["pizza_toppings"], "extras", "extra")) == [("Bacon", 4)]
    assert rows(I.most_common(t["items"], t["pizza_toppings"], "exclusions", "exclusion")) == [("Cheese", 4)]


def test_j40_order_item_text(t):
    got = dict((r.order_item_id, r.order_item) for r in
               I.order_item_text(t["items"], t["pizza_names"], t["pizza_toppings"]).collect())
    assert got[1] == "Meatlovers"
    assert got[5] == "Meatlovers  - Exclude Cheese"
    assert got[8] == "Meatlovers - Extra Bacon"
    assert got[12] == "Meatlovers  - Exclude Cheese - Extra Bacon, Chicken"
    assert got[14] == "Meatlovers  - Exclude BBQ Sauce, Mushrooms - Extra Bacon, Cheese"
    one = dict((r.order_item_id, r.order_item) for r in I.order_item_text(
        t["items"], t["pizza_names"], t["pizza_toppings"], single_blank=True).collect())
    assert one[7] == "Vegetarian - Exclude Cheese"


def test_j41_item_toppings_multiset(t):
    got = rows(I.item_toppings(t["items"], t["pizza_recipes"]))
    item14 = sorted(tp for i, tp in got if i == 14)
    # recipe 1,2,3,4,5,6,8,10 minus 2,6 plus extras 1,4
    assert item14 == [1, 1, 3, 4, 4, 5, 8, 10]
    # 10 meat x 8 + 4 veggie x 6, minus 6 excluded, plus 6 extras
    assert len(got) == 10 * 8 + 4 * 6 - 6 + 6


def test_j41_no_recipe_keeps_a_null_topping(spark):
    items = spark.createDataFrame([(1, 9, "", "3")], "order_item_id long, pizza_id int, exclusions string, extras string")
    recipes = spark.createDataFrame([(1, "1, 2")], "pizza_id int, toppings string")
    got = [r.topping_id for r in I.item_toppings(items, recipes).collect()]
    assert sorted(got, key=lambda x: -1 if x is None else x) == [None, 3]


def test_j42_ingredient_lists(t):
    got = dict((r.order_item_id, r.ingredient_list) for r in
               I.ingredient_lists(t["items"], t["pizza_recipes"], t["pizza_names"], t["pizza_toppings"]).collect())
    assert got[1] == "Meatlovers: Bacon, BBQ Sauce, Beef, Cheese, Chicken, Mushrooms, Pepperoni, Salami"
    assert got[4] == "Vegetarian: Cheese, Mushrooms, Onions, Peppers, Tomato Sauce, Tomatoes"
    assert got[7] == "Vegetarian: Mushrooms, Onions, Peppers, Tomato Sauce, Tomatoes"
    assert got[10] == "Vegetarian: Bacon, Cheese, Mushrooms, Onions, Peppers, Tomato Sauce, Tomatoes"
    assert got[12] == "Meatlovers: 2xBacon, BBQ Sauce, Beef, 2xChicken, Mushrooms, Pepperoni, Salami"
    assert got[14] == "Meatlovers: 2xBacon, Beef, 2xCheese, Chicken, Pepperoni, Salami"
    assert len(got) == 14


def test_j43_ingredient_usage(t):
    got = rows(I.ingredient_usage(t["items"], t["deliveries"], t["pizza_recipes"], t["pizza_toppings"]))
    assert got == sorted([("Bacon", 12), ("Mushrooms", 11), ("Cheese", 10), ("Beef", 9), ("Chicken", 9),
                          ("Pepperoni", 9), ("Salami", 9), ("BBQ Sauce", 8), ("Onions", 3), ("Peppers", 3),
                          ("Tomato Sauce", 3), ("Tomatoes", 3)])


# ---- pricing -----------------------------------------------------------------------

def test_j44_j45_revenue(t):
    assert rows(P.revenue(t["items"], t["deliveries"], t["pizza_names"], PRICES, 10)) == [(138.0,)]
    assert rows(P.revenue_with_extras(t["items"], t["deliveries"], t["pizza_names"], t["pizza_toppings"],
                                      PRICES, 10, 1)) == [(142.0,)]


def test_j46_ratings_check(t):
    got = {r.order_id: r for r in P.ratings_check(t["order_ratings"], t["deliveries"]).collect()}
    assert len(got) == 10
    assert [o for o, r in got.items() if r.delivered == "N"] == [6, 9] or \
        sorted(o for o, r in got.items() if r.delivered == "N") == [6, 9]
    assert all(r.rating_in_range == "Y" and r.unique_order == "Y" for r in got.values())


def test_j46_save_ratings(spark, t, tmp_path):
    path = str(tmp_path / "order_ratings")
    assert P.save_ratings(t["order_ratings"], t["deliveries"], path) == 2
    assert spark.read.parquet(path).count() == 10
    bad = spark.createDataFrame([(1, 6), (2, 4), (2, 5)], "order_id int, rating int")
    with pytest.raises(ValueError, match="1 out of .* 2 duplicated"):
        P.save_ratings(bad, t["deliveries"], str(tmp_path / "bad"))


def test_j47_delivery_facts(t):
    got = {r.order_id: r for r in P.delivery_facts(t["items"], t["deliveries"], t["order_ratings"]).collect()}
    assert len(got) == 8
    r1, r3 = got[1], got[3]
    assert (r1.customer_id, r1.runner_id, r1.rating, r1.time_to_pickup_secs, r1.num_pizzas) == (101, 1, 4, 632, 1)
    assert abs(r1.average_speed_km_min - 0.625) < 1e-12
    assert (r3.time_to_pickup_secs, r3.num_pizzas) == (21 * 60 + 14, 2)
    assert abs(got[2].average_speed_km_min - 0.74074074074074074) < 1e-12


def test_j48_profit(t):
    assert rows(P.profit(t["items"], t["deliveries"], t["pizza_names"], PRICES, 10, "0.30")) == [(94.44,)]


def test_j41_as_relations_is_the_same(t):
    arrays = rows(I.item_toppings(t["items"], t["pizza_recipes"]))
    assert arrays == rows(I.item_toppings_by_sets(t["items"], t["pizza_recipes"]))


def test_j46_table_is_written_and_read_back(spark, t, tmp_path):
    got = P.ratings_table(t["order_ratings"], t["deliveries"], str(tmp_path / "ratings"))
    assert rows(got, "order_id", "rating") == rows(t["order_ratings"], "order_id", "rating")
    twice = t["order_ratings"].unionByName(t["order_ratings"])
    with pytest.raises(ValueError):
        P.ratings_table(twice, t["deliveries"], str(tmp_path / "again"))
