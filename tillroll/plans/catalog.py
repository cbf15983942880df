"""Registry: every job wired to tables derived from the driver's Parquet files.

``QUERIES[name](spark, sf_dir)`` returns the job's DataFrame on the stand-in
tables of ``tillroll.sources.standins``; ``PARAMS`` holds the parameters the
stand-ins use in place of the case constants (names, dates, prices).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import interval_microseconds
from ..session import shared_folder
from ..sources import standins as S
from ..sources.tables import read_table
from . import cleaning, couriers, diner, ingredients, order_metrics, pricing, subscriptions

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the stand-in runs (the fixture runs use the case constants).
PARAMS = {
    "double_item": "Brand#1",        # the item that earns double points
    "points_until": "1998-12-31",    # points counted up to this date
    "prices": {"PROMO": 12},         # pizza price by name ...
    "default_price": 10,             # ... and for every other name
    "extra_price": 1,                # charge per extra topping
    "fee_per_km": "0.30",            # courier fee per km
    "week_anchor": "1995-01-01",     # first day of the sign-up weeks
    "starts_after": "2000-12-31",    # plan starts counted after this date
    "mix_at": "1998-12-31",          # plan mix as of this date
    "year_from": "1998-01-01",       # window of annual upgrades and downgrades
    "year_to": "1998-12-31",
}

def _items(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_customer_orders(S.customer_orders(spark, d), with_key=False)


def _keyed_items(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_customer_orders(S.customer_orders(spark, d), with_key=True)


def _ratings_path(spark: SparkSession) -> str:
    """One folder per application: a new run takes the place of the last one."""
    return f"{shared_folder(spark)}/order_ratings-{spark.sparkContext.applicationId}"


def _deliveries(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_runner_orders(S.runner_orders(spark, d))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", "ts")


_TABLES = {
    "sales": S.sales, "menu": S.menu, "members": S.members,
    "customer_orders": S.customer_orders, "runner_orders": S.runner_orders,
    "runners": S.runners, "names": S.pizza_names, "recipes": S.pizza_recipes,
    "toppings": S.pizza_toppings, "ratings": S.order_ratings,
    "items": _items, "order_items": S.order_items, "keyed_items": _keyed_items, "deliveries": _deliveries, "events": _events,
    "subs": S.subscriptions, "plans": lambda spark, d: S.plans(spark),
    "daily": S.daily_states, "daily_plans": S.state_names,
}


def _job(fn: Callable[..., DataFrame], *tables: str, order: tuple[str, ...] = (), **params) -> Query:
    """``order``: the columns a result is sorted by, '-' in front for descending."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(*[_TABLES[t](spark, sf_dir) for t in tables], **params)
        keys = [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]
        return out.orderBy(*keys) if keys else out
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def _in_seconds(df: DataFrame, interval: str) -> DataFrame:
    """An interval column as seconds, in which both engines compare."""
    seconds = interval_microseconds(interval).cast("double") / F.lit(1e6)
    return df.select(*[seconds.alias(f"{c}_secs") if c == interval else F.col(c) for c in df.columns])


QUERIES: dict[str, Query] = {
    # case 1: sales, menu, members
    "J01_spend_per_customer": _job(diner.spend_per_customer, "sales", "menu", order=("customer",)),
    "J02_visit_days": _job(diner.visit_days, "sales", order=("customer",)),
    "J03_first_purchase": _job(diner.first_purchase, "sales", "menu", order=("customer", "first_purchase")),
    "J04_most_purchased": _job(diner.most_purchased, "sales", "menu"),
    "J05_favourite_items": _job(diner.favourite_items, "sales", "menu", order=("customer", "most_popular_item")),
    "J06_first_after_joining": _job(diner.first_after_joining, "sales", "members", "menu",
                                    order=("customer", "first_purchase")),
    "J07_last_before_joining": _job(diner.last_before_joining, "sales", "members", "menu",
                                    order=("customer", "last_purchase_before_member")),
    "J08_spend_before_joining": _job(diner.spend_before_joining, "sales", "members", "menu", order=("customer",)),
    "J09_points": _job(diner.points, "sales", "menu", double_item=PARAMS["double_item"], order=("customer",)),
    "J10_member_points": _job(diner.member_points, "sales", "menu", "members",
                              until=PARAMS["points_until"], double_item=PARAMS["double_item"], order=("customer",)),
    "J11_joined_table": _job(diner.joined_table, "sales", "menu", "members",
                             order=("customer_id", "order_date", "product_name")),
    "J12_ranked_table": _job(diner.ranked_table, "sales", "menu", "members", order=("customer_id", "order_date")),
    # case 2: cleaning
    "J13_profile_missing": _job(cleaning.profile_missing, "customer_orders"),
    "J13_missing_counts": _job(cleaning.missing_profile_counts, "customer_orders"),
    "J14_clean_customer_orders": _job(lambda co: cleaning.clean_customer_orders(co), "customer_orders"),
    "J15_clean_runner_orders": _job(cleaning.clean_runner_orders, "runner_orders"),
    "J16_distance_by_replace": _job(cleaning.distance_by_replace, "runner_orders"),
    "J17_duration_by_prefix": _job(cleaning.duration_by_prefix, "runner_orders"),
    "J18_unparseable_counts": _job(cleaning.unparseable_counts, "customer_orders", "runner_orders",
                                   order=("table_name", "column_name")),
    # case 2: order metrics
    "J19_pizzas_ordered": _job(order_metrics.pizzas_ordered, "order_items"),
    "J20_orders_made": _job(order_metrics.orders_made, "order_items"),
    "J21_delivered_per_runner": _job(order_metrics.delivered_per_runner, "deliveries"),
    "J22_delivered_per_type": _job(order_metrics.delivered_per_type, "order_items", "deliveries", "names",
                                   order=("pizza_name",)),
    "J23_per_customer_type": _job(order_metrics.per_customer_type, "order_items", "names",
                                  order=("customer_id", "pizza_name")),
    "J24_biggest_orders": _job(order_metrics.biggest_orders, "order_items", "deliveries"),
    "J25_changes_per_customer": _job(order_metrics.changes_per_customer, "items", "deliveries",
                                     order=("customer_id", "-with_changes")),
    "J26_both_changes": _job(order_metrics.both_changes, "items", "deliveries", order=("-with_both_changes",)),
    "J27_volume_by_hour": _job(order_metrics.volume_by_hour, "events", ts="ts", counted="event_id",
                               order=("hour_of_order",)),
    "J28_volume_by_weekday": _job(order_metrics.volume_by_weekday, "events", ts="ts", counted="event_id",
                                  order=("-pizzas_ordered", "day_of_week")),
    "J28_volume_by_weekday_number": _job(order_metrics.volume_by_weekday, "events", ts="ts",
                                         counted="event_id", as_number=True),
    # case 2: couriers
    "J29_signups_per_period": _job(couriers.signups_per_period, "runners", anchor=PARAMS["week_anchor"],
                                   order=("start_of_week",)),
    "J30_avg_wait_per_runner": _job(couriers.avg_wait_per_runner, "order_items", "deliveries", order=("runner_id",)),
    "J30_avg_wait_seconds": _job(couriers.avg_wait_per_runner, "order_items", "deliveries", unit="seconds",
                                 per="order", order=("runner_id",)),
    "J30_mean_wait_interval": _job(lambda *tables: _in_seconds(couriers.mean_wait_per_runner(*tables), "mean_wait"),
                                   "order_items", "deliveries", order=("runner_id",)),
    "J31_prep_time_by_size": _job(couriers.prep_time_by_size, "order_items", "deliveries", order=("pizzas_ordered",)),
    "J31_prep_seconds_by_size": _job(couriers.prep_time_by_size, "order_items", "deliveries", unit="seconds",
                                     order=("pizzas_ordered",)),
    "J32_avg_distance_per_runner": _job(couriers.avg_distance_per_runner, "deliveries", order=("runner_id",)),
    "J33_delivery_time_spread": _job(couriers.delivery_time_spread, "deliveries"),
    "J34_speed_per_delivery": _job(couriers.speed_per_delivery, "order_items", "deliveries",
                                   order=("-avg_speed", "order_id")),
    "J35_success_rate": _job(couriers.success_rate, "deliveries", order=("runner_id",)),
    # case 2: ingredients
    "J36_recipe_toppings": _job(ingredients.recipe_toppings, "recipes"),
    "J37_standard_toppings": _job(ingredients.standard_toppings, "recipes", "names", "toppings",
                                  order=("pizza_name", "standard_toppings")),
    "J38_most_common_extra": _job(ingredients.most_common, "items", "toppings", column="extras", label="extra"),
    "J39_most_common_exclusion": _job(ingredients.most_common, "items", "toppings",
                                      column="exclusions", label="exclusion"),
    "J40_order_item_text": _job(ingredients.order_item_text, "keyed_items", "names", "toppings", "items",
                                order=("order_item_id",)),
    "J41_item_toppings": _job(ingredients.item_toppings, "keyed_items", "recipes"),
    "J41_item_toppings_by_sets": _job(ingredients.item_toppings_by_sets, "keyed_items", "recipes"),
    "J42_ingredient_lists": _job(ingredients.ingredient_lists, "keyed_items", "recipes", "names", "toppings", "items",
                                 order=("order_item_id",)),
    "J43_ingredient_usage": _job(ingredients.ingredient_usage, "items", "deliveries", "recipes", "toppings",
                                 order=("-quantity_used", "topping_name")),
    # case 2: pricing and ratings
    "J44_revenue": _job(pricing.revenue, "order_items", "deliveries", "names",
                        prices=PARAMS["prices"], default=PARAMS["default_price"]),
    "J45_revenue_with_extras": _job(pricing.revenue_with_extras, "items", "deliveries", "names", "toppings",
                                    prices=PARAMS["prices"], default=PARAMS["default_price"],
                                    extra_price=PARAMS["extra_price"]),
    "J46_ratings_check": _job(pricing.ratings_check, "ratings", "deliveries"),
    "J46_ratings_table": lambda spark, d: pricing.ratings_table(
        S.order_ratings(spark, d), _deliveries(spark, d), _ratings_path(spark)),
    "J47_delivery_facts": _job(pricing.delivery_facts, "order_items", "deliveries", "ratings"),
    "J47_time_to_pickup_interval": _job(lambda *tables: _in_seconds(couriers.time_to_pickup(*tables), "time_to_pickup"),
                                        "order_items", "deliveries"),
    "J48_profit": _job(pricing.profit, "order_items", "deliveries", "names", prices=PARAMS["prices"],
                       default=PARAMS["default_price"], fee_per_km=PARAMS["fee_per_km"]),
    # case 3: subscriptions (orders as plan changes; events as daily states)
    "J49_plan_journey": _job(subscriptions.plan_journey, "subs", "plans"),
    "J49_plan_paths": _job(subscriptions.plan_paths, "subs", "plans"),
    "J50_customer_count": _job(subscriptions.customer_count, "subs"),
    "J51_trials_per_month": _job(subscriptions.trials_per_month, "subs", order=("by_month",)),
    "J52_events_after": _job(subscriptions.events_after, "subs", "plans", after=PARAMS["starts_after"],
                             order=("-events_count", "plan_name")),
    "J53_churn_share": _job(subscriptions.churn_share, "subs", "plans"),
    "J54_immediate_churn": _job(subscriptions.immediate_churn, "daily"),
    "J55_next_plan_after_trial": _job(subscriptions.next_plan_after_trial, "daily", "daily_plans",
                                      order=("-plan_count", "plan_name")),
    "J56_plan_mix_at": _job(subscriptions.plan_mix_at, "subs", "plans", at=PARAMS["mix_at"],
                            order=("-plan_count", "plan_name")),
    "J57_annual_upgrades": _job(subscriptions.annual_upgrades, "subs",
                                start=PARAMS["year_from"], end=PARAMS["year_to"]),
    "J58_avg_days_to_annual": _job(subscriptions.avg_days_to_annual, "subs"),
    "J59_days_to_annual_periods": _job(subscriptions.days_to_annual_periods, "subs"),
    "J60_downgrades": _job(subscriptions.downgrades, "subs", start=PARAMS["year_from"], end=PARAMS["year_to"]),
    # the same three over all pairs of starts, as a self-join counts them
    "J58_avg_days_over_pairs": _job(subscriptions.avg_days_over_pairs, "subs"),
    "J59_periods_over_pairs": _job(subscriptions.periods_over_pairs, "subs"),
    "J60_downgrade_pairs": _job(subscriptions.downgrade_pairs, "subs", start=PARAMS["year_from"], end=PARAMS["year_to"]),
}
