"""Subscription journeys, churn and upgrade cohorts.

``subs(customer_id, plan_id, start_date)`` holds one row per plan change and
``plans(plan_id, plan_name, ...)`` names the plans.  Percentages are shares of
all customers ever seen (an uncorrelated scalar subquery, computed once),
rounded half-up.  Per-customer histories are reduced by aggregation before any
join, so no customer's rows are paired with each other (see
``tillroll.operators.cohort``).  Where a customer holds a plan more than once,
J58-J60 come in two forms: by each plan's first date (a customer counts once), and
over all pairs of starts, as a self-join of the table counts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, month_start, period_index, period_label
from ..operators import (first_dates, journey, journey_paths, latest_as_of, moved_after, moved_between, pair_moments,
                         pair_periods, pairs_before, round_ratio, share)


def _all_customers(subs: DataFrame) -> Column:
    return subs.agg(F.countDistinct("customer_id")).scalar()


def plan_journey(subs: DataFrame, plans: DataFrame, customers: list[int] | None = None) -> DataFrame:
    """J49 -> customer_id, plan_name, start_date in date order (chosen customers,
    or all)."""
    return journey(subs, plans, "customer_id", "plan_id", "start_date", "plan_name", customers)


def plan_paths(subs: DataFrame, plans: DataFrame, sep: str = " > ") -> DataFrame:
    """J49 as text -> customer_id, path ('trial > basic monthly > churn'), steps, for every customer."""
    return journey_paths(subs, plans, "customer_id", "plan_id", "start_date", "plan_name", sep)


def customer_count(subs: DataFrame) -> DataFrame:
    """J50 -> num_customers."""
    return subs.agg(F.countDistinct("customer_id").alias("num_customers"))


def trials_per_month(subs: DataFrame, trial_plan: int = 0) -> DataFrame:
    """J51 -> by_month, trial_plans_count."""
    t = subs.filter(F.col("plan_id") == trial_plan)
    return t.groupBy(month_start("start_date").alias("by_month")).agg(
        F.count("customer_id").alias("trial_plans_count"))


def events_after(subs: DataFrame, plans: DataFrame, after: str) -> DataFrame:
    """J52 -> plan_name, events_count for plan starts after ``after``.  Counted per
    plan id first, so the name lookup joins one row per plan."""
    per_plan = subs.filter(F.col("start_date") > F.lit(after).cast("date")).groupBy("plan_id").agg(
        F.count("customer_id").alias("_n"))
    return per_plan.join(plans, "plan_id").groupBy("plan_name").agg(F.sum("_n").alias("events_count"))


def churn_share(subs: DataFrame, plans: DataFrame, churn_name: str = "churn") -> DataFrame:
    """J53 -> churn_count, churn_pct (1 place) of all customers.  Counted per plan
    id first, so a row per plan meets the plan names."""
    per_plan = subs.groupBy("plan_id").agg(F.count("customer_id").alias("_n"))
    churn_ids = plans.filter(F.col("plan_name") == churn_name).select("plan_id")
    churned = per_plan.join(churn_ids, "plan_id", "left_semi")
    c = churned.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("churn_count"))
    return c.select("churn_count", share(F.col("churn_count"), _all_customers(subs), 1).alias("churn_pct"))


def immediate_churn(subs: DataFrame, trial_plan: int = 0, churn_plan: int = 4,
                    trial_days: int = 7) -> DataFrame:
    """J54 -> immediate_churn_count, immediate_churn_pct (whole number): trials
    followed by a churn exactly ``trial_days`` later."""
    moves = moved_after(subs, "customer_id", "plan_id", "start_date", trial_plan, churn_plan, trial_days)
    c = moves.agg(F.count("customer_id").alias("immediate_churn_count"))
    return c.select("immediate_churn_count",
                    share(F.col("immediate_churn_count"), _all_customers(subs), 0).alias("immediate_churn_pct"))


def next_plan_after_trial(subs: DataFrame, plans: DataFrame, trial_plan: int = 0, churn_plan: int = 4,
                          trial_days: int = 7) -> DataFrame:
    """J55 -> plan_name, plan_count, plan_pct of the (non-churn) plans that start
    exactly when the trial ends."""
    to = F.col("plan_id") != F.lit(churn_plan)
    moves = moved_after(subs, "customer_id", "plan_id", "start_date", trial_plan, to, trial_days)
    per_plan = moves.groupBy(F.col("to_state").alias("plan_id")).agg(F.count("customer_id").alias("_n"))
    named = per_plan.join(plans, "plan_id").groupBy("plan_name").agg(F.sum("_n").alias("plan_count"))
    return named.select("plan_name", "plan_count",
                        share(F.col("plan_count"), _all_customers(subs), 0).alias("plan_pct"))


def plan_mix_at(subs: DataFrame, plans: DataFrame, at: str) -> DataFrame:
    """J56 -> plan_name, plan_count, plan_pct of customers' latest plan on ``at``
    (every plan on a customer's latest date counts)."""
    latest = latest_as_of(subs, "customer_id", "start_date", at)
    per_plan = latest.groupBy("plan_id").agg(F.count("customer_id").alias("_n"))
    named = per_plan.join(plans, "plan_id").groupBy("plan_name").agg(F.sum("_n").alias("plan_count"))
    return named.select("plan_name", "plan_count",
                        share(F.col("plan_count"), _all_customers(subs), 0).alias("plan_pct"))


def annual_upgrades(subs: DataFrame, start: str, end: str, annual_plan: int = 3) -> DataFrame:
    """J57 -> annual_plan_count: customers starting the annual plan in [start, end]."""
    a = subs.filter((F.col("plan_id") == annual_plan) &
                    F.col("start_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return a.agg(F.countDistinct("customer_id").alias("annual_plan_count"))


def _days_to_annual(subs: DataFrame, trial_plan: int, annual_plan: int, trial_days: int) -> DataFrame:
    firsts = first_dates(subs, "customer_id", "plan_id", "start_date",
                         {"_trial": trial_plan, "_annual": annual_plan})
    days = (days_between("_annual", "_trial") - trial_days).alias("days_to_upgrade")
    return firsts.select("customer_id", days).filter(F.col("days_to_upgrade").isNotNull())


def avg_days_to_annual(subs: DataFrame, trial_plan: int = 0, annual_plan: int = 3,
                       trial_days: int = 7) -> DataFrame:
    """J58 -> avg_days_to_upgrade: mean days from the end of the trial to the
    annual plan, rounded, over all customers who had both (an annual plan that
    starts before the trial's end counts with its negative number of days)."""
    d = _days_to_annual(subs, trial_plan, annual_plan, trial_days)
    return d.agg(F.round(F.avg("days_to_upgrade")).cast("double").alias("avg_days_to_upgrade"))


def days_to_annual_periods(subs: DataFrame, width: int = 30, trial_plan: int = 0, annual_plan: int = 3,
                           trial_days: int = 7) -> DataFrame:
    """J59 -> period_group ('0-30 days', '31-60 days', ...), customers_count,
    avg_days_to_upgrade; negative numbers of days have periods of their own."""
    d = _days_to_annual(subs, trial_plan, annual_plan, trial_days)
    d = d.withColumn("_idx", period_index("days_to_upgrade", width))
    g = d.groupBy("_idx", period_label("_idx", width).alias("period_group")).agg(
        F.count(F.lit(1)).alias("customers_count"),
        F.round(F.avg("days_to_upgrade")).cast("double").alias("avg_days_to_upgrade"))
    return g.orderBy("_idx").select("period_group", "customers_count", "avg_days_to_upgrade")


def downgrades(subs: DataFrame, start: str, end: str, from_plan: int = 2, to_plan: int = 1) -> DataFrame:
    """J60 -> customer_downgrade_count: customers with a ``from_plan`` start
    before a ``to_plan`` start that lies in [start, end]."""
    moved = moved_between(subs, "customer_id", "plan_id", "start_date", from_plan, to_plan, start, end)
    return moved.agg(F.count("customer_id").alias("customer_downgrade_count"))


def avg_days_over_pairs(subs: DataFrame, trial_plan: int = 0, annual_plan: int = 3, trial_days: int = 7) -> DataFrame:
    """J58 over all pairs of a trial and an annual start of a customer -> avg_days_to_upgrade."""
    m = pair_moments(subs, "customer_id", "plan_id", "start_date", trial_plan, annual_plan)
    return m.select(round_ratio(F.col("days") - F.col("pairs") * trial_days, F.col("pairs"), 0).alias("avg_days_to_upgrade"))


def periods_over_pairs(subs: DataFrame, width: int = 30, trial_plan: int = 0, annual_plan: int = 3,
                       trial_days: int = 7) -> DataFrame:
    """J59 over all such pairs -> period_group, customers_count (pairs), avg_days_to_upgrade."""
    p = pair_periods(subs, "customer_id", "plan_id", "start_date", trial_plan, annual_plan, trial_days, width)
    return p.orderBy("period").select(period_label("period", width).alias("period_group"),
                                      F.col("pairs").cast("bigint").alias("customers_count"),
                                      round_ratio(F.col("days"), F.col("pairs"), 0).alias("avg_days_to_upgrade"))


def downgrade_pairs(subs: DataFrame, start: str, end: str, from_plan: int = 2, to_plan: int = 1) -> DataFrame:
    """J60 over all pairs -> customer_downgrade_count: pairs of a ``from_plan`` start and a later
    ``to_plan`` start of one customer, the later one in [start, end]."""
    return pairs_before(subs, "customer_id", "plan_id", "start_date", from_plan, to_plan, start, end).select(
        F.col("pairs").alias("customer_downgrade_count"))
