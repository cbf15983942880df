"""The pair-free operators give the same answers as the straightforward
formulations they replace (self-joins, global windows), on random histories."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators import latest_as_of, moved_after, moved_between, surrogate_key
from tillroll.plans import diner, subscriptions

D0 = dt.date(2020, 1, 1)
events = st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.integers(0, 40)), min_size=0, max_size=40)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
SCHEMA = "customer_id int, plan_id int, start_date date"


def _df(spark, rows):
    return spark.createDataFrame([(c, p, D0 + dt.timedelta(days=d)) for c, p, d in rows], SCHEMA)


@SETTINGS
@given(rows=events)
def test_moved_between_equals_pair_join(spark, rows):
    df = _df(spark, rows)
    lo, hi = "2020-01-10", "2020-02-05"
    got = {r.customer_id for r in moved_between(df, "customer_id", "plan_id", "start_date", 2, 1, lo, hi).collect()}
    a, b = df.alias("a"), df.alias("b")
    pairs = a.join(b, (F.col("a.customer_id") == F.col("b.customer_id")) & (F.col("a.plan_id") == 2) &
                   (F.col("b.plan_id") == 1) & (F.col("a.start_date") < F.col("b.start_date")) &
                   F.col("b.start_date").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    assert got == {r[0] for r in pairs.select("a.customer_id").distinct().collect()}


@SETTINGS
@given(rows=events)
def test_moved_after_equals_offset_self_join(spark, rows):
    df = _df(spark, rows)
    got = sorted(tuple(r) for r in moved_after(df, "customer_id", "plan_id", "start_date", 0,
                                              F.col("plan_id") != 4, 7).collect())
    d = df.distinct()
    a, b = d.alias("a"), d.alias("b")
    pairs = a.join(b, (F.col("a.customer_id") == F.col("b.customer_id")) & (F.col("a.plan_id") == 0) &
                   (F.col("b.plan_id") != 4) & (F.col("b.start_date") == F.date_add(F.col("a.start_date"), 7)))
    want = sorted(tuple(r) for r in pairs.select("a.customer_id", "a.start_date", "b.plan_id", "b.start_date").collect())
    assert got == want


@SETTINGS
@given(rows=events)
def test_latest_as_of_equals_max_join(spark, rows):
    df = _df(spark, rows)
    at = "2020-01-25"
    got = sorted(tuple(r) for r in latest_as_of(df, "customer_id", "start_date", at)
                 .select("customer_id", "plan_id", "start_date").collect())
    upto = [(c, p, D0 + dt.timedelta(days=d)) for c, p, d in rows if D0 + dt.timedelta(days=d) <= dt.date(2020, 1, 25)]
    last = {}
    for c, _, s in upto:
        last[c] = max(last.get(c, s), s)
    assert got == sorted(r for r in upto if r[2] == last[r[0]])


@SETTINGS
@given(rows=events, joins=st.dictionaries(st.integers(0, 3), st.integers(0, 40)))
def test_member_jobs_equal_join_and_window(spark, rows, joins):
    sales = spark.createDataFrame([(c, D0 + dt.timedelta(days=d), p) for c, p, d in rows],
                                  "customer_id int, order_date date, product_id int")
    menu = spark.createDataFrame([(p, f"item {p}", 10 + p) for p in range(5)], "product_id int, product_name string, price int")
    members = spark.createDataFrame([(c, D0 + dt.timedelta(days=d)) for c, d in joins.items()], "customer_id int, join_date date")
    j = sales.join(menu, "product_id").join(members, "customer_id", "left")
    member = F.coalesce(F.col("order_date") >= F.col("join_date"), F.lit(False))
    bag = lambda df: sorted(map(repr, map(tuple, df.collect())))
    for job, mine, desc in ((diner.first_after_joining, member, False),
                            (diner.last_before_joining, F.col("order_date") < F.col("join_date"), True)):
        order = F.col("order_date").desc() if desc else F.col("order_date")
        want = j.where(mine).withColumn("r", F.rank().over(Window.partitionBy("customer_id").orderBy(order)))
        assert bag(job(sales, members, menu)) == bag(want.where("r = 1").select("customer_id", "product_name"))
    ranks = F.dense_rank().over(Window.partitionBy("customer_id", "m").orderBy("order_date"))
    want = j.withColumn("m", member).withColumn("r", F.when(F.col("m"), ranks.cast("bigint")))
    want = want.select("customer_id", "order_date", "product_name", "price", F.when(F.col("m"), "Y").otherwise("N"), "r")
    assert bag(diner.ranked_table(sales, menu, members)) == bag(want)


@SETTINGS
@given(rows=events)
def test_upgrade_days_equal_the_self_join(spark, rows):
    """On one row per customer and plan, as the published answers have it."""
    once = list({(c, p): (c, p, d) for c, p, d in rows}.values())
    df = _df(spark, once)
    a, b = df.where("plan_id = 0").alias("a"), df.where("plan_id = 3").alias("b")
    days = F.datediff("b.start_date", "a.start_date") - 7
    want = a.join(b, F.col("a.customer_id") == F.col("b.customer_id")).agg(F.round(F.avg(days)).cast("double")).first()[0]
    assert subscriptions.avg_days_to_annual(df).first()[0] == want


@SETTINGS
@given(rows=events)
def test_surrogate_key_equals_row_number(spark, rows):
    df = _df(spark, rows)
    got = sorted(tuple(r) for r in surrogate_key(df, ["customer_id", "start_date", "plan_id"], "k",
                                                 ranges=3, chunk=2).collect())
    w = Window.orderBy("customer_id", "start_date", "plan_id")
    want = sorted(tuple(r) for r in df.withColumn("k", F.row_number().over(w)).collect())
    assert got == want
