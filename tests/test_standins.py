"""The stand-in tables keep the properties the jobs and the docs rely on."""

import os

import pytest
from pyspark.sql import functions as F

from tillroll.plans import cleaning as C
from tillroll.sources import standins as S
from tillroll.sources.tables import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_recipes_are_bounded_by_the_nation_count(spark):
    r = S.pizza_recipes(spark, SF).select(F.size(F.split("toppings", ", ")).alias("n"))
    assert r.agg(F.max("n")).first()[0] <= 25


def test_dirty_runner_text_parses_back_to_the_source_numbers(spark):
    clean = C.clean_runner_orders(S.runner_orders(spark, SF)).filter(F.col("pickup_time").isNotNull())
    li = read_table(spark, SF, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))
    o = read_table(spark, SF, "orders").select("o_orderkey", "o_orderdate")
    j = clean.join(li, clean.order_id == li.l_orderkey).join(o, clean.order_id == o.o_orderkey)
    bad = j.filter((F.col("distance_km") * 10 != F.col("q")) |
                   (F.col("duration_mins") != F.datediff("pickup_time", "o_orderdate")))
    assert j.count() > 0 and bad.count() == 0


def test_every_fake_null_spelling_occurs_and_is_cleaned(spark):
    raw = S.customer_orders(spark, SF)
    spellings = {r[0] for r in raw.select("extras").distinct().collect()
                 if r[0] is None or r[0] in ("", "null", "NaN")}
    assert spellings == {None, "", "null", "NaN"}
    items = C.clean_customer_orders(raw, with_key=False)
    assert items.filter(F.col("extras").isNull() | F.col("extras").isin("null", "NaN")).count() == 0


def test_subscription_plans_cover_all_five(spark):
    subs = S.subscriptions(spark, SF)
    assert sorted(r[0] for r in subs.select("plan_id").distinct().collect()) == [0, 1, 2, 3, 4]


def test_the_two_duration_parsers_agree_on_every_row(spark):
    raw = S.runner_orders(spark, SF)
    both = C.clean_runner_orders(raw).join(C.duration_by_prefix(raw), "order_id")
    assert both.count() > 0
    assert both.where(~F.col("duration_mins").eqNullSafe(F.col("duration"))).count() == 0
