"""Business tables derived from the driver's TPC-H-like tables.

Every job in ``tillroll.plans`` takes tables shaped like the case tables
(sales/menu/members, raw customer and runner orders, recipes, subscriptions).
These functions build such tables from the driver's Parquet files with Spark,
so every registered query reads the given tables and its work grows with them.
The raw text tables are rendered with the same kinds of dirt the cleaning jobs
must handle (fake nulls, units with and without a blank, comma lists), by fixed
rules on real columns, so the whole clean -> analyse chain runs end to end.

Rules (also written out, independently, as SQL in ``plans.oracle_sql``):

- sales       lineitem x orders: customer_id = o_custkey, order_date =
              date(o_orderdate), product_id = l_partkey
- menu        part: product_id = p_partkey, product_name = p_brand,
              price = p_retailprice as decimal(12,2)
- members     per o_custkey the first order date among '1-URGENT' orders
- customer_orders  one row per lineitem: order_id, customer_id, pizza_id =
              l_partkey, order_time = o_orderdate;
              exclusions = supplier nation of returned lines ('R'),
              extras = "supplier nation, line number" when the discount is 0,
              supplier nation alone when it is 0.1; otherwise a fake null:
              '' (tax 0), 'null' (line status 'O'), NULL (return flag 'A'), 'NaN'
- runner_orders    one row per order with lines: runner_id = smallest supplier
              key; pickup = first ship date after the order date (none for
              status 'O'); distance = total quantity / 10 km; duration = days
              from order to pickup; unit spelling and fake nulls by priority
- runners     supplier: registration_date = first ship date of the supplier
- pizza_names part: pizza_id = p_partkey, pizza_name = p_type
- pizza_recipes   part: toppings = the distinct supplier nations the part
              shipped from (at most 25 values), ', '-separated in key order
- pizza_toppings  nation: topping_id = n_nationkey, topping_name = n_name
- order_ratings   orders: rating = 6 - leading digit of o_orderpriority
- subscriptions   orders: customer_id = o_custkey, plan_id = leading digit of
              o_orderpriority - 1, start_date = date(o_orderdate)
- daily_states    events: distinct (user_id, event type as plan 0..4, date(ts))
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table

# The subscription plans of the case (id, name, monthly price).
PLANS = [
    (0, "trial", "0.00"),
    (1, "basic monthly", "9.90"),
    (2, "pro monthly", "19.90"),
    (3, "pro annual", "199.00"),
    (4, "churn", None),
]

# Event types of the events table, in the plan order they stand for.
EVENT_STATES = ["signup", "view", "click", "purchase", "error"]

def plans(spark: SparkSession) -> DataFrame:
    """The five plans as an inline table, whose size the planner knows."""
    rows = ", ".join(f"({i}, '{name}', CAST({'NULL' if price is None else price} AS DECIMAL(5, 2)))"
                     for i, name, price in PLANS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(plan_id, plan_name, price)")


# --- sales, menu, members ---------------------------------------------------

def sales(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return j.select(F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderdate").cast("date").alias("order_date"),
                    F.col("l_partkey").alias("product_id"))


def menu(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("product_id"),
                    F.col("p_brand").alias("product_name"),
                    F.col("p_retailprice").cast("decimal(12,2)").alias("price"))


def members(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return (o.filter(F.col("o_orderpriority") == "1-URGENT")
             .groupBy(F.col("o_custkey").alias("customer_id"))
             .agg(F.min(F.col("o_orderdate").cast("date")).alias("join_date")))


# --- raw customer and runner orders -----------------------------------------

def _fake_null_by_line() -> F.Column:
    return (F.when(F.col("l_tax") == 0, F.lit(""))
             .when(F.col("l_linestatus") == "O", F.lit("null"))
             .when(F.col("l_returnflag") == "A", F.lit(None).cast("string"))
             .otherwise(F.lit("NaN")))


def customer_orders(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    nation = F.col("s_nationkey").cast("string")
    exclusions = F.when(F.col("l_returnflag") == "R", nation).otherwise(_fake_null_by_line())
    extras = (F.when(F.col("l_discount") == 0,
                     F.concat(nation, F.lit(", "), F.col("l_linenumber").cast("string")))
               .when(F.col("l_discount") == 0.1, nation)
               .otherwise(_fake_null_by_line()))
    return j.select(F.col("l_orderkey").alias("order_id"),
                    F.col("o_custkey").alias("customer_id"),
                    F.col("l_partkey").alias("pizza_id"),
                    exclusions.alias("exclusions"),
                    extras.alias("extras"),
                    F.col("o_orderdate").alias("order_time"))


def order_items(spark: SparkSession, d: str) -> DataFrame:
    """``customer_orders`` without its list columns: order_id, customer_id, pizza_id, order_time.
    The lists alone need the supplier, so jobs that do not read them are spared that join."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                    F.col("l_partkey").alias("pizza_id"), F.col("o_orderdate").alias("order_time"))


def _by_priority(values: dict[str, F.Column], other: F.Column) -> F.Column:
    out = None
    for prio, v in values.items():
        cond = F.col("o_orderpriority") == prio
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(other)


def runner_orders(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_shipdate")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    per_order = j.groupBy("l_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate").agg(
        F.min("l_suppkey").alias("runner_id"),
        F.min(F.when(F.col("l_shipdate") > F.col("o_orderdate"), F.col("l_shipdate"))).alias("_ship"),
        F.sum("l_quantity").cast("bigint").alias("_qty"))
    pickup = F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("timestamp_ntz")).otherwise(F.col("_ship"))
    per_order = per_order.withColumn("_pickup", pickup)
    delivered = F.col("_pickup").isNotNull()
    missing = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
                     F.lit("null")).otherwise(F.lit(None).cast("string"))
    km = F.concat(F.call_function("div", F.col("_qty"), F.lit(10)).cast("string"), F.lit("."),
                  (F.col("_qty") % 10).cast("string"))
    days = F.datediff(F.col("_pickup"), F.col("o_orderdate")).cast("string")
    distance = _by_priority({"1-URGENT": F.concat(km, F.lit("km")),
                             "2-HIGH": F.concat(km, F.lit(" km")),
                             "4-NOT SPECIFIED": F.concat(km, F.lit("km"))}, km)
    duration = _by_priority({"1-URGENT": F.concat(days, F.lit(" minutes")),
                             "2-HIGH": F.concat(days, F.lit("mins")),
                             "4-NOT SPECIFIED": F.concat(days, F.lit(" minute")),
                             "5-LOW": F.concat(days, F.lit("minutes"))}, days)
    cancel_kind = F.when(F.col("o_orderstatus") == "O", F.lit("Customer Cancellation")) \
        .otherwise(F.lit("Restaurant Cancellation"))
    no_cancel = _by_priority({"2-HIGH": F.lit("null"),
                              "3-MEDIUM": F.lit(None).cast("string"),
                              "4-NOT SPECIFIED": F.lit("NaN")}, F.lit(""))
    return per_order.select(
        F.col("l_orderkey").alias("order_id"),
        "runner_id",
        F.when(delivered, F.date_format("_pickup", "yyyy-MM-dd HH:mm:ss")).otherwise(missing).alias("pickup_time"),
        F.when(delivered, distance).otherwise(missing).alias("distance"),
        F.when(delivered, duration).otherwise(missing).alias("duration"),
        F.when(delivered, no_cancel).otherwise(cancel_kind).alias("cancellation"))


def runners(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier").select("s_suppkey")
    li = read_table(spark, d, "lineitem").select("l_suppkey", "l_shipdate")
    first = li.groupBy("l_suppkey").agg(F.min("l_shipdate").cast("date").alias("registration_date"))
    return s.join(first, s.s_suppkey == first.l_suppkey, "left").select(
        F.col("s_suppkey").alias("runner_id"), "registration_date")


def pizza_names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("pizza_id"),
                                               F.col("p_type").alias("pizza_name"))


def pizza_recipes(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    s = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    # A set of nation keys: at most 25 values per part however many lines the
    # part has (collect_set keeps distinct values only, and combines map-side),
    # so the per-part list is bounded and built in one shuffle.
    pairs = li.join(s, li.l_suppkey == s.s_suppkey)
    nations = F.array_sort(F.collect_set("s_nationkey")).cast("array<string>")
    return pairs.groupBy(F.col("l_partkey").alias("pizza_id")).agg(
        F.array_join(nations, ", ").alias("toppings"))


def pizza_toppings(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation").select(F.col("n_nationkey").alias("topping_id"),
                                                 F.col("n_name").alias("topping_name"))


def order_ratings(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"),
                    (F.lit(6) - F.left("o_orderpriority", F.lit(1)).cast("int")).alias("rating"))


# --- subscriptions ------------------------------------------------------------

def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("customer_id"),
                    (F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("plan_id"),
                    F.col("o_orderdate").cast("date").alias("start_date"))


def daily_states(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_type", "ts")
    state = None
    for i, name in enumerate(EVENT_STATES):
        cond = F.col("event_type") == name
        state = F.when(cond, F.lit(i)) if state is None else state.when(cond, F.lit(i))
    return e.select(F.col("user_id").alias("customer_id"), state.alias("plan_id"),
                    F.col("ts").cast("date").alias("start_date")).distinct()


def state_names(spark: SparkSession, d: str) -> DataFrame:
    """Plan dimension for ``daily_states``: one row per event type seen."""
    e = read_table(spark, d, "events").select("event_type").distinct()
    state = None
    for i, name in enumerate(EVENT_STATES):
        cond = F.col("event_type") == name
        state = F.when(cond, F.lit(i)) if state is None else state.when(cond, F.lit(i))
    return e.select(state.alias("plan_id"), F.col("event_type").alias("plan_name"))
