"""Surrogate keys on tables whose sort keys are unevenly spread."""

import re

import pytest
from pyspark.sql import functions as F

from tillroll.operators import surrogate_key

# 100,001 rows each: one value far from all others; a leading column that never changes; one value
# with a third of the rows; text that shares a long beginning; identical rows
TABLES = {
    "outlier": ("SELECT id * 7919 % 100000 AS v FROM range(100000) UNION ALL SELECT 1000000000000000", ["v"]),
    "constant lead": ("SELECT 7 AS lead, id * 7919 % 100001 AS v FROM range(100001)", ["lead", "v"]),
    "hot lead": ("SELECT CASE WHEN id % 3 = 0 THEN 5 ELSE id END AS lead, id AS v FROM range(100001)", ["lead", "v"]),
    "long prefix": ("SELECT concat(repeat('x', 300), cast(id AS string)) AS v FROM range(100001)", ["v"]),
    "copies": ("SELECT CASE WHEN id < 70000 THEN 1 ELSE id END AS v FROM range(100001)", ["v"]),
}


@pytest.fixture
def fixed_partitions(spark):
    """Eight shuffle partitions that stay apart, so that tasks can be compared."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_tasks_are_even_and_ids_are_consecutive(spark, fixed_partitions, name):
    sql, order = TABLES[name]
    keyed = surrogate_key(spark.sql(sql), order, "k", chunk=500).withColumn("_task", F.spark_partition_id())
    n, least, most, distinct = keyed.agg(F.count("k"), F.min("k"), F.max("k"), F.countDistinct("k")).first()
    assert (n, least, most, distinct) == (100_001, 1, 100_001, 100_001)
    tasks = sorted(r["count"] for r in keyed.groupBy("_task").count().collect())
    assert len(tasks) == 8 and tasks[-1] <= 2 * tasks[len(tasks) // 2]
    # in the stated order
    pairs = keyed.select(*order, "k").orderBy("k").collect()
    values = [tuple(r[c] for c in order) for r in pairs]
    assert values == sorted(values)


def test_input_is_evaluated_once(spark, tmp_path):
    spark.range(2000).selectExpr("id % 700 AS v", "cast(id % 5 AS string) AS w").write.parquet(str(tmp_path / "t"))
    seen = spark.sparkContext.accumulator(0)

    def count_rows(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.read.parquet(str(tmp_path / "t")).mapInArrow(count_rows, "v long, w string")
    keyed = surrogate_key(df, ["v", "w"], "k")
    assert len(keyed.collect()) == 2000 and seen.value == 2000
    # splitters and offsets read the counted rows from their exchange; no array of splitters travels with the rows
    plan = keyed._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and not re.search(r"Project \[[^\n]* AS _s#", final)


def test_mixed_types_and_nulls(spark):
    rows = [(None, "b", None), (1.5, None, 3), (float("nan"), "a", 1), (-0.5, "Z", 2), (1.5, "é", None), (1.5, None, 3)]
    df = spark.createDataFrame(rows, "x double, y string, z int")
    got = [r.k for r in surrogate_key(df, ["x", "y", "z"], "k", ranges=2).orderBy("x", "y", "z", "k").collect()]
    assert got == [1, 2, 3, 4, 5, 6]
    assert surrogate_key(df.limit(0), ["x"], "k").count() == 0


def test_the_search_does_not_build_the_key_at_every_step(spark):
    keyed = surrogate_key(spark.range(50).selectExpr("id % 7 AS v", "cast(id AS string) AS w"), ["v", "w"], "k")
    plan = keyed._jdf.queryExecution().optimizedPlan().toString()
    search = plan[plan.index("aggregate(["):]
    assert "struct(" not in search[:search.index(" AS _b#")]
