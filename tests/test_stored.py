"""Tables that are stored once for several jobs, or published only if their checks hold."""

import os

import pytest
from conftest import rows
from fixtures import pizza
from pyspark.sql import functions as F
from tillroll.plans import cleaning as C
from tillroll.plans import ingredients as I
from tillroll.plans import pricing as P
from tillroll.sources.sinks import StoredTable, publish_checked, store, stored


@pytest.fixture(scope="module")
def t(spark):
    raw = pizza(spark)
    return dict(raw, items=C.clean_customer_orders(raw["customer_orders"]), deliveries=C.clean_runner_orders(raw["runner_orders"]))


def counted(df, acc):
    """``df``, whose rows are counted whenever they are evaluated."""
    def work(batches):
        for batch in batches:
            acc.add(batch.num_rows)
            yield batch
    return df.mapInArrow(work, df.schema)


def test_two_jobs_read_one_stored_table(spark, t):
    seen = spark.sparkContext.accumulator(0)
    items = counted(t["items"], seen)
    changes = store(I.item_toppings(items, t["pizza_recipes"]), "item_toppings")
    once = seen.value
    lists = I.ingredient_lists_of(changes.read(), t["items"], t["pizza_names"], t["pizza_toppings"])
    usage = I.ingredient_usage_of(changes.read(), t["items"], t["deliveries"], t["pizza_toppings"])
    assert rows(lists) == rows(I.ingredient_lists(t["items"], t["pizza_recipes"], t["pizza_names"], t["pizza_toppings"]))
    assert rows(usage) == rows(I.ingredient_usage(t["items"], t["deliveries"], t["pizza_recipes"], t["pizza_toppings"]))
    assert seen.value == once == t["items"].count()
    path = changes.path
    assert os.path.isdir(path) and StoredTable(spark, path).read().count() == changes.read().count()
    with pytest.raises(Exception, match="(?i)exists"):
        changes.write(t["items"])
    changes.release()
    assert not os.path.exists(path)
    with pytest.raises(FileNotFoundError):
        changes.read()
    changes.release()  # twice is no error


def test_released_at_the_end_of_a_block_even_after_an_error(spark):
    kept = []
    with pytest.raises(RuntimeError):
        with stored(spark.range(5), "numbers") as df:
            kept += df.inputFiles()
            assert df.count() == 5
            raise RuntimeError
    assert kept and not any(os.path.exists(f.removeprefix("file://")) for f in kept)


def test_unfinished_write_is_not_read(spark, tmp_path):
    broken = spark.range(10).select(F.raise_error(F.lit("stop")).alias("x"))
    table = StoredTable(spark, str(tmp_path / "t"))
    with pytest.raises(Exception, match="stop"):
        table.write(broken)
    assert not table.whole
    with pytest.raises(FileNotFoundError):
        table.read()


def test_checked_write_evaluates_once_and_leaves_nothing_behind(spark, t, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    folder = tmp_path / "d"
    folder.mkdir()
    path = str(folder / "ratings")
    ratings = t["order_ratings"].withColumn("note", F.lit("x"))
    assert P.save_ratings(counted(ratings, seen), t["deliveries"], path) == 2
    assert seen.value == ratings.count() and rows(spark.read.parquet(path)) == rows(ratings)
    for bad in ([(1, 6)], [(1, None)], [(2, 4), (2, 4)]):
        df = spark.createDataFrame(bad, "order_id int, rating int")
        with pytest.raises(ValueError):
            P.save_ratings(df, t["deliveries"], str(folder / "bad"))
        # and an earlier table stays as it is
        with pytest.raises(ValueError):
            P.save_ratings(df, t["deliveries"], path)
    assert sorted(os.listdir(folder)) == ["ratings"] and spark.read.parquet(path).count() == 10
    # a good one takes its place; an empty one is a table too
    assert P.save_ratings(t["order_ratings"].limit(0), t["deliveries"], path) == 0
    assert spark.read.parquet(path).count() == 0


def test_metrics_are_given_to_the_check(spark, tmp_path):
    got = publish_checked(spark.range(7), str(tmp_path / "n"), {"n": F.count("*"), "top": F.max("id")}, lambda seen: None)
    assert got == {"n": 7, "top": 6}
