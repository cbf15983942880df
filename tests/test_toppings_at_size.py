"""Toppings and their lists: what is shuffled and sorted, and rows with gaps."""

from pyspark.sql import functions as F

from tillroll.plans import ingredients as I

ITEMS = [(1, 1, 1, 10, "", ""), (2, 1, 1, 10, "2, 9", "2, 2, 7"), (3, 2, 1, 11, "", "1"), (4, 2, 2, 12, "1", "8"),
         (5, 3, 2, 13, "", ""), (6, 3, 2, 13, "5", "5")]


def tables(spark):
    items = spark.createDataFrame(ITEMS, "order_item_id long, order_id long, customer_id long, pizza_id int, exclusions string, extras string")
    # a topping twice in a recipe, an empty recipe, a pizza (13) without one
    recipes = spark.createDataFrame([(10, "3, 2, 1, 2"), (11, ""), (12, "1, 3")], "pizza_id int, toppings string")
    names = spark.createDataFrame([(10, "Ten"), (11, "Eleven"), (12, "Twelve"), (13, "Thirteen")], "pizza_id int, pizza_name string")
    # 3 has no name, 8 is not listed, 7 has two
    toppings = spark.createDataFrame([(1, "Édam"), (2, "eggs"), (3, None), (5, "Figs"), (7, "Dill"), (7, "Cress")],
                                     "topping_id int, topping_name string")
    return items, recipes, names, toppings


def test_no_topping_row_of_the_sets_is_shuffled(spark):
    items, recipes, _, _ = tables(spark)
    sets, arrays = I.item_toppings_by_sets(items, recipes), I.item_toppings(items, recipes)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    # from the top to the first exchange: the rows are made and aggregated in one stage
    assert "posexplode" in plan.split("Exchange")[0]
    # the array form has an empty topping for a pizza without a recipe, the sets have none
    assert sorted(map(repr, sets.collect())) == sorted(map(repr, arrays.where("topping_id IS NOT NULL").collect()))
    assert sorted((r.order_item_id, r.topping_id) for r in sets.where("order_item_id < 3").collect()) == [
        (1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 2), (2, 3), (2, 7)]


def test_ingredient_lists_are_put_together_in_the_row(spark):
    got = I.ingredient_lists(*tables(spark))
    # no aggregate over a combination's toppings, which Spark would sort
    assert "listagg" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.order_item_id: r.ingredient_list for r in got.collect()} == {
        1: "Ten: Édam, eggs", 2: "Ten: Cress, Dill, Édam, 2xeggs", 3: "Eleven: Édam", 4: None, 5: None, 6: "Thirteen: Figs"}


def test_an_item_without_exclusions_needs_no_set_difference(spark):
    items, recipes, _, _ = tables(spark)
    plan = I.item_toppings(items, recipes)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct(" in plan
    got = I.item_toppings(items.where("exclusions = ''"), recipes).groupBy("order_item_id").agg(
        F.sort_array(F.collect_list(F.coalesce("topping_id", F.lit(-1)))).alias("t")).collect()
    assert {r.order_item_id: r.t for r in got} == {1: [1, 2, 3], 3: [1], 5: [-1]}
