"""Recipes, extras, exclusions and ingredient lists.

``recipes(pizza_id, toppings)`` (one row per pizza) and the ``extras`` /
``exclusions`` columns of cleaned order items hold comma-separated topping ids;
``toppings`` maps topping_id -> topping_name.

An item's toppings are "(recipe EXCEPT exclusions) UNION ALL extras".  That set
algebra is evaluated per item row with array functions --
``concat(array_except(recipe, exclusions), extras)``; ``array_except`` is distinct
and null-safe exactly like SQL EXCEPT -- so nothing is shuffled per topping.
An item's text depends on its pizza and its two lists alone, so texts are made once
per distinct combination (a group bounded by one item's lists; for J42 in one row) and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.agg import name_key, ordered_concat
from ..functions.text import split_list
from ..operators import apply_tagged, explode_list, tagged, top_n
from ..operators.lists import ADDED, BASE, REMOVED

ITEM_COLUMNS = ["order_item_id", "order_id", "customer_id"]
# What an item's toppings and texts depend on.
COMBINATION = ["pizza_id", "exclusions", "extras"]
# Tasks per shuffle partition where every item becomes a row per topping.
TOPPING_TASKS = 4


def recipe_toppings(recipes: DataFrame) -> DataFrame:
    """J36 -> pizza_id, topping_id: one row per topping of each recipe."""
    return explode_list(recipes, "toppings", "topping_id", keep=["pizza_id"])


def standard_toppings(recipes: DataFrame, names: DataFrame, toppings: DataFrame) -> DataFrame:
    """J37 -> pizza_name, standard_toppings: topping names of each recipe joined
    with ', ' in topping id order."""
    rt = recipe_toppings(recipes).join(toppings, "topping_id")
    per_pizza = rt.groupBy("pizza_id").agg(
        ordered_concat("topping_name", "topping_id").alias("standard_toppings"))
    return per_pizza.join(names, "pizza_id").select("pizza_name", "standard_toppings")


def most_common(items: DataFrame, toppings: DataFrame, column: str, label: str) -> DataFrame:
    """J38 / J39 -> <label>, pizza_count: the topping named most often in
    ``column`` ('extras' or 'exclusions'); the name breaks ties."""
    per_id = explode_list(items, column, "topping_id").groupBy("topping_id").agg(
        F.count(F.lit(1)).alias("_n"))
    counts = per_id.join(toppings, "topping_id").groupBy(F.col("topping_name").alias(label)).agg(
        F.sum("_n").alias("pizza_count"))
    return top_n(counts, [F.col("pizza_count").desc(), F.col(label).asc()], 1)


def _changed_toppings(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """``items`` plus ``_kept`` (recipe toppings left after the exclusions, distinct),
    ``_extras`` and ``_toppings`` = ``_kept`` ++ ``_extras``, the item's multiset.
    A pizza without a recipe contributes one NULL topping, as the left join of
    the relational form does."""
    # a recipe is read and made distinct once per pizza, not per item
    r = recipes.select("pizza_id", F.array_distinct(split_list("toppings")).alias("_recipe"))
    base = F.coalesce(F.col("_recipe"), F.array(F.lit(None).cast("int")))
    excluded = split_list("exclusions")
    return (items.join(r, "pizza_id", "left")
                 .withColumn("_kept", F.when(F.size(excluded) == 0, base).otherwise(F.array_except(base, excluded)))
                 .withColumn("_extras", split_list("extras"))
                 .withColumn("_toppings", F.concat("_kept", "_extras"))
                 .drop("_recipe"))


def _combinations(items: DataFrame) -> DataFrame:
    """The distinct combinations of pizza and lists; copies meet on the map side."""
    return items.select(*COMBINATION).distinct()


def _with_texts(items: DataFrame, texts: DataFrame, text: str) -> DataFrame:
    """``items`` with the text of their combination (null-safe; items without one are left out)."""
    t = texts.select(*[F.col(c).alias(f"_{c}") for c in COMBINATION], text)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in COMBINATION]
    return items.join(t, same).select(*ITEM_COLUMNS, text)


def order_item_text(items: DataFrame, names: DataFrame, toppings: DataFrame,
                    unkeyed: DataFrame | None = None, single_blank: bool = False) -> DataFrame:
    """J40 -> order_item_id, order_id, customer_id, order_item:
    'Name - Exclude a, b - Extra c, d', parts left out when empty, names in
    alphabetical order.

    By default the text matches the published one, which has two blanks before
    '- Exclude'; ``single_blank=True`` gives one.  ``unkeyed``: the items before they got
    their key, if at hand; the combinations are then read without making the key again.
    """
    both = F.concat(tagged(split_list("exclusions"), REMOVED), tagged(split_list("extras"), ADDED))
    rows = (_combinations(items if unkeyed is None else unkeyed).select(*COMBINATION, F.explode_outer(both).alias("_t"))
            .join(toppings, F.col("_t.id") == F.col("topping_id"), "left")
            .select(*COMBINATION, name_key("topping_name").alias("_k"),
                    F.when(F.col("_t.tag") == REMOVED, F.col("topping_name")).alias("_excluded"),
                    F.when(F.col("_t.tag") == ADDED, F.col("topping_name")).alias("_added")))
    lists = rows.groupBy(*COMBINATION).agg(
        ordered_concat("_excluded", "_k").alias("_x"), ordered_concat("_added", "_k").alias("_e"))
    excl_prefix = "- Exclude " if single_blank else " - Exclude "
    texts = lists.join(names, "pizza_id").select(*COMBINATION, F.concat_ws(
        " ", "pizza_name",
        F.concat(F.lit(excl_prefix), F.col("_x")),
        F.concat(F.lit("- Extra "), F.col("_e"))).alias("order_item"))
    return _with_texts(items, texts, "order_item")


def item_toppings(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """J41 -> order_item_id, topping_id: the recipe's toppings minus the item's
    exclusions (distinct), plus its extras (each extra adds one serving)."""
    return _changed_toppings(items, recipes).select("order_item_id", F.explode("_toppings").alias("topping_id"))


def item_toppings_by_sets(items: DataFrame, recipes: DataFrame) -> DataFrame:
    """J41 as relations: (recipe rows of the items EXCEPT excluded) UNION ALL extras.

    The same rows as ``item_toppings``, as set algebra over one row per topping: all three kinds
    of rows come from one reading of the items and meet in one aggregate.  An item is dealt to its
    task, by its key, with its lists whole; they become rows there, so the aggregate finds an
    item's rows together and none of them is shuffled.  The array form makes no such rows."""
    r = recipes.select("pizza_id", split_list("toppings").alias("_base"))
    # a pizza without a recipe has no row of the base
    base = F.coalesce(F.col("_base"), F.array().cast("array<int>"))
    tasks = TOPPING_TASKS * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = (items.join(r, "pizza_id", "left").select("order_item_id", base.alias("_base"), "exclusions", "extras")
                  .repartition(tasks, "order_item_id")
                  .select("order_item_id", "_base", split_list("exclusions").alias("_removed"), split_list("extras").alias("_added")))
    rows = whole.select("order_item_id", F.size("_base").alias("_b"), F.size("_removed").alias("_r"),
                        F.posexplode(F.concat("_base", "_removed", "_added")).alias("_at", "topping_id"))
    tag = F.when(F.col("_at") < F.col("_b"), BASE).when(F.col("_at") < F.col("_b") + F.col("_r"), REMOVED).otherwise(ADDED)
    return apply_tagged(rows.select("order_item_id", "topping_id", tag.alias("_tag")))


def ingredient_lists(items: DataFrame, recipes: DataFrame, names: DataFrame,
                     toppings: DataFrame, unkeyed: DataFrame | None = None) -> DataFrame:
    """J42 -> order_item_id, order_id, customer_id, ingredient_list:
    'Name: 2xBacon, Beef, ...' -- alphabetical, 'Nx' before toppings used N > 1
    times.

    The kept recipe toppings are distinct, so a topping's quantity is computed in
    the row: 1 if kept, plus its occurrences among the extras.  Names come to a recipe's
    toppings once per recipe and to the extras, where there are some, once per combination;
    a combination's list is put together in its row, so its toppings are not grouped again.
    Topping names are taken to be unique per id (a dimension).  ``unkeyed``: as in
    ``order_item_text``.
    """
    entry = F.struct("topping_id", "topping_name")
    named = (recipes.select("pizza_id", F.explode(F.array_distinct(split_list("toppings"))).alias("topping_id"))
                    .join(toppings, "topping_id").where(F.col("topping_name").isNotNull())
                    .groupBy("pizza_id").agg(F.collect_list(entry).alias("_base_names")))
    # (an entry without a name stays out of the collected list)
    added = (_combinations(items if unkeyed is None else unkeyed)
             .select(*COMBINATION, F.explode_outer(F.array_distinct(split_list("extras"))).alias("_id"))
             .join(toppings, F.col("_id") == F.col("topping_id"), "left").groupBy(*COMBINATION)
             .agg(F.collect_list(F.when(F.col("topping_name").isNotNull(), entry)).alias("_added_names")))
    changed = _changed_toppings(added, recipes.select("pizza_id", "toppings")).join(named, "pizza_id", "left")
    kept = lambda e: F.coalesce(F.array_contains("_kept", e.topping_id), F.lit(False))
    none = F.filter("_added_names", lambda e: F.lit(False))
    entries = F.concat(F.filter(F.coalesce("_base_names", none), kept), F.filter("_added_names", lambda e: ~kept(e)))
    qty = lambda e: (F.when(kept(e), 1).otherwise(0)
                     + F.size("_extras") - F.size(F.array_remove("_extras", e.topping_id)))
    label = lambda e: F.when(qty(e) > 1, F.concat(qty(e).cast("string"), F.lit("x"), e.topping_name)).otherwise(e.topping_name)
    plain = F.transform(entries, lambda e: F.struct(name_key(e.topping_name).alias("k"), e.topping_name.alias("name"), e.topping_name.alias("label")))
    counted = F.transform(entries, lambda e: F.struct(name_key(e.topping_name).alias("k"), e.topping_name.alias("name"), label(e).alias("label")))
    lists = changed.select(*COMBINATION, F.sort_array(F.when(F.size("_extras") == 0, plain).otherwise(counted)).alias("_list"))
    listed = F.when(F.size("_list") > 0, F.array_join(F.col("_list.label"), ", "))
    texts = lists.join(names, "pizza_id").select(
        *COMBINATION, F.concat(F.col("pizza_name"), F.lit(": "), listed).alias("ingredient_list"))
    return _with_texts(items, texts, "ingredient_list")


def ingredient_usage(items: DataFrame, deliveries: DataFrame, recipes: DataFrame,
                     toppings: DataFrame) -> DataFrame:
    """J43 -> topping_name, quantity_used over delivered pizzas.  Delivered items are
    counted per combination, toppings per id with those counts as weights (both with
    map-side partial aggregation), and names are joined at the end."""
    delivered = deliveries.filter(F.col("pickup_time").isNotNull()).select("order_id")
    counted = items.join(delivered, "order_id", "left_semi").groupBy(*COMBINATION).agg(F.count(F.lit(1)).alias("_items"))
    per_id = (_changed_toppings(counted, recipes)
              .select("_items", F.explode("_toppings").alias("topping_id"))
              .groupBy("topping_id").agg(F.sum("_items").alias("_n")))
    return per_id.join(toppings, "topping_id").groupBy("topping_name").agg(
        F.sum("_n").alias("quantity_used"))


def ingredient_lists_of(changes: DataFrame, items: DataFrame, names: DataFrame, toppings: DataFrame) -> DataFrame:
    """J42 from a stored J41 (``changes``: order_item_id, topping_id): the same columns as ``ingredient_lists``.

    Servings are counted per item and topping; an item's lists bound the group that becomes its text.
    """
    counted = changes.groupBy("order_item_id", "topping_id").agg(F.count(F.lit(1)).alias("_q")).join(toppings, "topping_id", "left")
    label = F.when(F.col("_q") > 1, F.concat(F.col("_q").cast("string"), F.lit("x"), F.col("topping_name"))) \
             .otherwise(F.col("topping_name"))
    lists = counted.select("order_item_id", "topping_name", label.alias("_label"), name_key("topping_name").alias("_k")) \
        .groupBy("order_item_id").agg(ordered_concat("_label", "_k", "topping_name").alias("_list"))
    return items.join(lists, "order_item_id").join(names, "pizza_id").select(
        *ITEM_COLUMNS, F.concat(F.col("pizza_name"), F.lit(": "), F.col("_list")).alias("ingredient_list"))


def ingredient_usage_of(changes: DataFrame, items: DataFrame, deliveries: DataFrame, toppings: DataFrame) -> DataFrame:
    """J43 from a stored J41: the same columns as ``ingredient_usage``."""
    delivered = items.join(deliveries.filter(F.col("pickup_time").isNotNull()).select("order_id"), "order_id", "left_semi")
    per_id = changes.join(delivered.select("order_item_id"), "order_item_id", "left_semi").groupBy("topping_id").agg(
        F.count(F.lit(1)).alias("_n"))
    return per_id.join(toppings, "topping_id").groupBy("topping_name").agg(F.sum("_n").alias("quantity_used"))
