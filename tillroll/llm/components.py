"""Connected components of links, by alternating large-star and small-star steps.

Both steps are a partial aggregate (the smallest neighbour of each node) and a join back, so a node
with very many links is combined before the shuffle and split by Spark's skew join.  The number of
rounds grows with the logarithm of the longest chain.  Nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return (both.where("v > u").join(least, F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    across = (links.join(least.select(F.col("u").alias("w"), "m"), F.col("u") == F.col("w"))
              .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
    return across.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(links: DataFrame) -> bool:
    """True if every node that has a smaller neighbour has one only, which has none itself."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(
        links.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return seen.where("up > 1 OR (up = 1 AND least = 0)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (bigint columns u and v); the root is the smallest node reachable."""
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_stars(now):
        now = cut(_small_star(_large_star(now)))
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def named(rooted: DataFrame) -> DataFrame:
    """``rooted`` (with _row, id and root) with component_id, its smallest id, and keep_row, the row that has it."""
    least = rooted.groupBy("root").agg(
        F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("x"), "id", "_row")).alias("_keep"))
    return rooted.join(least, "root").withColumn("keep_row", F.col("_keep._row")).drop("_keep", "root")
