"""Consecutive surrogate keys without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges per shuffle partition, the least and the largest number of ranges, sampled keys per range,
# and the largest number of identical rows that are numbered as one piece.
RANGES_PER_PARTITION, LEAST_RANGES, MOST_RANGES = 16, 128, 32_768
SAMPLED, COPY_CHUNK = 16, 10_000


def _splitters(pieces: DataFrame, key: Column, ranges: int) -> Column:
    """Scalar array of about ``ranges`` keys that cut the rows into ranges of equal weight.

    The quantile sketch of the whole key: a piece of weight w enters with probability
    1 - exp(-w * rate), decided by a hash of its key, and as often as its weight asks for, so about
    ``SAMPLED * ranges`` keys come together whatever the table's size, heavy ones first; every
    ``SAMPLED``-th of them, in order, is a splitter.  The hash makes it the same in every evaluation."""
    total = pieces.agg(F.sum("_w").alias("t")).select("t").scalar()
    u = (F.xxhash64(key).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    rate = F.lit(float(SAMPLED * ranges)) / total
    times = F.greatest(F.lit(1), F.round(F.col("_w") * rate).cast("int"))
    sample = pieces.filter(-F.log(u) < F.col("_w") * rate).select(F.explode(F.array_repeat(key, times)).alias("k"))
    chosen = sample.agg(F.sort_array(F.collect_list("k")).alias("s"))
    return chosen.select(F.filter("s", lambda x, i: (i + 1) % SAMPLED == 0)).scalar()


def _with_range(pieces: DataFrame, key: Column, ranges: int) -> DataFrame:
    """``pieces`` with _b, how many splitters are not above the key, by binary search."""
    # a sample may be larger than expected, twice at most
    steps = F.array(*[F.lit(1 << i) for i in reversed(range((2 * ranges).bit_length()))])
    # the key is made once a row: inside the search it would be put together at every step
    at = F.transform(F.array(key), lambda k: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        F.get(F.col("_s"), at + step - 1) <= k, at + step).otherwise(at)))
    # never NULL, and stated so: a filter on it would search again
    found = F.coalesce(F.get(at, F.lit(0)), F.lit(0))
    return pieces.withColumn("_s", _splitters(pieces, key, ranges)).withColumn("_b", found).drop("_s")


def surrogate_key(df: DataFrame, order: Sequence[str], name: str, start: int = 1,
                  ranges: int | None = None, chunk: int = COPY_CHUNK) -> DataFrame:
    """Add ``name`` = start, start+1, ... following ``order`` (ROW_NUMBER() OVER
    (ORDER BY order)), as bigint, computed in parallel.  Lazy: nothing runs here.

    1. Identical rows are counted first (the partial aggregate collapses a hot group
       on the map side).  The rest reads these counted rows, from their exchange.
    2. A row with many copies is cut into pieces of at most ``chunk`` copies, which can lie in
       different ranges.
    3. Splitters from a quantile sketch of the whole sort key, weighted by copies, cut the pieces
       into ``ranges`` ranges of nearly equal size, whatever the columns hold: outliers, constant leading
       columns and heavy single values make no large range.  The range depends on the piece and the
       splitters alone, so every evaluation agrees and nothing has to be written.
    4. A piece's first id is the sum of the earlier ranges (a window over a row per range)
       plus a running sum inside its range; its copies are expanded last.

    Two shuffles carry rows: the count and the running sum.  ``ranges`` follows the number of
    shuffle partitions by default.  Rows equal on every ``order`` column but different elsewhere are
    numbered in the order of their other columns.  The types must be orderable (no maps).
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges is None:
        ranges = min(MOST_RANGES, max(LEAST_RANGES, RANGES_PER_PARTITION * partitions))
    cols = df.columns
    sort_cols = list(order) + [c for c in cols if c not in order]
    copies = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    last = F.call_function("div", F.col("_n") - 1, F.lit(chunk))
    pieces = copies.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), last))) \
        .withColumn("_w", F.least(F.lit(chunk).cast("bigint"), F.col("_n") - F.col("_c") * chunk)).drop("_n")
    key = F.struct(*sort_cols, "_c")
    placed = _with_range(pieces, key, ranges).repartition(partitions, "_b")
    before = Window.partitionBy("_b").orderBy(*sort_cols, "_c").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # the check over all columns keeps them in this branch, so that both branches read one exchange
    sizes = placed.groupBy("_b").agg(F.sum("_w").alias("_size"), F.max(F.hash(*cols, "_c")).alias("_check")).filter("_check IS NOT NULL")
    offsets = sizes.select(
        "_b", F.coalesce(F.sum("_size").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
                         F.lit(0)).alias("_off"))
    # a row per range
    keyed = local.join(F.broadcast(offsets), "_b").withColumn("_first", F.col("_off") + F.col("_before") + F.lit(start))
    return keyed.select(*cols, F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_w") - 1)).alias(name))
