"""Sharding by jump consistent hashing.

A key's shard depends on the key and the number of shards alone; there is no ring table.  With
one more shard, a row either keeps its shard or moves into the new one.

``jump_shard`` is a column function for any table.  ``shard_rows`` gives whole documents, laid out
by shard and slot: each shard is cut into ranges by a hash of the row's number, the documents are
shuffled once to their ranges, each range is numbered on its own, and the sums of the earlier ranges
are added.  A key that repeats a million times is spread over its shard's ranges.  There are enough
ranges that each holds about ``ROWS`` rows and ``BYTES`` of text at most.

Defined cases: a null key goes where key 0 goes; equal keys share a shard; repeated rows get a
slot each; a text of any length is placed whole; an empty table gives an empty result; columns named as
the new ones give way to them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.llm.support import OWN, ROW, numbered

#: Fixed values of the published algorithm: the generator's multiplier, and the steps of its 31-bit fraction.
MULTIPLIER, STEPS = np.uint64(2862933555777941757), float(1 << 31)


ROWS, BYTES = 20_000, 32 << 20


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, from 0, of each unsigned 64-bit key."""
    state, place = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    moving = np.arange(len(keys))
    ahead = np.zeros(len(keys), dtype=np.int64)
    while len(moving):
        place[moving] = ahead[moving]
        state[moving] = state[moving] * MULTIPLIER + np.uint64(1)
        fraction = STEPS / ((state[moving] >> np.uint64(33)).astype(np.float64) + 1.0)
        ahead[moving] = ((place[moving] + 1) * fraction).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return place


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a bigint key among ``shards``."""
    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump(values.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return place(F.coalesce(key.cast("long"), F.lit(0).cast("long")))


def shard_rows(docs: DataFrame, key: str = "doc_id", shards: int = 8, rows_per_range: int = ROWS,
               bytes_per_range: int = BYTES) -> DataFrame:
    """``docs`` with all their columns, and shard, grown_shard (with one shard more) and slot (from 0, without
    gaps inside each shard) in place of columns with these names; laid out by shard and slot."""
    part, s, r, m, start = (f"{OWN}{x}" for x in ("range", "s", "r", "m", "start"))
    new = ("shard", "grown_shard", "slot")
    names = [c for c in docs.columns if c not in new]
    rows = numbered(docs)  # read twice, with the same numbers
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in docs.schema if f.dataType.typeName() in ("string", "binary")]
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(sum(texts, F.lit(0)).cast("long")).alias("bytes")).first()
    n_ranges = max(1, size["rows"] // (rows_per_range * shards), (size["bytes"] or 0) // (bytes_per_range * shards))
    in_range = F.pmod(F.xxhash64(ROW), F.lit(n_ranges)).alias(part)
    shard = jump_shard(F.col(key), shards)
    sizes = rows.select(shard.alias(s), in_range.alias(r)).groupBy(s, r).agg(F.count(F.lit(1)).alias(m))
    earlier = W.partitionBy(s).orderBy(r).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    starts = sizes.select(s, r, F.coalesce(F.sum(m).over(earlier), F.lit(0).cast("long")).alias(start))
    placed = rows.select(*names, ROW, in_range, shard.alias("shard"),
                         jump_shard(F.col(key), shards + 1).alias("grown_shard"))
    inside = W.partitionBy("shard", part).orderBy(ROW)
    numbers = placed.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    joined = numbers.join(starts, (F.col("shard") == F.col(s)) & (F.col(part) == F.col(r)))
    return joined.select(*names, "shard", "grown_shard", (F.col(start) + F.col("slot")).alias("slot"))
