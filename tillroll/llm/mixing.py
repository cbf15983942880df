"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is ``weight * budget / size``.  A document's number of copies is
the Poisson quantile, at the source's rate, of a uniform number hashed from seed and id: the same
document gets the same number in every run and on every cluster, and no random state is kept.
The document is repeated that often (0 drops it), and all copies are shuffled globally: dealt to
partitions by a hash and ordered inside them by a hash of id and copy.

Sizes are counted per source with a partial aggregate (a hot source costs a row per task).  The
quantiles of a source are a short array around its rate, made once per source.  The table of
sources is broadcast only if it has at most ``BROADCAST_SOURCES`` rows; beyond, it is joined by a
shuffle whose skew Spark splits.

Defined cases: null is a source of its own; a null text has size 1 like an empty one (size: code
points plus 1, so no rate is infinite); equal ids get equal numbers of copies, each row its own;
sources without a stated weight share what the stated ones leave, equally; an empty table gives
an empty result; texts of any length move whole; other columns, of whatever name, are passed on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import OWN, cut, text_of, with_row

BROADCAST_SOURCES = 10_000
#: Quantile arrays end where less than this probability is left on either side.
TAIL = 1e-15


def uniform(seed: int, *parts: str) -> Column:
    """52 hashed bits as a number inside (0, 1)."""
    return (hashed(seed, *parts) + F.lit(0.5)) / F.lit(float(1 << 52))


def quantiles(rate: float) -> tuple[int, list[float]]:
    """The smallest count worth listing, and the distribution function from there on."""
    spread = 9.0 * math.sqrt(rate) + 40.0
    low, high = max(0, math.floor(rate - spread)), math.ceil(rate + spread)
    k = np.arange(low, high + 1, dtype=np.float64)
    log_mass = (k * math.log(rate) if rate > 0 else np.where(k == 0, 0.0, -np.inf)) - rate
    log_mass = log_mass - np.array([math.lgamma(x + 1.0) for x in k])
    mass = np.cumsum(np.exp(log_mass))
    return low, mass[mass < 1.0 - TAIL].tolist()


def _with_quantiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found = [quantiles(x) for x in batch["rate"]]
        yield pd.DataFrame({"source": batch["source"], "rate": batch["rate"],
                            "low": [x for x, _ in found], "below": [x for _, x in found]})


def rates(docs: DataFrame, weights: Mapping[str, float], budget: float | None = None,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """A row per source: source, rate, low, below (the arrays that ``copies`` reads)."""
    sizes = cut(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.sum(F.char_length(text_of(text_col)) + F.lit(1).cast("long")).alias("size")))
    stated = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None
    weight = F.element_at(stated, F.coalesce("source", F.lit(""))) if weights else F.lit(None).cast("double")
    # a null source is never a stated one
    weight = F.when(F.col("source").isNotNull(), weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("stated"),
                      F.sum(F.col("weight").isNull().cast("long")).alias("others"))
    of = lambda name: total.select(name).scalar()
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.coalesce(of("stated"), F.lit(0.0))) / F.nullif(of("others"), F.lit(0).cast("long"))
    asked = F.lit(float(budget)) if budget is not None else of("size").cast("double")
    rate = F.coalesce("weight", rest) * asked / F.col("size")
    return cut(sizes.select("source", rate.alias("rate")).mapInPandas(
        _with_quantiles, "source string, rate double, low long, below array<double>"))


def _copies(docs: DataFrame, weights: Mapping[str, float], budget: float | None, seed: int, id_col: str,
            source_col: str, text_col: str) -> DataFrame:
    """The copies of ``docs``, globally shuffled, with columns for count, copy and key of their own."""
    row, source, low, below, count, copy, key = (f"{OWN}{x}" for x in (
        "row", "source", "low", "below", "count", "copy", "key"))
    by_source = rates(docs, weights, budget, source_col, text_col).select(
        F.col("source").alias(source), F.col("low").alias(low), F.col("below").alias(below))
    if by_source.count() <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    joined = with_row(docs, row).join(by_source, F.col(source_col).cast("string").eqNullSafe(F.col(source)))
    # the number is made once a row: inside the inner lambda it would be hashed for every entry
    passed = F.transform(F.array(uniform(seed, id_col)), lambda u: F.size(F.filter(below, lambda c: c <= u)))
    counted = joined.withColumn(count, F.col(low) + F.element_at(passed, 1).cast("long")).where(F.col(count) > 0)
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    keyed = counted.select(*docs.columns, row, count, each.alias(copy)).withColumn(key, hashed(seed, id_col, copy))
    return keyed.repartition(F.xxhash64(key, row)).sortWithinPartitions(key)


def mix(docs: DataFrame, weights: Mapping[str, float], budget: float | None = None, seed: int = 7,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies of ``docs``, globally shuffled, with ``copies``, ``copy`` and ``shuffle_key`` (in
    place of columns with these names)."""
    new = {"copies": "count", "copy": "copy", "shuffle_key": "key"}
    copies = _copies(docs, weights, budget, seed, id_col, source_col, text_col)
    return copies.select(*[c for c in docs.columns if c not in new], *[F.col(f"{OWN}{x}").alias(name) for name, x in new.items()])


def mixed_documents(docs: DataFrame, weights: Mapping[str, float], budget: float | None = None, seed: int = 7,
                    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The copies of ``docs``, globally shuffled, with the columns of ``docs`` alone."""
    return _copies(docs, weights, budget, seed, id_col, source_col, text_col).select(*docs.columns)


def hashed(seed: int, *parts: str) -> Column:
    """52 hashed bits of the seed and the parts."""
    text = F.concat_ws("/", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
