"""State histories per key (plan changes of a customer): journeys, transitions,
state as of a date.

All of these avoid pairing every row of a key with every other row of the same
key: histories are reduced to one row per key (or per key and date) by
aggregation first -- partial aggregation runs before the shuffle, so a key that
holds a third of all rows costs one row per map task -- and only those reduced
rows are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.agg import ordered_concat
from .keys import surrogate_key


def journey(events: DataFrame, states: DataFrame, key: str, state: str, date: str,
            label: str, keys: Sequence[int] | None = None) -> DataFrame:
    """Each key's states in date order (key, label, date); ``keys`` limits the
    output to chosen keys, ``None`` keeps all."""
    e = events if keys is None else events.filter(F.col(key).isin(list(keys)))
    out = e.join(states, on=state, how="inner").select(key, label, date)
    return out.orderBy(key, date, label)


def journey_paths(events: DataFrame, states: DataFrame, key: str, state: str, date: str, label: str,
                  sep: str = " > ", chunk: int = 1000) -> DataFrame:
    """key, path, steps: each key's states in date order (then by name) as one text.

    In two levels, so no key's history is sorted or joined in one task: the events get
    consecutive numbers in (key, date, name) order (``surrogate_key``), the events of a key
    that share a stretch of ``chunk`` numbers become one text, and then these texts, a
    thousandth of the rows, one path.  A path must fit in one value (2 GB of text).
    """
    named = events.join(states, on=state, how="inner").select(key, date, label)
    numbered = surrogate_key(named, [key, date, label], "_at")
    parts = numbered.groupBy(key, F.call_function("div", F.col("_at"), F.lit(chunk)).alias("_chunk")).agg(
        ordered_concat(label, "_at", sep=sep).alias("_text"), F.count(label).alias("_steps"))
    return parts.groupBy(key).agg(ordered_concat("_text", "_chunk", sep=sep).alias("path"),
                                  F.sum("_steps").alias("steps"))


def first_dates(events: DataFrame, key: str, state: str, date: str,
                wanted: dict[str, object]) -> DataFrame:
    """One row per key with the first date of each wanted state
    (``{"trial_date": 0, "annual_date": 3}``); NULL when the key never had it."""
    aggs = [F.min(F.when(F.col(state) == F.lit(v), F.col(date))).alias(name)
            for name, v in wanted.items()]
    cond = F.col(state).isin(list(wanted.values()))
    return events.filter(cond).groupBy(key).agg(*aggs)


def moved_after(events: DataFrame, key: str, state: str, date: str, frm: object,
                to: Column | object, offset_days: int) -> DataFrame:
    """Rows (key, from_date, to_state, to_date) where the key was in ``frm`` on a
    date and in a ``to`` state exactly ``offset_days`` later.

    Both sides are reduced to distinct (key, state, date) first, then joined on
    (key, date + offset): an equi-join on two keys, so each from-row meets at most
    one row per target state and nothing is paired beyond that.
    """
    base = events.select(key, state, date).distinct()
    a = base.filter(F.col(state) == F.lit(frm)).select(F.col(key).alias("_k"), F.col(date).alias("from_date"))
    to_cond = to if isinstance(to, Column) else (F.col(state) == F.lit(to))
    b = base.filter(to_cond).select(F.col(key).alias("_k2"), F.col(state).alias("to_state"),
                                    F.col(date).alias("to_date"))
    joined = a.join(b, (F.col("_k") == F.col("_k2")) &
                    (F.col("to_date") == F.date_add(F.col("from_date"), offset_days)), "inner")
    return joined.select(F.col("_k").alias(key), "from_date", "to_state", "to_date")


def latest_as_of(events: DataFrame, key: str, date: str, at: str) -> DataFrame:
    """Every row of each key that sits on the key's latest date on or before ``at``
    (ties on that date are all kept).  The latest date is a per-key max
    (partial + final aggregate) joined back on (key, date)."""
    upto = events.filter(F.col(date) <= F.lit(at).cast("date"))
    latest = upto.groupBy(key).agg(F.max(date).alias("_latest"))
    j = upto.join(latest, [upto[key] == latest[key], upto[date] == latest["_latest"]], "inner")
    return j.drop(latest[key]).drop("_latest")


def moved_between(events: DataFrame, key: str, state: str, date: str, frm: object, to: object,
                  to_from: str, to_until: str) -> DataFrame:
    """Keys that were in ``frm`` before being in ``to``, with the ``to`` date in
    [to_from, to_until].

    Such a pair exists exactly when the key's earliest ``frm`` date is before its
    latest ``to`` date inside the window, so two per-key aggregates answer it
    without forming pairs.
    """
    lo = F.lit(to_from).cast("date")
    hi = F.lit(to_until).cast("date")
    rel = events.filter((F.col(state) == F.lit(frm)) |
                        ((F.col(state) == F.lit(to)) & F.col(date).between(lo, hi)))
    per_key = rel.groupBy(key).agg(
        F.min(F.when(F.col(state) == F.lit(frm), F.col(date))).alias("_first_from"),
        F.max(F.when(F.col(state) == F.lit(to), F.col(date))).alias("_last_to"))
    return per_key.filter(F.col("_first_from") < F.col("_last_to")).select(key)


# --- all pairs of a ``frm`` and a ``to`` row of one key, as a self-join on the key would form them

def _per_day(events: DataFrame, key: str, state: str, date: str, frm: Column, to: Column) -> DataFrame:
    """key, day (number), _f, _t: how many rows of each kind a key has on a day.  Keys and dates that
    are NULL meet nothing.  A key has at most as many rows as the calendar has days."""
    known = events.filter((frm | to) & F.col(key).isNotNull() & F.col(date).isNotNull())
    day = F.unix_date(F.col(date).cast("date")).cast("bigint")
    return known.groupBy(key, day.alias("_day")).agg(F.count(F.when(frm, 1)).alias("_f"), F.count(F.when(to, 1)).alias("_t"))


def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def pairs_before(events: DataFrame, key: str, state: str, date: str, frm: object, to: object,
                 to_from: str, to_until: str) -> DataFrame:
    """One row, pairs: how many pairs of a ``frm`` and a later ``to`` row keys have, with the ``to``
    date in [to_from, to_until].

    Prefix counts over the (key, day) histogram: every ``to`` row meets the number of earlier
    ``frm`` rows of its key, so no pair is formed and a hot key costs a row per day.
    """
    window = F.col(date).between(F.lit(to_from).cast("date"), F.lit(to_until).cast("date"))
    days = _per_day(events, key, state, date, F.col(state) == F.lit(frm), (F.col(state) == F.lit(to)) & window)
    earlier = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    met = days.withColumn("_before", F.coalesce(F.sum("_f").over(earlier), F.lit(0)))
    return met.agg(F.coalesce(F.sum(_exact("_before") * _exact("_t")), F.lit(0)).cast("bigint").alias("pairs"))


def pair_moments(events: DataFrame, key: str, state: str, date: str, frm: object, to: object) -> DataFrame:
    """One row, pairs and days: the number of (``frm``, ``to``) pairs over all keys, whatever their
    order, and the sum of their differences in days (decimal(38,0); NULL without pairs).

    In closed form per key: n1 rows and n2 rows make n1 * n2 pairs, whose differences sum to
    n1 * (sum of to days) - n2 * (sum of from days).
    """
    per_day = _per_day(events, key, state, date, F.col(state) == F.lit(frm), F.col(state) == F.lit(to))
    per_key = per_day.groupBy(key).agg(
        F.sum("_f").alias("n1"), F.sum(_exact("_f") * F.col("_day")).cast("decimal(19,0)").alias("s1"),
        F.sum("_t").alias("n2"), F.sum(_exact("_t") * F.col("_day")).cast("decimal(19,0)").alias("s2")).filter("n1 > 0 AND n2 > 0")
    return per_key.agg(F.coalesce(F.sum(_exact("n1") * _exact("n2")), F.lit(0)).cast("decimal(38,0)").alias("pairs"),
                       F.sum(_exact("n1") * F.col("s2") - _exact("n2") * F.col("s1")).cast("decimal(38,0)").alias("days"))


def _block_pairs(per_day: DataFrame, key: str, width: int, shift: int) -> DataFrame:
    """block, pairs, days: the pairs of ``per_day`` by floor((to - from + shift) / width).

    With from - shift = width * b + r, the block of a pair is floor((to - r) / width) - b.  So both
    sides are counted in blocks of ``width`` days, aligned for every remainder r that the key's from
    days have, and blocks are joined on (key, r): n1 * n2 pairs at a time.
    """
    day = F.col("_day")
    frm = per_day.filter("_f > 0").groupBy(
        key, F.pmod(day - shift, F.lit(width)).alias("_r"), F.floor((day - shift) / width).alias("_b")).agg(
        F.sum("_f").alias("n1"), F.sum(F.col("_f") * day).alias("s1"))
    asked = frm.select(key, "_r").distinct()
    to = per_day.filter("_t > 0").join(asked, key).groupBy(key, "_r", F.floor((day - F.col("_r")) / width).alias("_c")).agg(
        F.sum("_t").alias("n2"), F.sum(F.col("_t") * day).alias("s2"))
    return frm.join(to, [key, "_r"]).groupBy((F.col("_c") - F.col("_b")).alias("block")).agg(
        F.sum(_exact("n1") * _exact("n2")).cast("decimal(38,0)").alias("pairs"),
        F.sum(_exact("n1") * _exact("s2") - _exact("n2") * _exact("s1")).cast("decimal(38,0)").alias("days"))


def pair_periods(events: DataFrame, key: str, state: str, date: str, frm: object, to: object,
                 offset: int, width: int) -> DataFrame:
    """period, pairs, days: all (``frm``, ``to``) pairs by (days - 1) div ``width``, cut toward zero, where
    days = to - from - ``offset``; ``days`` is their sum.

    Periods above 0 are blocks of rounding down, those below 0 blocks of rounding up, and period 0 is one
    of each, less the pairs with days = 1, which both hold: as many as are not above 1 by
    rounding up, less those below 1 by rounding down.
    """
    per_day = _per_day(events, key, state, date, F.col(state) == F.lit(frm), F.col(state) == F.lit(to))
    shift = -offset - 1
    down, up = (_block_pairs(per_day, key, width, shift + s).select("block", "pairs", (F.col("days") - F.col("pairs") * offset)
                                                                    .cast("decimal(38,0)").alias("days")) for s in (0, width - 1))
    zero, pairs = F.lit(0).cast("bigint"), F.col("pairs")

    def row(block: Column, n: Column, days: Column) -> Column:
        return F.struct(block.cast("bigint").alias("block"), n.cast("decimal(38,0)").alias("pairs"), days.cast("decimal(38,0)").alias("days"))

    own = row(F.col("block"), pairs, F.col("days"))
    rows = down.select(F.when(F.col("block") >= 0, own).otherwise(row(zero, pairs, pairs)).alias("x")).unionByName(
        up.filter("block <= 0").select(F.explode(F.array(own, row(zero, -pairs, -pairs))).alias("x"))).select("x.*")
    return rows.groupBy(F.col("block").cast("bigint").alias("period")).agg(
        F.sum("pairs").cast("decimal(38,0)").alias("pairs"), F.sum("days").cast("decimal(38,0)").alias("days")).filter("pairs > 0")
