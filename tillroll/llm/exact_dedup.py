"""Exact deduplication with a heavy-hitter split (built-in functions only).

1. Every row becomes a slim fact: row number, id, SHA-256 of the normalised text, length.  The
   facts are written once, so the texts are read once.
2. A frequent-items sketch (Spark's ``approx_top_k``, the Misra-Gries counters of DataSketches)
   lists every digest that holds more than about 1/6000 of the rows, and some that do not.
3. The listed digests are counted exactly; those with at least ``1 / share`` of the rows are
   heavy.  There are at most ``share`` of them, so their winners are broadcast, and their rows
   are decided on the map side, without a shuffle.
4. All other digests are grouped and joined by an ordinary shuffle of the slim facts.

Of equal texts, the row with the longest original text stays, then the one with the smallest id,
then the first row (rows that agree in both are told apart by their place in the files).

Defined cases: a null text counts as empty, and all empty or blank texts are equal; a null id
loses against any other id of the same length and is a row of its own like any other; repeated
rows are one group, of which one row stays; texts of any length are compared whole, by digest; an empty
table gives an empty result; columns other
than id and text are ignored by ``exact_dedup`` and passed on by ``drop_exact_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import OWN, ROW, cut, numbered, text_of
from tillroll.llm.url_filter import without_rows

#: Deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Counters of the sketch, and the number of digests that can be heavy at most.
TRACKED, SHARE = 8192, 1000


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(normalised(text), 256)


def facts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row number, id, digest and length of every row."""
    text = text_of(text_col)
    return numbered(docs).select(F.col(ROW).alias("_row"), F.col(id_col).alias("id"), text.alias("t")).select(
        "_row", "id", digest(F.col("t")).alias("digest"), F.char_length("t").cast("long").alias("n_chars"))


def _groups(facts: DataFrame) -> DataFrame:
    """Size and winner of every digest; copies are combined before the shuffle."""
    best = F.max(F.struct("n_chars", F.bitwise_not("id").alias("not_id"), F.bitwise_not("_row").alias("not_row")))
    return facts.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best"))


def heavy_winners(facts: DataFrame, tracked: int = TRACKED, share: int = SHARE) -> DataFrame:
    """Digests with at least ``1 / share`` of the rows (at most ``share`` of them), counted exactly."""
    sketch = facts.agg(F.expr(f"approx_top_k(digest, {share}, {tracked})").alias("top"),
                       F.count(F.lit(1)).alias("n_rows"))
    listed = sketch.select(F.explode("top").alias("hit"), "n_rows").select(F.col("hit.item").alias("digest"), "n_rows")
    listed = cut(listed.where("digest is not null"))
    exact = _groups(facts.join(F.broadcast(listed.select("digest")), "digest", "left_semi"))
    return exact.join(F.broadcast(listed), "digest").where(
        (F.col("group_size") > 1) & (F.col("group_size") * share >= F.col("n_rows"))).drop("n_rows")


def decided(facts: DataFrame, tracked: int = TRACKED, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """``facts`` with ``keep_id``, ``group_size`` and ``kept``; and the heavy winners."""
    heavy = cut(heavy_winners(facts, tracked, share))
    light = facts.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = _groups(light).where("group_size > 1")
    both = facts.join(F.broadcast(heavy), "digest").unionByName(light.join(groups, "digest", "left"))
    alone = F.col("group_size").isNull()
    return both.select(
        "_row", "id", "digest", "n_chars",
        F.when(alone, F.col("id")).otherwise(F.bitwise_not("best.not_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.not_row") == F.bitwise_not("_row"))).alias("kept")), heavy


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows, _ = decided(cut(facts_of(docs, id_col, text_col)))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept",
                       F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies with a heavy digest are removed before anything is shuffled; the others by a join with
    the numbers of the rows that go.
    """
    full = numbered(docs)  # read twice, with the same numbers
    rows, heavy = decided(cut(facts_of(full, id_col, text_col)))
    row, key, best = ROW, f"{OWN}digest", f"{OWN}not_row"
    gone = rows.where(~F.col("kept")).join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        F.col("_row").alias(row))
    stay = F.broadcast(heavy.select(F.col("digest").alias(key), F.col("best.not_row").alias(best)))
    full = full.withColumn(key, digest(text_of(text_col)))
    light = full.join(stay, key, "left").where(F.col(best).isNull() | (F.col(best) == F.bitwise_not(row)))
    return without_rows(light.select(*docs.columns, row), cut(gone), row).select(*docs.columns)
