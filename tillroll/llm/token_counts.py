"""Token counts by a two-tier lookup of pre-token lengths on the map side.

The tokenizer drops white space and encodes each pre-token (unit) by itself, so a text's count is
the sum of its units' lengths in tokens.

1. Frequent units: every task keeps Misra-Gries counters over the units of all its texts (at most
   ``TRACKED`` survive a trim) and gives away those that hold ``1 / TRACKED`` of its units or more.  Counters
   are summed over tasks, and the ``TRACKED`` largest make the first tier: a compact table of unit lengths.
   It is broadcast; units over ``LONGEST`` characters stay out, so it has at most
   ``TRACKED * LONGEST`` characters, whatever the corpus.
2. Other units are looked up in the worker's own cache, which lives as long as the worker process
   and is bounded (``workers.Recent``); those that are new to it are encoded there, many at a time.

No unit is shuffled: only counters leave a task, at most ``TRACKED`` of them.  Which units are in which
tier changes the speed alone; every length comes from the tokenizer.

A tokenizer for which counting by units is not proven right (``packing.PROBES``), and any
sentencepiece model, gets whole texts instead.

Defined cases: a null or empty text has 0 bytes and 0 tokens; texts of any length are counted
whole, a bounded number of code points at a time; strings of special tokens count as the library
counts them; ids are passed on as they are, null and repeated ones too, one row per row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.packing import TEXTS, Units, units_of
from tillroll.llm.support import small_batches
from tillroll.llm.workers import Recent, kept

LIMIT = 2048
#: Counters of a task, entries of the broadcast table, and the longest unit in it.
TRACKED, LONGEST = 32_768, 64
#: Lengths that a worker remembers besides the table.
REMEMBERED = 700_000
#: The table: its units between line feeds, which no unit holds, and their lengths (unsigned 16 bits).
Table = tuple[str, bytes]


def trimmed(counts: Counter, most: int) -> tuple[Counter, int]:
    """Misra-Gries: all counters are lowered until ``most`` are left; also by how much."""
    if len(counts) <= most:
        return counts, 0
    lower = sorted(counts.values(), reverse=True)[most]
    return Counter({unit: n - lower for unit, n in counts.items() if n > lower}), lower


def frequent_units(docs: DataFrame, tracked: int = TRACKED, text_col: str = "text") -> DataFrame:
    """unit and n: all units that hold ``1 / tracked`` of a task's units, and a lower bound of their number."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        total = lowered = 0
        for batch in batches:
            for text in batch["t"]:
                units = units_of(text or "")
                total += len(units)
                counts.update(units)
                if len(counts) > 8 * tracked:
                    counts, lower = trimmed(counts, tracked)
                    lowered += lower
        counts, lower = trimmed(counts, tracked)
        lowered += lower  # what a counter may lack
        held = [(unit, n) for unit, n in counts.items() if (n + lowered) * tracked >= total and len(unit) <= LONGEST]
        yield pd.DataFrame(held, columns=["unit", "n"])

    counted = docs.select(F.col(text_col).alias("t")).mapInPandas(work, "unit string, n long")
    return counted.groupBy("unit").agg(F.sum("n").alias("n"))


def frequent_lengths(docs: DataFrame, tokenizer: str, tracked: int = TRACKED, text_col: str = "text") -> Table:
    """The first tier; at most ``tracked`` units of ``LONGEST`` characters."""
    most = frequent_units(docs, tracked, text_col).orderBy(F.desc("n"), "unit").limit(tracked)
    known = dict(Units(tokenizer).encoded({row["unit"] for row in most.select("unit").collect()}))
    return "\n".join(known), array("H", (len(ids) // 4 for ids in known.values())).tobytes()


class Lengths(dict):
    """The two tiers: a broadcast table, and for what it lacks this worker's own memory."""

    def __init__(self, tokenizer: str, table: Table) -> None:
        names, lengths = table
        super().__init__(zip(names.split("\n"), array("H", lengths)) if lengths else ())
        self.units, self.rest = Units(tokenizer), Recent(REMEMBERED)

    def __missing__(self, unit: str) -> int:
        return self.rest[unit]

    def counts(self, texts: Iterable[str | None]) -> list[int]:
        found = [units_of(text or "") for text in texts]
        fresh = self.rest.unknown(set(filterfalse(self.__contains__, set().union(*found))))
        if fresh:
            self.rest.update((unit, len(ids) // 4) for unit, ids in self.units.encoded(fresh))
        return [sum(map(self.__getitem__, units)) for units in found]


def whole_text_counter(tokenizer: str) -> Callable[[Iterable[str | None]], list[int]]:
    """Counts by encoding every text as a whole, with the library for the file's kind."""
    if tokenizer.endswith(".model"):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=tokenizer)
        return lambda texts: [len(model.encode(text or "")) for text in texts]
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(whole.encode(text or "", add_special_tokens=False).ids) for text in texts]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT, tracked: int = TRACKED, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    by_unit = tokenizer.endswith(".json") and Units(tokenizer).by_unit
    table = frequent_lengths(docs, tokenizer, tracked, text_col) if by_unit else ("", b"")
    version = hashlib.sha256(table[0].encode("utf-8", "surrogatepass") + table[1]).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if by_unit:
            count = kept(("lengths", tokenizer), lambda: Lengths(tokenizer, shared.value), version).counts
        else:
            count = kept(("whole", tokenizer), lambda: whole_text_counter(tokenizer))
        for batch in batches:
            # a few texts at a time: units are larger than text
            sizes = batch.str.len().fillna(0).cumsum()
            parts = [count(part) for _, part in batch.groupby((sizes // TEXTS).astype("int64"))]
            yield pd.Series([n for part in parts for n in part], dtype="int64")

    return docs.select(F.col(id_col), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       counted(F.col(text_col).cast("string")).alias("n_tokens")
                       ).withColumn("over_limit", F.col("n_tokens") > limit)
