"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and one end id.  Full windows are cut off first, and the rest
of the document is cut into parts of ``PART`` ids at most: two or three large parts a window could
not be balanced.  The pieces are dealt evenly to groups by a hash of row and start.  In a group, a
full piece is a window of its own.  The parts are split into windows of near-equal length: every
part starts as a partial partition with one filled place, and the two partitions with the largest
imbalance are merged again and again, the fullest place of one with the emptiest of the other,
until one is left.  If a place exceeds the capacity, the group is split anew with one window more.

There are enough groups that each holds the parts of about ``GROUP`` documents and the tokens of
about ``GROUP_BYTES`` of text at most, so neither a hot document or source nor very long texts make a
large group.  The number of windows is at least the group's tokens divided by the capacity, and
what is missing to fill the last one spreads over all windows of the group.

Defined cases: a null or empty text is its end id alone; a null id stays null; repeated rows are
packed one by one; an empty table gives an empty result; columns besides id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tillroll.llm.support import small_batches
from tillroll.llm.workers import Recent, collector_off, kept

CAPACITY, END, PART = 2048, 1, 512
GROUP, GROUP_BYTES = 1024, 16 << 20
#: Code points of text that are turned into ids at a time, about.
TEXTS = 2_000_000
#: Units whose ids a worker process remembers; their number is bounded, the answers are the same without.
REMEMBERED = 700_000
#: Fixed value: the tokenizer's units between white space, for texts that ``PLAIN`` matches, in lower case.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
UNIT = re.compile(rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}0-9]+")
#: Texts that the tokenizer's normalisation only puts into lower case: ASCII and U+00C0 to U+00FF.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xc0-\xff]*")
ASCII_WORD, ODD = re.compile(r"[^\x20\x09-\x0D]+"), "\0"
#: Texts on which the units' ids must be the tokenizer's own, or texts are encoded whole: signs and digits alone
#: and in runs, capitals, contractions, Latin-1 letters, a long word, blanks of all kinds, special strings.
PROBES = ("The quick brown fox, it's here! Don't say 'WE'LL' they'd've", "1234 3.14 x2y \u00b2\u00bd", "a--b ... (c) [d]_e #f",
          "Stra\xdfe \xc0\xc9\xd7\xf7 na\xefve", "pneumono" * 12, " \t\n  two\r\n\x0b lines ", "<|endoftext|> <|startoftext|>x", "0 , a")
#: Sequence numbers: group, then the place in the group.
PLACES = 1 << 32
PIECE = "_row long, _known boolean, doc_id long, start long, length long, doc_tokens long, ids binary"
PLACED = "_known boolean, doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


class Units(Recent):
    """Token ids, as bytes, of the tokenizer's units; worked out once per unit and worker process.

    The tokenizer drops white space and encodes each unit by itself, so a text's ids are the ids of
    its units in a row.  Texts of ASCII and Latin-1 letters and signs are cut into units here (see
    ``UNIT``), and the units not met before go to the tokenizer's model, their characters spelled as
    its bytes are.  A word with any other character is a unit of its own, encoded as a text.  A
    tokenizer that treats ``PROBES`` in another way gets whole texts instead.
    """

    def __init__(self, path: str) -> None:
        super().__init__(REMEMBERED)
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spelled = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {at: spelled(chr(at))[0][0] for at in range(0xc0, 0x100)}
        self.by_unit = True
        self.by_unit = all(self.ids([x])[0] == self.encode(x).tobytes() for x in PROBES)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def encoded(self, units: set[str]) -> Iterator[tuple[str, bytes]]:
        """Each unit with its ids."""
        plain = [unit for unit in units if unit[0] != ODD]
        ids, ends = array("I"), array("q", [0])
        for unit in plain:
            ids.extend([token.id for token in self.model.tokenize(unit if unit.isascii() else unit.translate(self.spelling))])
            ends.append(4 * len(ids))
        data = np.frombuffer(ids, dtype=np.uint32).astype("<u4").tobytes()
        yield from zip(plain, (data[i:j] for i, j in zip(ends, ends[1:])))
        yield from ((unit, self.encode(unit[1:]).tobytes()) for unit in units if unit[0] == ODD)

    def learn(self, units: set[str]) -> None:
        fresh = self.unknown(units)
        if fresh:
            self.update(self.encoded(fresh))

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        if not self.by_unit:
            return [self.encode(text or "").tobytes() for text in texts]
        found = [units_of(text or "") for text in texts]
        # one look at every unit, a second one only at those that were missing
        known = [list(map(self.get, units)) for units in found]
        gaps = [[at for at, ids in enumerate(one) if ids is None] for one in known]
        self.learn({units[at] for units, missing in zip(found, gaps) for at in missing})
        for units, one, missing in zip(found, known, gaps):
            for at in missing:
                one[at] = self[units[at]]
        return [b"".join(one) for one in known]


def units_of(text: str) -> list[str]:
    """The tokenizer's units of a text; words that it may treat in another way are marked as odd."""
    if PLAIN.fullmatch(text) and "<|" not in text:
        return UNIT.findall(text.lower())
    units: list[str] = []
    for word in ASCII_WORD.findall(text):
        units.extend(UNIT.findall(word.lower()) if PLAIN.fullmatch(word) and "<|" not in word else [ODD + word])
    return units


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, part_size: int = PART,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids in pieces: ``PIECE`` columns (id 0 where null)."""
    closing = np.array([end], dtype="<u4").tobytes()
    most = 4 * capacity
    names = ["_row", "_known", "doc_id", "start", "length", "doc_tokens", "ids"]

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = kept(("units", tokenizer), lambda: Units(tokenizer))
        for batch in batches:
            # a few texts at a time: ids are larger than text
            sizes = batch["t"].str.len().fillna(0).cumsum()
            for _, part in batch.groupby((sizes // TEXTS).astype("int64")):
                rows = []
                with collector_off():
                    ids = units.ids(part["t"])
                for row, known, doc, data in zip(part["_row"], part["_known"], part["doc_id"], ids):
                    data += closing
                    whole = len(data) // most * most  # full windows, then smaller pieces
                    cuts = [*range(0, whole, most), *range(whole, len(data), 4 * part_size)]
                    rows += [(row, known, doc, i // 4, (j - i) // 4, len(data) // 4, data[i:j])
                             for i, j in zip(cuts, [*cuts[1:], len(data)])]
                yield pd.DataFrame(rows, columns=names)

    known = F.col(id_col).isNotNull()
    slim = docs.select(F.monotonically_increasing_id().alias("_row"), known.alias("_known"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("doc_id"),
                       F.col(text_col).alias("t"))
    return slim.mapInPandas(cut_up, PIECE)


def differencing(lengths: list[int], windows: int) -> np.ndarray:
    """The window, from 0, of each length: Karmarkar-Karp's multiway differencing.

    A partial partition is its part sums, fullest first, and each part's contents: -1 for nothing,
    an item, or the number of a union of two earlier contents.
    """
    heap: list = []
    for i, n in enumerate(lengths):
        sums, parts = np.zeros(windows, dtype=np.int64), np.full(windows, -1, dtype=np.int64)
        sums[0], parts[0] = n, i
        heap.append((-int(n) if windows > 1 else 0, i, sums, parts))
    heapq.heapify(heap)
    unions: list[tuple[int, np.ndarray, np.ndarray]] = []
    fresh = len(lengths)
    while len(heap) > 1:
        _, i, sums, parts = heapq.heappop(heap)
        _, j, other, theirs = heapq.heappop(heap)
        merged, theirs = sums + other[::-1], theirs[::-1]  # fullest with emptiest
        both = np.flatnonzero((parts >= 0) & (theirs >= 0))
        joined = np.maximum(parts, theirs)
        joined[both] = np.arange(fresh, fresh + len(both))
        unions.append((fresh, parts[both], theirs[both]))
        fresh += len(both)
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        heapq.heappush(heap, (int(merged[-1] - merged[0]), min(i, j), merged, joined[order]))
    window = np.full(fresh, -1, dtype=np.int64)
    if heap:
        last = heap[0][3]
        window[last[last >= 0]] = np.flatnonzero(last >= 0)
    for first, left, right in reversed(unions):
        window[left] = window[right] = window[first:first + len(left)]
    return window[:len(lengths)]


def windows_of(lengths: list[int], capacity: int = CAPACITY) -> np.ndarray:
    """``differencing`` with the least possible number of windows, or, while one exceeds the capacity, with
    as many more as the excess over the mean asks for."""
    total = sum(lengths)
    n = max(1, -(-total // capacity))
    while True:
        found = differencing(lengths, n)
        fullest = int(np.bincount(found, weights=lengths).max()) if len(found) else 0
        if fullest <= capacity:
            return found
        room = capacity - (fullest - total // n)
        n = max(n + 1, min(-(-total // room), n + n // 64) if room > 0 else 0)


def place(batch: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequence and offset of one group's pieces."""
    batch = batch.sort_values(["length", "doc_id", "start", "_row"], ascending=[False, True, True, True], kind="stable")
    lengths = batch["length"].to_numpy()
    full = int((lengths >= capacity).sum())
    window = np.concatenate([np.arange(full), full + windows_of(lengths[full:].tolist(), capacity)])
    batch = batch.assign(sequence_id=batch["_group"].to_numpy(dtype=np.int64) * PLACES + window.astype(np.int64))
    batch["offset"] = batch.groupby("sequence_id")["length"].cumsum() - batch["length"]
    return batch[["_known", "doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, part_size: int = PART,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset.

    ``ids`` are little-endian unsigned 32-bit ids.  A sequence is the pieces with its number in the
    order of ``offset``.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    small_batches(docs.sparkSession)
    groups = max(1, size["rows"] // GROUP, (size["bytes"] or 0) // GROUP_BYTES)
    placed = (pieces(docs, tokenizer, capacity, end, part_size, id_col, text_col)
              .withColumn("_group", F.pmod(F.xxhash64("_row", "start"), F.lit(groups)))
              .groupBy("_group").applyInPandas(lambda batch: place(batch, capacity), PLACED))
    return placed.select(F.when(F.col("_known"), F.col("doc_id")).alias(id_col), "start", "length", "doc_tokens",
                         "ids", "sequence_id", "offset")
