"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

1. A document's set is its distinct shingles of ``words`` words (A-Z in lower case, split at ASCII
   white space), as 64-bit hashes.  Equal sets form one class; only one row of a class goes on.
2. The sketch has ``bands * rows`` coordinates.  In round i every element is hashed to a bin and a
   value, and a bin keeps the smallest (round, value).  The first t rounds choose bins at random;
   round t + j puts all elements into bin j, so every coordinate fills, whatever the set's size.
   Rounds stop when all bins are filled: about t log t hashes beyond one pass over the set, and
   the share of equal coordinates is concentrated around the Jaccard similarity.
3. Classes that agree in all coordinates of a band share a bucket.  Each member is compared with
   its bucket's smallest member, on the full sets, and links of enough similarity give components.
4. Buckets whose members all lie in one component need nothing more.  All members of the others are
   joined by an exact set-similarity join (rare elements first, prefix and position filters) that
   looks for links between different components only, so no link of a shared bucket is missed and
   no group of copies is paired with itself.

At a similarity of 0.8, two sets share a bucket with a probability of 0.99994 by default.

Hot groups: exact copies are combined before the shuffle; a bucket is never gathered, its smallest
member comes from a partial aggregate, and the joins back are ones whose skew Spark splits.

Defined cases: null and blank texts have an empty set, link with nothing and stay; a text with
fewer words than a shingle is one shingle; a null id never names a component that has another id;
repeated rows are exact copies (all rows with the component's id are ``kept``;
``drop_near_copies`` keeps one row); texts of any length are read whole; an empty table gives an empty
result; other columns, of whatever name, are ignored, and passed on by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.components import components, named
from tillroll.llm.support import ROW, cut, numbered, small_batches
from tillroll.llm.url_filter import BROADCAST_BLOCKS, blocks_for, possible, without_rows

WORDS, BANDS, ROWS = 5, 32, 6
#: The least Jaccard similarity of a link: ``OF * intersection >= LEAST * union``, in whole numbers.
LEAST, OF = 80, 100
#: Elements listed as frequent in the exact join, and counters of the sketch that finds them.
FREQUENT, TRACKED = 8192, 65536
#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Rows that Python gets at a time: texts, or pairs with two sets each.
BATCH = 250

U = np.uint64
#: Fixed values of the SplitMix64 generator: its increment, and shifts and factors of its mixing.
STEP, MIX = U(0x9E3779B97F4A7C15), ((U(30), U(0xBF58476D1CE4E5B9)), (U(27), U(0x94D049BB133111EB)))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's mixing of 64-bit numbers."""
    for shift, factor in MIX:
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> U(31))


class WordHashes(dict):
    """64-bit hashes of words, worked out once per word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    total = np.full(n, U(k))
    for i in range(k):
        total = mixed(total + STEP) + each[i:i + n]
    return np.unique(mixed(total))


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of t coordinates of a set that is not empty."""
    low, half = U(0xFFFFFFFF), U(32)
    found = np.full(t, U(0xFFFFFFFFFFFFFFFF))
    start = 0
    while start < 2 * t:
        n = min(2 * t - start, max(1, 4 * t // len(elements)))  # several rounds at once for small sets
        rounds = np.arange(start, start + n, dtype=np.uint64)[:, None]
        hashed = mixed(elements[None, :] + mixed(rounds * STEP + U(1)))
        bins = np.where(rounds < U(t), ((hashed >> half) * U(t)) >> half, rounds - U(t))
        np.minimum.at(found, bins.ravel().astype(np.int64), ((rounds << half) | (hashed & low)).ravel())
        if found.max() != U(0xFFFFFFFFFFFFFFFF):
            break
        start += n
    return found


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band."""
    total = np.arange(1, bands + 1, dtype=np.uint64) * STEP
    for column in coordinates.reshape(bands, rows).T:
        total = mixed(total + column) + STEP
    return mixed(total).view(np.int64)


def sketched(docs: DataFrame, words: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """_row, id, n_shingles, set_key (null for the empty set), keys; ``docs`` is numbered."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["t"]:
                own = shingles(text, words, hashes)
                out.append((len(own), None, None) if not len(own) else
                           (len(own), xxhash.xxh3_128_hexdigest(own.tobytes()), band_keys(sketch(own, bands * rows), bands, rows)))
            yield pd.DataFrame({"_row": batch["_row"], "id": batch["id"], "n_shingles": [x[0] for x in out],
                                "set_key": [x[1] for x in out], "keys": [x[2] for x in out]})

    slim = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"), F.col(ROW).alias("_row"))
    done = slim.mapInPandas(work, "id string, _row long, n_shingles long, set_key string, keys array<long>")
    return done.withColumn("id", F.col("id").cast("long"))


def sets_of(docs: DataFrame, rows: DataFrame, words: int, text_col: str) -> DataFrame:
    """``rows`` (with _row) and ``own``, the set of the row's text in the numbered ``docs``; only their texts
    become sets."""
    kept = rows.columns

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            own = [shingles(x, words, hashes).view(np.int64) for x in batch["t"]]
            yield batch[kept].assign(own=pd.Series(own, index=batch.index, dtype=object))

    texts = docs.select(F.col(text_col).alias("t"), F.col(ROW).alias("key"))
    wanted = cut(rows)
    if blocks_for(wanted.count()) <= BROADCAST_BLOCKS:  # most texts need not travel to the exact join
        texts = possible(texts, wanted.select(F.col("_row").alias("key")))
    joined = texts.join(wanted, F.col("key") == F.col("_row")).select(*kept, "t")
    return joined.mapInPandas(work, T.StructType([*rows.schema.fields, T.StructField("own", T.ArrayType(T.LongType()))]))


def similar(pairs: DataFrame, least: int, of: int) -> DataFrame:
    """The pairs (a, b) whose sets (set_a, set_b) are similar enough."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                n, m, shared = len(x), len(y), 0
                if of * min(n, m) >= least * max(n, m):
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                keep.append(of * shared >= least * (n + m - shared))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(work, "a long, b long")


def shortened(sets: DataFrame) -> DataFrame:
    """_row and ``short``: 16 bits of each element, a quarter of the set's bytes."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            short = [((x & 0xFFFF) - 0x8000).astype(np.int16) for x in batch["own"]]
            yield batch[["_row"]].assign(short=pd.Series(short, index=batch.index, dtype=object))

    return sets.select("_row", "own").mapInPandas(work, "_row long, short array<smallint>")


def maybe_similar(pairs: DataFrame, least: int, of: int) -> DataFrame:
    """The pairs (a, b) that can be similar enough by their short sets (short_a, short_b).

    Common elements have common short forms, so short forms in common, counted with their repeats, are
    no fewer than common elements: no link is lost.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["short_a"], batch["short_b"]):
                (u, n), (v, m) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
                _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
                most = int(np.minimum(n[i], m[j]).sum())
                keep.append(of * most >= least * (len(x) + len(y) - most))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(work, "a long, b long")


def star_links(docs: DataFrame, stars: DataFrame, words: int, text_col: str, least: int, of: int) -> DataFrame:
    """The pairs (a, b of row numbers) of ``stars`` that are similar enough; b's set travels to a."""
    partners = stars.groupBy(F.col("b").alias("_row")).agg(F.collect_set("a").alias("partners"))  # one per band at most
    centres = stars.select(F.col("a").alias("_row"), F.array().cast("array<bigint>").alias("partners")).distinct()
    sets = sets_of(docs, partners.unionByName(centres), words, text_col)
    sets_b = sets.select(F.col("_row").alias("b"), F.explode("partners").alias("a"), F.col("own").alias("set_b"))
    sets_a = sets.where(F.size("partners") == 0).select(F.col("_row").alias("a"), F.col("own").alias("set_a"))
    return similar(sets_b.join(sets_a, "a"), least, of)


def cross_links(docs: DataFrame, nodes: DataFrame, words: int, text_col: str, least: int, of: int) -> DataFrame:
    """All links (a, b, root_a, root_b) between ``nodes`` (_row, root, weight) of different roots, by an exact
    prefix join.

    A set's elements are ordered from rare to frequent.  Two sets that are similar enough share one of
    their first ``n - ceil(least * n / of) + 1`` elements, and at the first one that they share, enough
    elements are left on both sides.  Only sets outside the heaviest component of an element's holders
    look for partners there, so the members of one large group are never paired with each other.
    """
    sets = cut(sets_of(docs, nodes, words, text_col))
    # frequent elements (a bounded list); any order gives the same links, a good one fewer candidates
    top = sets.select(F.explode("own").alias("x")).agg(F.expr(f"approx_top_k(x, {FREQUENT}, {TRACKED})").alias("top"))
    often = sorted((hit["item"], hit["count"]) for hit in (top.first()["top"] or []))
    items, counts = (np.array(x, dtype=np.int64) for x in (zip(*often) if often else ((), ())))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own in batch["own"]:
                at = np.minimum(np.searchsorted(items, own), max(0, len(items) - 1))
                known = np.where(items[at] == own, counts[at], 0) if len(items) else np.zeros(len(own), dtype=np.int64)
                n = len(own)
                out.append(own[np.lexsort((own, known))[:n - -(-least * n // of) + 1]])
            yield batch[["_row", "root", "weight"]].assign(
                n=batch["own"].map(len), items=pd.Series(out, index=batch.index, dtype=object))

    first = sets.mapInPandas(prefixes, "_row long, root long, weight long, n long, items array<long>")
    rows = first.select("_row", "root", "weight", "n", F.posexplode("items").alias("at", "x"))
    holders = rows.groupBy("x").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                    F.max(F.struct("weight", "root")).alias("heaviest")).where("lo <> hi")
    shared = cut(rows.join(holders.select("x", F.col("heaviest.root").alias("main")), "x"))
    seeking = shared.where("root <> main")
    other = shared.select("x", *[F.col(c).alias(f"{c}_2") for c in ("_row", "root", "n", "at")])
    both = F.col("n") + F.col("n_2")
    left = F.least(F.col("n") - F.col("at"), F.col("n_2") - F.col("at_2"))
    near = ((F.col("root") != F.col("root_2")) & (left * (least + of) >= both * least)
            & (F.least("n", "n_2") * of >= F.greatest("n", "n_2") * least))
    pairs = (seeking.join(other, "x").where(near)
             .groupBy(F.least("_row", "_row_2").alias("a"), F.greatest("_row", "_row_2").alias("b"))
             .agg(F.count(F.lit(1)).alias("n")).drop("n"))
    one = sets.select(F.col("_row").alias("b"), F.col("own").alias("set_b"))
    two = sets.select(F.col("_row").alias("a"), F.col("own").alias("set_a"))
    # few of these pairs are links: their short sets travel first
    short = shortened(sets)
    likely = maybe_similar(pairs.join(short.select(F.col("_row").alias("b"), F.col("short").alias("short_b")), "b")
                           .join(short.select(F.col("_row").alias("a"), F.col("short").alias("short_a")), "a"), least, of)
    found = similar(cut(likely).join(one, "b").join(two, "a"), least, of)
    roots = [nodes.select(F.col("_row").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    return found.join(roots[0], "a").join(roots[1], "b")


def near_groups(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, least: int = LEAST,
                of: int = OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_row, id, n_shingles, component_id, keep_row (the row that stays) for every row of ``docs``."""
    small_batches(docs.sparkSession, BATCH)
    docs = numbered(docs)  # read again for the sets, with the same numbers
    facts = cut(sketched(docs, words, bands, rows, id_col, text_col))
    classes = facts.where("set_key IS NOT NULL").groupBy("set_key").agg(
        F.min(F.struct("_row", "keys")).alias("first"))
    classes = cut(classes.select("set_key", "first.*").withColumnRenamed("_row", "node"))
    buckets = classes.select("node", F.posexplode("keys").alias("band", "key")).select(
        "node", F.xxhash64("band", "key").alias("key"))
    shared = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a")).where("n > 1").drop("n")
    members = cut(buckets.join(shared, "key").select("key", "node", "a"))
    stars = members.where("node <> a").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("n")).drop("n")
    links = cut(star_links(docs, stars, words, text_col, least, of))
    roots = cut(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    # members of buckets that hold more than one component so far
    placed = members.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select(
        "key", "node", F.coalesce("root", "node").alias("root"))
    mixed_keys = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    weights = roots.groupBy("root").agg(F.count(F.lit(1)).alias("weight"))
    open_nodes = (placed.join(mixed_keys, "key", "left_semi").select(F.col("node").alias("_row"), "root").distinct()
                  .join(weights, "root", "left").select("_row", "root", F.coalesce("weight", F.lit(1).cast("long")).alias("weight")))
    more = cut(cross_links(docs, cut(open_nodes), words, text_col, least, of))
    # the new links join components: from root to root
    merged = components(more.select(F.col("root_a").alias("u"), F.col("root_b").alias("v"))).select(
        F.col("node").alias("old"), F.col("root").alias("new"))
    first_root = classes.select("set_key", "node").join(roots, "node", "left").select(
        "set_key", F.coalesce("root", "node").alias("old"))
    by_class = first_root.join(merged, "old", "left").select("set_key", F.coalesce("new", "old").alias("root"))
    rooted = cut(facts.select("_row", "id", "n_shingles", "set_key").join(by_class, "set_key", "left")
                 .withColumn("root", F.coalesce("root", "_row")))
    return named(rooted).select("_row", "id", "n_shingles", "component_id", "keep_row")


def minhash_dedup(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                  **settings: int) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept."""
    found = near_groups(docs, words, id_col=id_col, text_col=text_col, **settings)
    return found.select(F.col("id").alias(id_col), "n_shingles", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
                     **settings: int) -> DataFrame:
    """The rows of ``docs`` of which one per group stays, with all their columns."""
    full = numbered(docs)
    found = near_groups(full, words, id_col=id_col, text_col=text_col, **settings)
    gone = found.where("_row <> keep_row").select(F.col("_row").alias(ROW))
    return without_rows(full, cut(gone), ROW).select(*docs.columns)
