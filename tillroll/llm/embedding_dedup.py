"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors form one class; only one of a class goes on.
2. In each pass the classes are ordered by ``PLANES`` concatenated random hashes (the sides of
   random hyperplanes, the first hash first).  Similar vectors agree in the first hashes with a
   high probability and so stand near each other.
3. A vector is compared with its neighbours in the order: with at least ``WINDOW`` on either side.
   Stretches of ``STRETCH`` vectors, and the first ``WINDOW`` of the next stretch, are compared
   block by block; each gives a forest of its verified links, so what leaves it is no larger than
   the stretch.  The forests of all passes are united to components.
4. Links are counted exactly inside each component: its members are dealt to chunks by a hash, and
   every pair of chunks is compared.  A group of near copies that is larger than any window loses
   no link; counts leave the chunks, not pairs.

The number of passes follows from the crowding that is measured.  A pair at the threshold meets for
certain if the two agree in more leading hashes than a vector shares with the one ``WINDOW`` places away;
so every pass gives each vector a chance, and passes go on for the vectors whose chances do not yet add up
to ``RECALL``.  Where vectors crowd so much that the passes still wanted would compare more pairs than
there are, those left are compared block by block, which is exact.  Only a pair at the threshold has as little as
``RECALL`` for its chance, and it is lost only if no chain of other links joins it.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, link
with nothing; vectors of different length are never linked; a null id never names a component that
has another id; repeated rows are equal vectors and link with each other; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.llm.components import components, named
from tillroll.llm.support import ROW, cut, numbered

THRESHOLD, RECALL, SEED = 0.95, 0.999, 11
PLANES, WINDOW, STRETCH, CHUNK = 62, 1024, 8192, 1024
#: Members of small components that share a group, on average at most.
SHARED = 4096


def passes(n: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes of the first round: what spread-out vectors need, and a little more.

    Two vectors at the threshold agree in one hash with probability ``1 - angle / pi``; to be near each
    other among n vectors they must agree in about log2(n / window) hashes.
    """
    if n <= window:
        return 1
    agree = agreement(threshold) ** (math.log2(n / window) + 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - agree))


def agreement(threshold: float) -> float:
    """The probability that two vectors at the threshold are on one side of a random hyperplane."""
    return 1 - math.acos(threshold) / math.pi


def shared_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading hashes that two keys share."""
    differ = a ^ b
    for step in (1, 2, 4, 8, 16, 32):
        differ |= differ >> step
    return PLANES - np.bitwise_count(differ).astype(np.int64)


def chances(keys: np.ndarray, threshold: float, window: int) -> np.ndarray:
    """For keys in order, minus the logarithm of the probability that a pair at the threshold is missed in this pass."""
    ahead = np.full(len(keys), -1)
    if len(keys) > window:
        ahead[:-window] = shared_hashes(keys[:-window], keys[window:])
    behind = np.concatenate([np.full(min(window, len(keys)), -1), ahead[:-window]])
    agree = agreement(threshold) ** (np.maximum(ahead, behind) + 1)
    return -np.log1p(-np.minimum(agree, 1 - 1e-12))


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1, in double precision."""
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # tiny and huge vectors keep their direction
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def projections(vectors: DataFrame, n_passes: int, seed: int) -> DataFrame:
    """node, pass and key (the concatenated hashes as one number) of every vector and pass."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        place = np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for size, part in batch.groupby(batch["vec"].map(len)):
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size, n_passes * PLANES))
                for at in range(0, len(part), 1000):
                    some = part.iloc[at:at + 1000]
                    sides = (unit_rows(some["vec"]) @ planes[size] > 0).reshape(len(some), n_passes, PLANES)
                    keys = (sides.astype(np.int64) << place).sum(axis=2)
                    yield pd.DataFrame({"node": np.repeat(some["node"].to_numpy(), n_passes),
                                        "pass": np.tile(np.arange(n_passes), len(some)), "key": keys.ravel()})

    return vectors.select("node", "vec").mapInPandas(work, "node long, pass int, key long")


def ranked(keys: DataFrame, n: int) -> DataFrame:
    """node, pass, rank (from 0) in the order of each pass, and key; every pass has n nodes."""
    ordered = (keys.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
               .select("node", "pass", "key", F.spark_partition_id().alias("part"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    ordered = cut(ordered)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over a row per partition
    starts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    return ordered.join(starts, "part").select(
        "node", "pass", (F.col("start") + F.col("at") - F.col("pass") * F.lit(n)).alias("rank"), "key")


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each row's label, the first row of its component, after the links (i, j)."""
    i, j = label[i], label[j]
    differ = i != j
    i, j = i[differ], j[differ]
    while len(i):
        was = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        label = label[label]
        if (label == was).all():
            break
    return label


def forest(vectors: np.ndarray, threshold: float, window: int, stretch: int) -> np.ndarray:
    """For each row the first row of its component, by verified links inside the windows."""
    label = np.arange(len(vectors))
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, min(stretch, len(vectors)), window):
        near = vectors[at:at + window] @ vectors[at:at + 2 * window].T >= threshold
        i, j = np.nonzero(near)
        i, j = i[i < j] + at, j[i < j] + at
        if len(i):
            ends.append((i, j))
    if not ends:
        return label
    return united(label, *(np.concatenate(x) for x in zip(*ends)))


def neighbours(placed: DataFrame, threshold: float, window: int, stretch: int) -> DataFrame:
    """Links (u, v): a forest of the verified links of every stretch of every pass; and u and its chance in each pass."""
    def work(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("rank")
        ranks = batch["rank"].to_numpy()
        own = ranks // stretch == batch["stretch"].iloc[0]
        met = chances(batch["key"].to_numpy(), threshold, window)
        out = [pd.DataFrame({"u": batch["node"].to_numpy()[own], "v": None, "chance": met[own]})]
        for _, part in batch.groupby(batch["vec"].map(len)):
            nodes = part["node"].to_numpy()
            first = forest(unit_rows(part["vec"]), threshold, window, stretch)
            linked = first != np.arange(len(nodes))
            out.append(pd.DataFrame({"u": nodes[linked], "v": pd.Series(nodes[first[linked]], dtype="Int64"), "chance": None}))
        return pd.concat([x.astype({"u": "int64", "v": "Int64", "chance": "float64"}) for x in out])

    # a stretch, and the first window of the next one; in front of a pass there is nothing
    own = F.col("place.rank").cast("long")
    stretches = F.array_distinct(F.array(F.floor(own / stretch), F.greatest(F.lit(0).cast("long"), F.floor((own - window) / stretch))))
    rows = placed.select("node", "vec", F.explode("places").alias("place")).select(
        "node", "vec", F.col("place.pass").alias("pass"), own.alias("rank"), F.col("place.key").alias("key"),
        F.explode(stretches).alias("stretch"))
    return rows.groupBy("pass", "stretch").applyInPandas(work, "u long, v long, chance double")


def in_blocks(vectors: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """Links (u, v): forests of all links between the vectors, which are compared block by block."""
    def work(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        lo, hi = batch["lo"].iloc[0], batch["hi"].iloc[0]
        for _, part in batch.groupby(batch["vec"].map(len)):
            x, nodes, side = unit_rows(part["vec"]), part["node"].to_numpy(), part["side"].to_numpy()
            rows, columns = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            label = np.arange(len(x))
            for at in range(0, len(rows), 256):
                some = rows[at:at + 256]
                i, j = np.nonzero(x[some] @ x[columns].T >= threshold)
                label = united(label, some[i], columns[j])
            linked = label != np.arange(len(x))
            out.append(pd.DataFrame({"u": nodes[linked], "v": nodes[label[linked]]}))
        return pd.concat(out)

    blocks = -(-n // block)
    dealt = vectors.withColumn("side", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumns(
        {"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    return pairs.groupBy("lo", "hi").applyInPandas(work, "u long, v long")


def verified_links(vectors: DataFrame, n: int, threshold: float, recall: float, window: int, stretch: int, seed: int) -> DataFrame:
    """Links (u, v) of all passes: enough of them for every vector, or blocks for those that would need too many."""
    wanted = -math.log(1 - recall)
    now, n_now, more, links, had = vectors, n, passes(n, threshold, recall, window), [], None
    made = 0
    while True:
        places = ranked(projections(now, more, seed + made), n_now)
        places = places.groupBy("node").agg(F.collect_list(F.struct("pass", "rank", "key")).alias("places"))  # one per pass
        found = cut(neighbours(now.join(places, "node"), threshold, window, stretch))
        made += more
        links.append(found.where("v IS NOT NULL").select("u", "v"))
        if n_now <= window:
            break  # one window held them all
        chance = found.where("v IS NULL").select(F.col("u").alias("node"), "chance")
        chance = (chance if had is None else chance.unionByName(had)).groupBy("node").agg(F.sum("chance").alias("chance"))
        had = cut(chance.where(F.col("chance") < wanted))
        n_now, worst = had.agg(F.count(F.lit(1)), F.min("chance")).first()
        if not n_now:
            break
        now = cut(vectors.join(had.select("node"), "node", "left_semi"))
        more = math.ceil(made * (wanted - worst) / max(worst, 1e-9))
        if more * 2 * window >= n_now / 2:
            links.append(in_blocks(now, n_now, threshold, 4 * window))
            break
        more = min(more, 2 * made)  # then measure again
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def counted(members: DataFrame, threshold: float, chunk: int, groups: int) -> DataFrame:
    """node and linked: the weight of all members of its component (itself included) that are similar enough."""
    def work(batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in batch.groupby(["root", batch["vec"].map(len)], sort=False):
            x, weight, nodes = unit_rows(part["vec"]), part["n"].to_numpy(), part["node"].to_numpy()
            side, other = part["side"].to_numpy(), part["other"].to_numpy()
            for i in range(0, len(x), 2048):
                near = x[i:i + 2048] @ x.T >= threshold
                # chunks i and j: members of different chunks; one chunk: all its members
                near &= (side[i:i + 2048, None] != side[None, :]) | (other[i:i + 2048] == side[i:i + 2048])[:, None]
                out.append(pd.DataFrame({"node": nodes[i:i + 2048], "linked": near @ weight}))
        return pd.concat(out)

    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    dealt = members.join(sizes, "root").withColumn("chunks", chunks).withColumn(
        "side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # small components share groups; a pair of chunks is a group of its own
    grouped = pairs.withColumns({
        "g": F.when(F.col("chunks") > 1, F.col("root")).otherwise(F.lit(-1) - F.pmod(F.xxhash64("root"), F.lit(groups))),
        "lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    found = grouped.groupBy("g", "lo", "hi").applyInPandas(work, "node long, linked long")
    return found.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW,
                 stretch: int = STRETCH, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """_row, id, n_links, component_id and keep_row for every row."""
    facts = numbered(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
                     ).withColumnRenamed(ROW, "_row")
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    keys = [F.when(sound, F.xxhash64("vec", F.lit(salt))).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]
    slim = cut(facts.select("_row", "id", *keys))
    classes = cut(slim.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("_row").alias("node"), F.count(F.lit(1)).alias("n")))
    vectors = cut(facts.select("_row", "vec").join(classes.select(F.col("node").alias("_row")), "_row", "left_semi")
                  .withColumnRenamed("_row", "node"))
    n = classes.count()
    links = verified_links(vectors, n, threshold, recall, window, stretch, seed)
    roots = cut(components(links))
    linked = counted(classes.select("node", "n").join(roots, "node").join(vectors, "node"), threshold, CHUNK,
                     max(1, n // SHARED))
    by_class = classes.join(roots, "node", "left").join(linked, "node", "left").select(
        "h1", "h2", F.coalesce("root", "node").alias("root"), (F.coalesce("linked", "n") - 1).alias("n_links"))
    rooted = slim.join(by_class, ["h1", "h2"], "left").select(
        "_row", "id", F.coalesce("root", "_row").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return named(cut(rooted)).select("_row", "id", "n_links", "component_id", "keep_row")


def embedding_dedup(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", **settings: float) -> DataFrame:
    """One row per row: id, n_links, component_id, kept."""
    found = near_vectors(rows, id_col=id_col, vec_col=vec_col, **settings)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
