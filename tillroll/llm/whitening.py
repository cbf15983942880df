"""Embedding whitening by bit-sliced scatter.

1. Each component c becomes the integer x = floor(64 c) + 1000000; least and largest x and their sum S
   per dimension come from one aggregate.
2. Scatter: a task shifts each dimension by its least value, cuts the rest into bit planes, and packs
   the planes of its rows into 64-bit words.  The sum over rows of y_i y_j is the sum over all
   pairs of their planes a, b of 2**(a + b) times the number of bits that both planes hold (AND, popcount):
   exact, however many rows there are.  A task gives one number per pair of dimensions, in limbs of
   40 bits that Spark sums.
3. The scatter is centred in integers (n * sum(y_i y_j) - S_i S_j, without rounding), divided by n
   squared, and taken apart by ``eigh``.
4. Every row is centred in integers too (n * x - S), projected on the components and divided by the root
   of their eigenvalues.  The covariance of what comes out is summed the same way, in doubles, and
   compared with the identity.

The driver gets numbers per pair of dimensions and of components, never rows.

Defined cases: rows whose vector is null or holds null or non-finite components (or such whose x needs more
than 62 bits) are dropped; shorter vectors are filled up with zeros to the longest; vectors of any length are
used whole, their length bounds what is packed and collected (its square); a null id and
repeated rows are rows like others; a component whose eigenvalue is not above rounding (constant dimensions,
fewer rows than dimensions) has whitened 0 and takes no part in ``identity_error``; with equal
eigenvalues any orthogonal choice is right; an empty table, or empty vectors alone, give an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.vectors import floors, sound_rows

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 32
#: Rows whose planes are packed at a time.
ROWS = 8192
LIMB, LIMBS = 40, 5
#: Deviations leave a task in two parts, as they may need more than 64 bits.
HALF = 48
WHITENED = "id {id}, high long, low long, whitened array<double>"


def bounds(vectors: DataFrame) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and per dimension the least x, the largest x and the sum of x."""
    x = (F.floor(F.col("c") * SCALE) + F.lit(OFFSET).cast("long")).alias("x")
    seen = vectors.select(F.posexplode_outer("vec").alias("d", "c")).select("d", x).groupBy("d").agg(
        F.min("x").alias("least"), F.max("x").alias("most"), F.sum(F.col("x").cast("decimal(20,0)")).alias("total"),
        F.count(F.lit(1)).alias("rows")).collect()
    n = sum(r["rows"] for r in seen if not r["d"])  # at the first dimension, or without any
    found = sorted((r for r in seen if r["d"] is not None), key=lambda r: r["d"])
    # vectors that end before a dimension have a zero there
    ends = [n - r["rows"] for r in found]
    least = [min(r["least"], OFFSET) if short else r["least"] for r, short in zip(found, ends)]
    most = [max(r["most"], OFFSET) if short else r["most"] for r, short in zip(found, ends)]
    return n, least, most, [int(r["total"]) + short * OFFSET for r, short in zip(found, ends)]


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The bit planes of every column of ``y`` (column by column, lowest bit first), rows packed into words."""
    held = np.zeros((bits.sum(), -(-len(y) // 64) * 64), dtype=np.uint8)
    at = 0
    for column, n in zip(y.T, bits):
        held[at:at + n, :len(y)] = column >> np.arange(n)[:, None] & 1
        at += n
    return np.packbits(held, axis=1).view(np.uint64)


def products(words: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The sums of y_i y_j for i <= j, from the planes of at most ``ROWS`` rows; exact."""
    out = np.zeros((len(bits), len(bits)), dtype=object)
    live = np.flatnonzero(bits)  # dimensions of one value have no planes
    ends = np.cumsum(bits[live])
    kind = np.int64 if bits.max(initial=0) <= 24 else object
    weight = np.array([1 << b for n in bits[live] for b in range(n)], dtype=kind)
    for k, (i, end) in enumerate(zip(live, ends)):
        first = end - bits[i]
        sums = 0
        for plane in range(first, end):
            both = np.bitwise_count(words[first:] & words[plane]).sum(axis=1, dtype=np.int64)
            sums = sums + weight[plane] * np.add.reduceat(both * weight[first:], ends[k:] - bits[live[k:]] - first)
        out[i, live[k:]] = sums
    return out


def scatter(vectors: DataFrame, least: list[int], most: list[int]) -> dict[tuple[int, int], int]:
    """The exact sum of y_i y_j over all rows for i <= j, where y is x above the dimension's least."""
    width, low = len(least), np.array(least, dtype=np.int64)
    bits = np.array([(b - a).bit_length() for a, b in zip(least, most)])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width), dtype=object)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                y = floors(batch["vec"].iloc[at:at + ROWS], width, SCALE) + OFFSET - low
                total += products(planes(y, bits), bits)
        yield pd.DataFrame([(i, j, *(int(total[i, j]) >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS)))
                            for i, j in np.argwhere(total)], columns=["i", "j", *limbs])

    limbs = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.select("vec").mapInPandas(work, "i int, j int, " + ", ".join(f"{x} long" for x in limbs))
    summed = parts.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in limbs])
    return {(r["i"], r["j"]): sum(r[x] << LIMB * k for k, x in enumerate(limbs)) for r in summed.collect()}


def principal(n: int, sums: list[int], products: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and unit eigenvectors (columns) of the covariance."""
    width = len(sums)
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            # an exact integer; int / int is rounded once
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(v)
    return values[::-1], vectors[:, ::-1]


class Whitener:
    """Centres, projects and scales rows."""

    def __init__(self, n: int, least: list[int], most: list[int], sums: list[int], kept: int) -> None:
        self.n, self.least, self.most, self.sums, self.kept = n, least, most, sums, kept

    def fitted(self, products: dict[tuple[int, int], int]) -> Whitener:
        values, vectors = principal(self.n, self.sums, products)
        values = np.maximum(values, 0.0)
        trace = values.sum()
        self.explained = (values / trace if trace > 0 else values)[:self.kept]
        self.sound = values[:self.kept] > len(values) * np.finfo(float).eps * max(trace, 1e-300)
        roots = np.sqrt(np.where(self.sound, values[:self.kept], 1.0))
        self.axes = np.where(self.sound, vectors[:, :self.kept] / roots, 0.0)
        return self

    def centred(self, vectors: pd.Series) -> np.ndarray:
        """n * x - S in exact integers."""
        y = floors(vectors, len(self.least), SCALE) + OFFSET - np.array(self.least, dtype=np.int64)
        span = max(b - a for a, b in zip(self.least, self.most))
        # the square of it, over all dimensions, must fit too
        kind = np.int64 if len(self.least) * (self.n * max(span, 1)) ** 2 < 1 << 62 else object
        return self.n * y.astype(kind) - np.array(self.sums, dtype=kind)

    def __call__(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """Deviation and whitened components of every row."""
        centred = self.centred(vectors)
        return (centred * centred).sum(axis=1), (centred / self.n).astype(np.float64) @ self.axes


def identity_error(vectors: DataFrame, whitener: Whitener) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    kept = whitener.kept

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((kept + 1, kept))  # sums, then sums of products
        for batch in batches:
            _, white = whitener(batch["vec"])
            total += np.vstack([white.sum(axis=0), white.T @ white])
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "total": total.ravel()})

    sums = vectors.select("vec").mapInPandas(work, "i int, j int, total double").groupBy("i", "j").agg(
        F.sum("total").alias("total")).collect()
    found = np.zeros((kept + 1, kept))
    for r in sums:
        found[r["i"], r["j"]] = r["total"] / whitener.n
    # the rows are centred already: what their mean has left is rounding
    off = (found[1:] - np.outer(found[0], found[0]) - np.eye(kept))[np.ix_(whitener.sound, whitener.sound)]
    return float(np.abs(off).max()) if off.size else 0.0


def whiten(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row per kept vector: id, n, deviation (decimal(38,0)), whitened and explained (arrays over components), identity_error."""
    vectors = sound_rows(rows, SCALE, id_col, vec_col)
    id_type = vectors.schema["id"].dataType.simpleString()
    n, least, most, sums = bounds(vectors)
    empty = f"{id_col} {id_type}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if not least:
        return rows.sparkSession.createDataFrame([], empty)
    shifted = [s - n * a for s, a in zip(sums, least)]  # sums of y
    whitener = Whitener(n, least, most, shifted, min(components, len(least))).fitted(scatter(vectors, least, most))
    error = identity_error(vectors, whitener)

    @F.pandas_udf("high long, low long, whitened array<double>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            deviation, white = whitener(batch)
            yield pd.DataFrame({"high": (deviation >> HALF).astype(np.int64), "whitened": list(white),
                                "low": (deviation & ((1 << HALF) - 1)).astype(np.int64)})

    deviation = F.col("w.high").cast("decimal(20,0)") * F.lit(1 << HALF).cast("decimal(18,0)") + F.col("w.low")
    return vectors.select(F.col("id").alias(id_col), judged("vec").alias("w")).select(
        id_col, F.lit(n).cast("long").alias("n"), deviation.cast("decimal(38,0)").alias("deviation"), "w.whitened",
        F.array(*[F.lit(float(x)) for x in whitener.explained]).alias("explained"), F.lit(error).alias("identity_error"))


def long_form(whitened: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component, numbered from 1."""
    return whitened.select(id_col, "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "one")
                           ).select(id_col, (F.col("at") + 1).alias("component"), "n", "deviation",
                                    F.col("one").alias("whitened"), F.col("explained")[F.col("at")].alias("explained"),
                                    "identity_error")
