"""Vector code compression: product quantization whose rounds skip exact scans by norm-of-sum bounds.

Each component c becomes the integer floor(256 c), and a vector is cut into equal consecutive
parts.  Every part position has a codebook; a round assigns each part to the nearest entry (squared
Euclidean distance in integers, ties to the lower index) and replaces each entry by the floor of its parts' mean.

A part keeps, for each of ``GROUPS`` stretches of its codebook, a lower bound of the distance to all
entries but its own there, and a stamp: the round in which that bound was measured.  All earlier codebooks
are kept too, so in a later round the bound is lowered by the *net* displacement of an entry since
the stamp, |c_now - c_then| (the norm of the sum of its moves), which is never more than the sum of
the norms of its moves that drifting bounds add up.  If the distance to the own entry, measured anew,
is below what is left, nothing in the stretch can win or tie, and the stretch is not scanned; else it is, exactly,
and bound and stamp are new.  Bounds are rounded down, so skipping never changes a code.

Every round is a map over the rows with the codebooks so far broadcast (their size is fixed by the
parameters), then sums and counts per part, entry and component, combined in the tasks.  The state (integers,
codes, bounds, stamps) is kept in the shared folder between rounds, so a lost executor repeats its part of one round.

Defined cases: rows whose vector is null or holds null or non-finite components (or such that have no
integer of 61 bits) are dropped; shorter vectors are filled up with zeros to the longest, and this length to
the next multiple of the number of parts; vectors of any length are used whole; with fewer
vectors than entries the codebooks are shorter; equal ids are ordered by their vectors, null ids come last;
repeated rows are rows like others; null labels count together; an error beyond 64 bits is null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import cut
from tillroll.llm.vectors import floors, sound_rows

SCALE, PARTS, ENTRIES, ROUNDS = 256.0, 16, 64, 2
#: Stretches of a codebook that have a bound each.
GROUPS = 4
#: Values up to which distances are exact in doubles (their products stay below 2**53 for parts of up to 64).
SMALL = 1 << 22
#: Labels with over ``1 / HOT`` of the rows (``HOT`` at most) get their sums by a broadcast, others by a shuffle.
HOT = 500
SLACK = 1e-9
STATE, ANSWER = "codes binary, bounds binary, stamps binary", "codes binary, error long"
#: Bounds are kept in 16 bits, rounded down.
BOUND = "<f2"


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances; doubles that hold integers where those are exact, else Python integers."""
    if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) <= SMALL and rows.shape[1] <= 64:
        a, b = rows.astype(np.float64), entries.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)
    a, b = rows.astype(object), entries.astype(object)
    return np.stack([((a - one) ** 2).sum(axis=1) for one in b], axis=1)


def own_distances(rows: np.ndarray, entries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to one entry each."""
    if max(np.abs(rows).max(initial=0), np.abs(entries).max(initial=0)) <= SMALL and rows.shape[1] <= 64:
        gap = rows.astype(np.float64) - entries.astype(np.float64)[codes]
        return (gap * gap).sum(axis=1)
    return ((rows.astype(object) - entries.astype(object)[codes]) ** 2).sum(axis=1)


def below(lengths: np.ndarray) -> np.ndarray:
    """Lengths rounded down to what a bound can hold."""
    held = np.minimum(lengths * (1 - SLACK), np.finfo(BOUND).max).astype(BOUND)
    return np.nextafter(held, np.array(-1, dtype=BOUND))


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Book:
    """The history of one part's codebook: entries of every round so far, and how far they moved since each."""

    def __init__(self, history: list[np.ndarray], groups: int) -> None:
        self.now = history[-1]
        size = len(self.now)
        self.cuts = np.linspace(0, size, min(groups, size) + 1).astype(int)
        self.group_of = np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))
        # farthest[t, g, a]: the largest net move since round t of an entry in stretch g other than a
        moves = [np.sqrt(((self.now.astype(np.float64) - then) ** 2).sum(axis=1)) * (1 + SLACK) for then in history]
        self.farthest = np.zeros((len(history), len(self.cuts) - 1, size))
        for t, move in enumerate(moves):
            for g, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
                first = a + int(move[a:b].argmax())
                others = np.delete(move[a:b], first - a)
                self.farthest[t, g] = move[first]
                self.farthest[t, g, first] = others.max(initial=0.0)

    def assign(self, rows: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray | None, stamps: np.ndarray | None,
               now: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        """Codes, squared distances, bounds and stamps of this round, and how many stretches were scanned."""
        m, n_groups = len(rows), len(self.cuts) - 1
        at = np.arange(m)
        first_round = codes is None
        if first_round:
            codes = np.zeros(m, dtype=np.int64)
            left = np.full((m, n_groups), -1.0)
            stamps = np.full((m, n_groups), now, dtype=np.uint8)
        else:
            # what the bound of each stretch is worth now
            left = bounds - self.farthest[stamps, np.arange(n_groups), codes[:, None]]
        own = own_distances(rows, self.now, codes)
        reach = root(own) * (1 + SLACK)
        scan = reach[:, None] >= left
        best, best_at = own.copy(), codes.copy()
        least, second = [None] * n_groups, [None] * n_groups
        for g, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            todo = np.flatnonzero(scan[:, g])
            if not len(todo):
                continue
            found = distances(rows[todo], self.now[a:b])
            place = found.argmin(axis=1)  # the lowest index of equal ones
            smallest = found[np.arange(len(todo)), place]
            least[g] = (todo, smallest)
            if b - a > 1:
                found[np.arange(len(todo)), place] = np.inf if found.dtype != object else 1 << 200
                second[g] = found.min(axis=1)
            wins = (smallest < best[todo]) | ((smallest == best[todo]) & (place + a < best_at[todo]))
            best[todo[wins]], best_at[todo[wins]] = smallest[wins], place[wins] + a
        # new bounds: in a scanned stretch the least distance of all but the own entry
        bounds = np.full((m, n_groups), np.inf, dtype=BOUND) if first_round else bounds.copy()
        stamps = stamps.copy()
        own_group = self.group_of[best_at]
        for g in range(n_groups):
            if least[g] is None:
                continue
            todo, smallest = least[g]
            mine = own_group[todo] == g
            others = below(root(smallest))
            if second[g] is not None:
                others[mine] = below(root(second[g][mine]))
            else:
                others[mine] = np.inf
            bounds[todo, g], stamps[todo, g] = others, now
        # a stretch that was not scanned, but whose entry was left for a better one elsewhere, now has it among the others
        moved = np.flatnonzero(best_at != codes)
        stale = moved[~scan[moved, self.group_of[codes[moved]]]]
        g = self.group_of[codes[stale]]
        bounds[stale, g] = below(np.minimum(left[stale, g], root(own[stale])))
        stamps[stale, g] = now
        return best_at, best, bounds, stamps, int(scan.sum())


def whole_numbers(vectors: DataFrame, width: int, kind: str) -> DataFrame:
    """``vectors`` with x, the integers of ``vec`` as bytes, in its place."""
    @F.pandas_udf("binary")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([r.tobytes() for r in floors(batch, width, SCALE).astype(kind)])

    return vectors.select(*[c for c in vectors.columns if c != "vec"], work("vec").alias("x"))


def assigned(state: DataFrame, history: list[list[np.ndarray]], width: int, kind: str, groups: int,
             last: bool = False) -> DataFrame:
    """``state`` after one more round, for the codebooks of all rounds so far: new codes with bounds and stamps, or with error."""
    parts, now = len(history[0]), len(history) - 1
    index = code_type(history)
    carried = ["id", "label"] if last else ["id", "label", "x"]
    shared = state.sparkSession.sparkContext.broadcast(history)

    # the state travels as one struct, so a batch is a frame in every round
    used = ["x", *(("codes", "bounds", "stamps") if now else ())]

    @F.pandas_udf(ANSWER if last else STATE)
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books = [Book([codebooks[p] for codebooks in shared.value], groups) for p in range(parts)]
        part = width // parts
        for batch in batches:
            x, *before = (batch[name] for name in used)
            m = len(x)
            rows = np.frombuffer(b"".join(x), dtype=kind).reshape(m, width).astype(np.int64)
            if before:
                codes, bounds, stamps = (np.frombuffer(b"".join(column), dtype=t).reshape(m, parts, -1)
                                         for column, t in zip(before, (index, BOUND, "u1")))
            found = [book.assign(rows[:, p * part:(p + 1) * part],
                                 *((codes[:, p, 0].astype(np.int64), bounds[:, p], stamps[:, p]) if before else (None,) * 3), now)
                     for p, book in enumerate(books)]
            codes = [r.tobytes() for r in np.stack([f[0] for f in found], axis=1).astype(index)]
            if last:
                error = [int(e) for e in sum(f[1] for f in found)]
                yield pd.DataFrame({"codes": codes, "error": pd.Series([e if e < 1 << 63 else None for e in error], dtype="Int64")})
            else:
                bounds, stamps = (np.stack([f[k] for f in found], axis=1) for k in (2, 3))
                yield pd.DataFrame({"codes": codes, "bounds": [r.tobytes() for r in bounds.astype(BOUND)],
                                    "stamps": [r.tobytes() for r in stamps.astype("u1")]})

    return state.select(*carried, work(F.struct(*used)).alias("s")).select(*carried, "s.*")


def means(state: DataFrame, codebooks: list[np.ndarray], width: int, kind: str) -> list[np.ndarray]:
    """The next codebooks: floors of the means; unused entries stay."""
    parts, part, size = len(codebooks), width // len(codebooks), len(codebooks[0])
    index = code_type([codebooks])
    exact = np.int64 if np.dtype(kind).itemsize < 8 else object

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, used = np.zeros((parts, size, part), dtype=exact), np.zeros((parts, size), dtype=np.int64)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch["x"]), dtype=kind).reshape(len(batch), width).astype(exact)
            codes = np.frombuffer(b"".join(batch["codes"]), dtype=index).reshape(len(batch), parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], rows[:, p * part:(p + 1) * part])
                used[p] += np.bincount(codes[:, p], minlength=size)
        p, e = np.nonzero(used)
        if len(p):
            yield pd.DataFrame({"p": p, "e": e, "n": used[p, e], "high": [[int(v) >> 32 for v in r] for r in sums[p, e]],
                                "low": [[int(v) & (1 << 32) - 1 for v in r] for r in sums[p, e]]})

    partial = state.select("x", "codes").mapInPandas(work, "p int, e int, n long, high array<long>, low array<long>")
    totals = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[
        F.sum(F.col(name)[k]).alias(f"{name}{k}") for name in ("high", "low") for k in range(part)])
    new = [c.copy() for c in codebooks]
    for r in totals.collect():  # a row per entry
        new[r["p"]][r["e"]] = [((r[f"high{k}"] << 32) + r[f"low{k}"]) // r["n"] for k in range(part)]
    return new


def code_type(history: list[list[np.ndarray]]) -> str:
    return "u1" if len(history[0][0]) <= 256 else "<u2"


def encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS,
           id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, codes (bytes, one per part; two with over 256 entries) and error of every kept row, and the final codebooks."""
    vectors = sound_rows(rows, SCALE, id_col, vec_col, F.col(label_col).alias("label"))
    size = vectors.agg(F.max(F.size("vec")).alias("longest"),
                       F.max(F.array_max(F.transform("vec", lambda c: F.abs(c)))).alias("most")).first()
    width = -(-(size["longest"] or 0) // parts) * parts
    largest = (size["most"] or 0.0) * SCALE + 1
    kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<i8"
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vec").limit(entries).select("vec").collect()
    start = floors([np.asarray(r["vec"]) for r in first], width, SCALE)
    history = [[np.ascontiguousarray(x) for x in np.split(start, parts, axis=1)]]
    if not first:
        nothing = rows.sparkSession.createDataFrame([], vectors.select("id", "label").schema)
        return nothing.select("*", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error")), history[0]
    state = whole_numbers(vectors, width, kind)
    for _ in range(rounds):
        state = cut(assigned(state, history, width, kind, groups))
        history.append(means(state, history[-1], width, kind))
    return assigned(state, history, width, kind, groups, last=True), history[-1]


def with_label_sums(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error, the sum of error over equal labels; frequent labels are joined on the map side."""
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
               .withColumnRenamed("label", "of"))
    total = sums.agg(F.sum("n").alias("n")).select("n").scalar()
    hot = sums.where(F.col("n") * HOT > total)  # HOT labels at most
    same = F.col("label").eqNullSafe(F.col("of"))
    near = coded.join(F.broadcast(hot), same)
    rest = coded.join(F.broadcast(hot.select("of")), same, "left_anti").join(sums, same)
    return near.unionByName(rest).drop("of", "n")


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for book in codebooks for c in book.ravel()).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", **settings: int | str) -> DataFrame:
    """One row per kept row: id, code, error, label_error, codebooks_sha256."""
    coded, codebooks = encode(rows, id_col=id_col, **settings)
    summed = with_label_sums(cut(coded))
    return summed.select(F.col("id").alias(id_col), F.lower(F.hex("codes")).alias("code"), "error", "label_error",
                         F.lit(digest(codebooks)).alias("codebooks_sha256"))
