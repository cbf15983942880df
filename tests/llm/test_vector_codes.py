import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tillroll.llm.vector_codes import Book, digest, encode, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def brute(rows, parts, entries, rounds):
    """The contract by plain integers: full scans, no bounds."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    part = width // parts
    cells = [[math.floor(256 * c) for c in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))
    books = [[cells[r][p * part:(p + 1) * part] for r in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for x in cells:
                members[nearest(x[p * part:(p + 1) * part], books[p])[1]].append(x[p * part:(p + 1) * part])
            for e, xs in members.items():
                books[p][e] = [sum(col) // len(xs) for col in zip(*xs)]
    out, by_label = [], defaultdict(int)
    for (i, _, lab), x in zip(kept, cells):
        found = [nearest(x[p * part:(p + 1) * part], books[p]) for p in range(parts)]
        out.append((i, "".join("%02x" % e for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    text = ",".join(str(c) for book in books for entry in book for c in entry)
    sha = hashlib.sha256(text.encode()).hexdigest()
    return sorted(((i, code, error, by_label[lab], sha) for i, code, error, lab in out), key=repr)


def run(spark, rows, parts=16, entries=64, rounds=2, **settings):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = vector_codes(df, parts=parts, entries=entries, rounds=rounds, **settings)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def vectors(n, dims, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(7)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centres[0 if i % 3 == 0 else i % 7]], i % 5 or None) for i in range(n)]


def test_whole_contract_against_plain_integers(spark):
    rows = vectors(300, 32, 1)
    rows += [(3, rows[3][1], 9), (4, [0.5] * 32, 1), (None, [0.25] * 32, None), (900, None, 1), (901, [None] * 32, 1),
             (902, [float("nan")] * 32, 2), (903, [float("inf")] + [0.0] * 31, 2)] + [(1000 + i, [0.125] * 32, 4) for i in range(60)]
    assert run(spark, rows) == brute(rows, 16, 64, 2)


def test_lengths_and_sizes(spark):
    ragged = [(i, v[:n], lab) for (i, v, lab), n in zip(vectors(40, 11, 2), [11, 5, 0, 10] * 10)]
    assert run(spark, ragged, parts=4, entries=9, rounds=4, groups=3) == brute(ragged, 4, 9, 4)
    few = vectors(5, 16, 3)
    assert run(spark, few) == brute(few, 16, 64, 2)
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    assert len(run(spark, [(1, [], 1), (2, [], None)])) == 2


def test_large_values_are_exact(spark):
    big = vectors(40, 8, 4, spread=1e5) + [(77, [3e6, -3e6] * 4, 1), (78, [3e6 + 1 / 256, -3e6] * 4, 1)]
    assert run(spark, big, parts=2, entries=6, rounds=3) == brute(big, 2, 6, 3)
    huge = [(i, [x * 1e9 for x in v], lab) for i, v, lab in vectors(20, 4, 5)]
    want = brute(huge, 2, 3, 2)
    got = run(spark, huge, parts=2, entries=3, rounds=2)
    assert [r[:2] for r in got] == [r[:2] for r in want] and {r[4] for r in got} == {r[4] for r in want}
    assert all(a[2] == b[2] if b[2] < 1 << 63 else a[2] is None for a, b in zip(got, want))


@pytest.mark.parametrize("groups", [1, 4, 64])
def test_bounds_skip_scans_and_change_nothing(groups):
    rng = np.random.default_rng(6)
    rows = rng.integers(-200, 200, size=(3000, 4))
    rows[:1000] = rows[0]  # a third of the parts are equal
    history = [rows[::50][:64].astype(np.int64)]
    codes = bounds = stamps = None
    scanned = []
    for now in range(6):
        codes, squares, bounds, stamps, n = Book(history, groups).assign(rows, codes, bounds, stamps, now)
        full = ((rows[:, None, :] - history[-1][None]) ** 2).sum(axis=2)
        assert (codes == full.argmin(axis=1)).all() and (squares == full.min(axis=1)).all()
        # what a bound is worth now is never more than the distance to any other entry of its stretch
        book = Book(history, groups)
        left = bounds.astype(float) - book.farthest[stamps, np.arange(len(book.cuts) - 1), codes[:, None]]
        others = full.astype(float)
        others[np.arange(len(rows)), codes] = np.inf
        for g, (a, b) in enumerate(zip(book.cuts, book.cuts[1:])):
            assert (left[:, g] <= np.sqrt(others[:, a:b].min(axis=1))).all()
        scanned.append(n / left.size)
        # entries move there and back: accumulated drifts would give the bounds away, net displacements do not
        step = 40 if now % 2 == 0 else -40
        history.append(history[-1] + step)
    assert scanned[0] == 1 and scanned[2] == scanned[4] and scanned[4] <= scanned[1]
    if groups > 1:
        assert scanned[4] < 0.6


def test_general_interface(spark):
    df = spark.createDataFrame([(f"v{i}", v, "a" if i % 2 else None) for i, v, _ in vectors(400, 8, 7)],
                               "name string, v array<float>, kind string")
    coded, books = encode(df, parts=4, entries=300, rounds=1, id_col="name", vec_col="v", label_col="kind")
    assert len(books) == 4 and books[0].shape == (300, 2) and len(digest(books)) == 64
    assert {len(r.codes) for r in coded.collect()} == {8} and coded.count() == 400
