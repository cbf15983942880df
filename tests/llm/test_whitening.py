import math
import random

import numpy as np
import pytest

from tillroll.llm.whitening import bounds, long_form, planes, products, scatter, whiten
from tillroll.llm.vectors import sound_rows

SCHEMA = "vec_id long, embedding array<double>, n int, component int, explained string"


def integers(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    return [i for i, _ in kept], [[math.floor(64 * c) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]


def brute(rows):
    """n, deviations by id, eigenvalues, and whitened rows up to sign, from plain integers."""
    ids, x = integers(rows)
    n, width = len(x), len(x[0])
    s = [sum(col) for col in zip(*x)]
    centred = [[n * a - b for a, b in zip(row, s)] for row in x]
    v = np.array([[sum(r[i] * r[j] for r in centred) / n ** 3 for j in range(width)] for i in range(width)])
    values, vectors = np.linalg.eigh(v)
    white = (np.array(centred, dtype=float) / n) @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))
    return ids, n, [sum(a * a for a in r) for r in centred], values[::-1], white


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)


def made(n, dims, seed, scale=0.3):
    rng = random.Random(seed)
    axis = [rng.gauss(0, 1) for _ in range(dims)]
    return [(i, [rng.gauss(0, scale) * (k + 1) ** 0.5 + (axis[k] if i % 3 == 0 else 0) for k in range(dims)]) for i in range(n)]


def test_whole_contract_against_plain_integers(spark):
    rows = made(400, 40, 1)
    rows += [(3, rows[3][1]), (None, rows[5][1]), (900, None), (901, [None] * 40), (902, [float("nan")] * 40),
             (903, [float("-inf")] * 40)] + [(1000 + i, [0.5] * 40) for i in range(150)]
    ids, n, deviations, values, white = brute(rows)
    out = long_form(whiten(table(spark, rows)))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    assert len(got) == 32 * n and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    assert sorted({(r.vec_id or -1, int(r.deviation)) for r in got}) == sorted({(i or -1, d) for i, d in zip(ids, deviations)})
    explained = {r.component: r.explained for r in got}
    assert sorted(explained) == list(range(1, 33))
    np.testing.assert_allclose([explained[k + 1] for k in range(32)], values[:32] / values.sum(), rtol=1e-9)
    by_id = {}
    for r in got:
        if r.vec_id is not None and r.vec_id != 3:
            by_id.setdefault(r.vec_id, {})[r.component] = r.whitened
    sample = [at for at, i in enumerate(ids) if i in by_id]
    mine = np.array([[by_id[ids[at]][k] for k in range(1, 33)] for at in sample])
    signs = np.sign((mine * white[sample, :32]).sum(axis=0))
    np.testing.assert_allclose(mine * signs, white[sample, :32], atol=1e-7)


@pytest.mark.parametrize("scale", [0.0, 0.3, 1e4, 1e13])
def test_scatter_is_exact(spark, scale):
    rows = made(150, 5, 2, scale) if scale else [(i, [0.5, -1.0]) for i in range(70)]
    vectors = sound_rows(table(spark, rows), 64.0, "vec_id", "embedding")
    n, least, most, sums = bounds(vectors)
    _, x = integers(rows)
    assert (n, least, most, sums) == (len(x), *[[f(c) for c in zip(*x)] for f in (min, max, sum)])
    found = scatter(vectors, least, most)
    y = [[a - b for a, b in zip(row, least)] for row in x]
    for i in range(len(least)):
        for j in range(i, len(least)):
            assert found.get((i, j), 0) == sum(r[i] * r[j] for r in y)


def test_planes_round_trip():
    y = np.array([[5, 0, 1], [2, 0, 7], [7, 0, 0]] * 30)
    bits = np.array([3, 0, 3])
    words = planes(y, bits)
    assert words.shape == (6, 2)
    assert np.bitwise_count(words).sum(axis=1).tolist() == [((y[:, d] >> b) & 1).sum() for d in (0, 2) for b in range(3)]
    assert products(words, bits).tolist() == np.triu(y.T @ y).tolist()


def test_edges(spark):
    assert whiten(table(spark, [])).count() == 0 and whiten(table(spark, [(1, None), (2, [])])).count() == 0
    one = long_form(whiten(table(spark, [(7, [0.5, 1.0])]))).collect()
    assert [(r.vec_id, r.component, r.n, int(r.deviation), r.whitened, r.identity_error) for r in one] == [
        (7, 1, 1, 0, 0.0, 0.0), (7, 2, 1, 0, 0.0, 0.0)]
    # constant dimensions and fewer rows than dimensions: the rest is white
    flat = [(i, [0.25, (i % 4) / 8, 1.0 if i % 2 else -1.0]) for i in range(40)]
    got = whiten(table(spark, flat)).collect()
    assert {len(r.whitened) for r in got} == {3} and all(r.whitened[2] == 0 for r in got) and got[0].identity_error < 1e-9
    # shorter vectors are filled up with zeros
    ragged = [(i, [0.1 * i, 0.2][: 1 + i % 2]) for i in range(30)]
    full = [(i, [*v, 0.0][:2]) for i, v in ragged]
    as_is, filled = (sorted(tuple(r)[:5] for r in whiten(table(spark, x)).collect()) for x in (ragged, full))
    assert [r[:3] for r in as_is] == [r[:3] for r in filled]
    np.testing.assert_allclose([r[3] for r in as_is], [r[3] for r in filled], atol=1e-9)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [(-1) ** i * 1e9 * (i + 1), 3.0 * i]) for i in range(50)]
    ids, n, deviations, values, _ = brute(rows)
    got = whiten(table(spark, rows)).collect()
    assert {r.vec_id: int(r.deviation) for r in got} == dict(zip(ids, deviations))
