import numpy as np
import pytest

from tillroll.llm import embedding_dedup as M


def brute(rows):
    """id -> (links, smallest id reachable), pair by pair."""
    def unit(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, dtype=np.float64)
        return x / np.linalg.norm(x)
    units = [unit(v) for _, v in rows]
    links = {i: set() for i in range(len(rows))}
    for i, x in enumerate(units):
        for j, y in enumerate(units):
            if i != j and x is not None and y is not None and len(x) == len(y) and x @ y >= 0.95:
                links[i].add(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(map(repr, out))


def answers(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, n_links int, component_id string")
    return sorted(repr(tuple(r)) for r in M.embedding_dedup(df, **settings).collect())


def test_groups_chains_and_copies(spark):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(12):
        centre = rng.normal(size=16)
        rows += [centre + rng.normal(size=16) * s for s in rng.uniform(0, 0.35, size=8)]
    rows += [rows[0] * 3, rows[0], rows[0], rows[0] * 1e-20]
    rows = [(len(rows) - i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8),
             (905, [float("inf")] * 16), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (None, [1.0, 0.0]), (906, [1.0, 0.0])]
    assert answers(spark, rows) == brute(rows)


def test_a_group_larger_than_any_window_loses_no_link(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [centre + rng.normal(size=8) * 0.02 for _ in range(120)] + [rng.normal(size=8) for _ in range(60)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    assert answers(spark, rows, window=16, stretch=32) == brute(rows)


def test_recall_of_links_at_scale_of_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = {r.vec_id: r.n_links for r in M.embedding_dedup(df, window=64, stretch=512).collect()}
    rows = df.collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = np.array([found[r.vec_id] for r in rows])
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_empty_table_and_passes(spark):
    assert answers(spark, []) == []
    assert M.passes(10) == 1 and M.passes(10**5) < M.passes(10**7) < 200 and 0.89 < M.agreement(0.95) < 0.91


def crowded(n, share, cosine, pair_cosine, n_pairs, dims=64, seed=9):
    """Vectors of which a share crowds around one direction at a mutual cosine, and planted pairs inside the crowd."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centre, m = unit(rng.normal(size=dims)), int(n * share)

    def off(about, cos):
        side = rng.normal(size=(len(about), dims))
        side -= (side * about).sum(axis=1, keepdims=True) * about
        return cos * about + np.sqrt(1 - cos * cos) * unit(side)

    crowd = off(np.repeat(centre[None], m, axis=0), np.sqrt(cosine))
    twins = off(crowd[:n_pairs], pair_cosine)
    return np.concatenate([crowd, twins, unit(rng.normal(size=(n - m - n_pairs, dims)))]).astype(np.float32)


@pytest.mark.parametrize("cosine", [0.90, 0.93])
def test_links_inside_a_crowd(spark, cosine):
    x = crowded(9000, 1 / 3, cosine, 0.955, 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    found = {r.vec_id: (r.n_links, r.component_id) for r in M.embedding_dedup(df, window=48, stretch=384).collect()}
    y = x.astype(np.float64)
    y /= np.linalg.norm(y, axis=1)[:, None]
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    want, got = near.sum(axis=1), np.array([found[i][0] for i in range(len(x))])
    assert want.sum() >= 600 and (got <= want).all() and got.sum() >= 0.99 * want.sum()
    i, j = np.nonzero(near)
    assert np.mean([found[a][1] == found[b][1] for a, b in zip(i, j)]) >= 0.99


def test_blocks_find_every_link(spark):
    x = crowded(500, 0.6, 0.94, 0.96, 40, dims=8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>").repartition(4)
    links = [(r.u, r.v) for r in M.in_blocks(df, 500, 0.95, 64).collect()]
    y = x / np.linalg.norm(x, axis=1)[:, None]
    near = y.astype(np.float64) @ y.T.astype(np.float64) >= 0.95

    def components(edges):
        label = list(range(500))
        def top(i):
            while label[i] != i:
                i = label[i]
            return i
        for a, b in edges:
            a, b = sorted((top(a), top(b)))
            label[b] = a
        return [top(i) for i in range(500)]
    assert components(links) == components(zip(*(z.tolist() for z in np.nonzero(near))))


def test_shared_hashes_and_chances():
    a = np.array([0, 5, (1 << 62) - 1, 1 << 61], dtype=np.int64)
    b = np.array([0, 4, 0, (1 << 61) + 1], dtype=np.int64)
    assert M.shared_hashes(a, b).tolist() == [62, 61, 0, 61]
    spread = M.chances(np.arange(0, 1 << 62, 1 << 52, dtype=np.int64), 0.95, 16)
    dense = M.chances(np.arange(1024, dtype=np.int64), 0.95, 16)
    assert spread.min() > 3 * dense.max()
