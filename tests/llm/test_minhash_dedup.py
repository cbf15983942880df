import random

import numpy as np
from pyspark.sql import functions as F

from tillroll.llm import minhash_dedup as M
from tillroll.llm.components import components


def brute(rows, k):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets.append(set(zip(*[w[j:] for j in range(n)])) if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(repr((doc, len(sets[i]), least.get(find(i)), doc == least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def corpus(seed=9):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrst") + rng.choice("aeiou") + rng.choice("xyz")
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(12, 60))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "  \t"]).join(copy))
        texts.append(" ".join(base).upper())
    hot = [word() for _ in range(40)]
    for _ in range(60):  # a hot group of near copies, no two alike
        copy = list(hot)
        copy[rng.randrange(40)] = word()
        texts.append(" ".join(copy))
    texts += ["", None, "  ", "one", "ONE", "one two", "two one", "É é", "é é", "x y", "w " * 50_000, "w " * 50_001]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, rows[5][1]), (None, "alone here")]


def test_groups_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, keys string, root int").coalesce(2)
    for k in (2, 5):
        assert sorted(repr(tuple(r)) for r in M.minhash_dedup(docs, k).collect()) == brute(rows, k)


def test_dropping_keeps_one_row_of_each_group(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, root string").coalesce(2)
    left = M.drop_near_copies(docs)
    groups = {eval(x)[2] for x in brute(rows, 5)}
    empty = sum(not (t or "").split() for _, t in rows)
    got = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns
    assert set(got) == groups and len(got) == len(groups) and empty == 3
    assert M.drop_near_copies(docs.limit(0)).count() == 0 and M.minhash_dedup(docs.limit(0)).count() == 0


def test_every_coordinate_fills_and_estimates_the_similarity():
    rng = np.random.default_rng(3)
    t, errors = 192, []
    for n in (1, 2, 7, 100, 5000):
        assert (M.sketch(rng.integers(0, 2**63, n, dtype=np.uint64), t) != np.uint64(2**64 - 1)).all()
    for _ in range(60):
        pool = rng.integers(0, 2**63, 300, dtype=np.uint64)
        x, y = pool[:260], pool[40:]  # 220 of 300 in common
        errors.append((M.sketch(x, t) == M.sketch(y, t)).mean() - 220 / 300)
    assert abs(np.mean(errors)) < 0.015 and np.abs(errors).max() < 0.15
    a = rng.integers(0, 2**63, 50, dtype=np.uint64)
    assert (M.sketch(a, t) == M.sketch(a[::-1].copy(), t)).all()


def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(0, 90)] + [(200, 200 + i) for i in range(1, 40)] + [(301, 300), (302, 301), (300, 302), (400, 400)]
    random.Random(1).shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = {i: 0 for i in range(91)} | {i: 200 for i in range(200, 240)} | {i: 300 for i in (300, 301, 302)}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_wrong_stars_are_mended_inside_buckets(spark):
    # one band of one row puts many different sets into shared buckets, whose smallest member links with few
    rows = corpus(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r.component_id for r in M.minhash_dedup(docs, 2, bands=40, rows=1).where(F.col("doc_id").isNotNull()).collect()}
    want = {eval(x)[0]: eval(x)[2] for x in brute(rows, 2) if eval(x)[0] is not None}
    assert got == want
