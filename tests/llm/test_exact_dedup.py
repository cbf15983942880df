import hashlib
import re
from collections import defaultdict

from tillroll.llm.exact_dedup import decided, drop_exact_copies, exact_dedup, facts_of

TEXTS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c"), (7, "A b"), (8, "x" * 200_000),
         (9, "x " * 200_000), (2, "ab"), (None, "zz"), (10, "z z"), (11, "a\u00a0b"), (12, "é"), (12, "é")]


def brute(rows):
    groups = defaultdict(list)
    for at, (i, text) in enumerate(rows):
        text = text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), i is None, i or 0, at, i))
    out = []
    for key, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m is best, hashlib.sha256(key.encode()).hexdigest()) for m in members]
    return sorted(map(repr, out))


def test_small_cases(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").coalesce(1)
    assert sorted(repr(tuple(r)) for r in exact_dedup(docs).collect()) == brute(TEXTS)


def test_heavy_digests_take_the_map_side_path(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"warm {i % 5}" if i % 3 == 1 else f"own {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    facts = facts_of(docs)
    out, heavy = decided(facts, tracked=64, share=20)
    assert {r.group_size for r in heavy.collect()} == {100, 20}
    got = [(r.id, r.keep_id, r.group_size, r.kept, r.digest) for r in out.collect()]
    assert sorted(map(repr, got)) == brute(rows)


def test_dropping_keeps_one_row_with_all_columns(spark):
    rows = [(i, t, "digest", 1, i) for i, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, kept int, group_size long").coalesce(1)
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    kept = {r[0] for r in [eval(x) for x in brute(TEXTS)] if r[3]}
    got = [r.doc_id for r in left.collect()]
    assert len(got) == len(kept) == len(set(got)) and set(got) == kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).count() == 0 and drop_exact_copies(docs).count() == 0
