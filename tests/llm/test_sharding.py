import numpy as np

from tillroll.llm import queries
from tillroll.llm.sharding import jump, shard_rows


def plain_jump(key, n):
    """The published loop, number by number."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function():
    keys = np.array([0, 1, 2, 10, 2**63, 2**64 - 1, *range(1000, 1200)], dtype=np.uint64)
    for n in (1, 2, 8, 9, 100):
        assert jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_one_more_shard_takes_rows_only_into_itself(spark):
    moved = shard_rows(spark.range(20_000).withColumnRenamed("id", "doc_id"))
    bad = moved.where("shard <> grown_shard AND grown_shard <> 8")
    share = moved.where("shard <> grown_shard").count() / 20_000
    assert bad.count() == 0 and abs(share - 1 / 9) < 0.02
    sizes = [r["count"] for r in moved.groupBy("shard").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.15 * min(sizes)


def test_empty_table_and_long_texts(spark):
    assert shard_rows(spark.createDataFrame([], "doc_id long, size long")).count() == 0
    texts = ["x" * (1 << 20) if i % 10 == 0 else "short" for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = shard_rows(docs, shards=2, bytes_per_range=1 << 20)
    rows = out.collect()
    assert sorted((r.doc_id, len(r.text)) for r in rows) == [(i, len(t)) for i, t in enumerate(texts)]
    for shard in (0, 1):
        mine = [r.slot for r in rows if r.shard == shard]
        assert sorted(mine) == list(range(len(mine)))
    assert {r.shard for r in shard_rows(spark.createDataFrame([(None, "a")], "doc_id long, text string"), shards=4).collect()} == {plain_jump(0, 4)}


def test_whole_documents_are_placed_with_hot_keys(spark):
    rows = [(i if i % 3 else 7, f"text {i}", i) for i in range(3000)] + [(None, None, None), (7, "text 0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot long")
    out = shard_rows(docs, shards=4, rows_per_range=100).collect()
    assert sorted((repr(r.doc_id), repr(r.text)) for r in out) == sorted((repr(d), repr(t)) for d, t, _ in rows)
    for shard in range(4):
        mine = [r for r in out if r.shard == shard]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert {plain_jump(r.doc_id or 0, 4) for r in mine} == {shard}


def test_the_query_shuffles_the_texts(spark, tmp_path):
    spark.createDataFrame([(i, f"é {i}") for i in range(50)] + [(50, None)], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    out = queries.op10_sharding(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Window [row_number"):]
    assert "crc32" in plan[:plan.index("Window [row_number")] and "text#" in below and "crc32" not in below
    assert {(r.doc_id, r.size) for r in out.collect()} == {(i, len(f"é {i}".encode()) + 1) for i in range(50)} | {(50, 1)}
