import math

import pytest
from pyspark.sql import functions as F

from tillroll.llm import mixing as M
from tillroll.llm import queries


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 900.0])
def test_quantiles_are_the_poisson_distribution(rate):
    low, below = M.quantiles(rate)
    total = 0.0
    for k in range(low + len(below)):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        if k >= low:
            assert abs(below[k - low] - total) < 1e-9
    mean = low + sum(1 - b for b in below)
    assert abs(mean - rate) < 1e-6 * max(1, rate)


def docs_of(spark, n=3000):
    return spark.range(n).selectExpr("id AS doc_id", "repeat('x', 9) AS text",
                                     "CASE id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS source", "id AS copy_of")


def test_shares_meet_the_weights(spark):
    docs = docs_of(spark)
    mixed = M.mix(docs, {"a": 0.6}, budget=60_000)
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    # ten units a document: 3600 copies of a; b and the null source share the rest equally
    for source, want in (("a", 3600), ("b", 1200), (None, 1200)):
        assert abs(got[source] - want) < 5 * math.sqrt(want)
    assert mixed.columns[:4] == docs.columns


def test_counts_are_quantiles_of_the_hashed_number_at_any_layout(spark, monkeypatch):
    docs = docs_of(spark, 300)
    first = sorted(map(tuple, M.mix(docs, {"a": 0.5, "b": 0.5}).select("doc_id", "copies", "copy", "shuffle_key").collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    again = sorted(map(tuple, M.mix(docs.repartition(7), {"a": 0.5, "b": 0.5}).select("doc_id", "copies", "copy", "shuffle_key").collect()))
    assert first == again
    u = {r.doc_id: r.u for r in docs.select("doc_id", M.uniform(7, "doc_id").alias("u")).collect()}
    copies = {d: c for d, c, _, _ in first}
    low, below = M.quantiles(300 * 10 * 0.5 / (100 * 10))
    for i in range(300):
        want = low + sum(b <= u[i] for b in below) if i % 3 < 2 else 0
        assert copies.get(i, 0) == want
    assert all(n == max(1, copies[d]) for d, n, _, _ in first)


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert M.mix(spark.createDataFrame([], schema), {"a": 1.0}).count() == 0
    rows = [(1, None, "a"), (1, None, "a"), (None, "", None), (2, "x" * 100_000, "")]
    got = M.mix(spark.createDataFrame(rows, schema), {}, budget=400_000).groupBy("doc_id", "source").count().collect()
    by = {(r.doc_id, r.source): r["count"] for r in got}
    assert by[(1, "a")] % 2 == 0 and by.get((2, ""), 0) >= 0 and by[(None, None)] > 100_000


def test_the_query_shuffles_whole_copies(spark, tmp_path):
    docs_of(spark, 300).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op3_mix_sources(spark, str(tmp_path))
    assert out.columns == ["doc_id", "source", "copies", "copy", "shuffle_key"]
    written = out._jdf.queryExecution().analyzed().collectLeaves().head().output().mkString(" ")
    assert "text#" in written and "copy_of#" in written and "shuffle_key#" in written
    want = M.mix(docs_of(spark, 300), queries.MIX_WEIGHTS, seed=queries.MIX_SEED).select(*out.columns)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, want.collect()))
