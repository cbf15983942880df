import random

import pytest
from pyspark.sql import functions as F

from tillroll.llm import exact_dedup, minhash_dedup, support, url_filter

PARALLELISM = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def written(spark, tmp_path):
    """20 files of different lengths; every text is there twice; files are cut by parallelism alone."""
    own = {"spark.sql.files.openCostInBytes": "1", PARALLELISM: "1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    draw = random.Random(3)
    words = [" ".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=30)) for _ in range(200)]
    rows = [(i, words[i % 200], f"http://h{i % 200}.org/{i}") for i in range(400)]
    part = F.least(F.lit(19), F.sqrt(F.col("doc_id")).cast("int"))
    spark.createDataFrame(rows, "doc_id long, text string, url string").repartitionByRange(20, part).write.parquet(f"{tmp_path}/docs")
    yield spark.read.parquet(f"{tmp_path}/docs")
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_at(df, n):
    df.sparkSession.conf.set(PARALLELISM, str(n))
    return df


def test_numbers_are_the_same_however_files_are_cut(written):
    reads = []
    for n in (1, 3, 16):
        out = support.numbered(read_at(written, n))
        reads.append({r.doc_id: r[support.ROW] for r in out.select("doc_id", support.ROW).collect()})
    assert reads[0] == reads[1] == reads[2] and len(set(reads[0].values())) == 400
    filtered = support.numbered(written.where("doc_id % 7 = 3").select("doc_id"))
    assert {r.doc_id: r[support.ROW] for r in filtered.collect()} == {k: v for k, v in reads[0].items() if k % 7 == 3}


def test_other_tables_are_numbered_once(written):
    twice = written.unionByName(written)
    out = support.numbered(twice)
    first, second = ([tuple(r) for r in read_at(out, n).orderBy(support.ROW).collect()] for n in (1, 16))
    assert first == second and len({r[-1] for r in first}) == 800
    assert support.numbered(out) is out
    exploded = support.numbered(written.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("x")))
    assert exploded.select(support.ROW).distinct().count() == 800


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_copies, minhash_dedup.drop_near_copies])
def test_dropping_holds_when_the_cluster_changes_between_reads(written, drop):
    left = drop(read_at(written, 1))
    got = [r.text for r in read_at(left, 16).collect()]
    assert len(got) == len(set(got)) == 200


def test_verdicts_hold_when_the_cluster_changes_between_reads(written):
    rules = [(f"h{i}.org", "/", "block") for i in range(0, 200, 2)]
    judged = url_filter.judge(read_at(written, 1), rules, written.limit(0), id_col="doc_id")
    got = {r.doc_id: r.verdict for r in read_at(judged, 16).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(400)}
