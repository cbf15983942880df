"""The pipeline's stages, each on its predecessor's output, against brute force."""

import re
from pathlib import Path
from urllib.parse import urlsplit

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_minhash_dedup import brute as near_brute
from tokenizers import Tokenizer

from tillroll.llm import language_id, mixing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    assert [name for name, _ in P.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, []
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        stages.append(docs)
        assert name == "packing" or docs.columns == columns
    language, exact, near, mixed, packed = stages
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    # language: the encoders themselves, text by text
    train = spark.read.parquet(f"{SF}/documents.parquet").where(~language_id.held_out())
    encoders = {lang: language_id.Encoder(sample) for lang, sample in language_id.fit(train)}
    kept = [r for r in rows if not language_id.answer(r[1], encoders, language_id.MARGIN)[2]]
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in language.collect())
    assert len(kept) > 0.97 * len(rows)
    # exact copies
    best = {}
    for r in kept:
        key = re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")
        if key not in best or (-len(r[1]), r[0]) < (-len(best[key][1]), best[key][0]):
            best[key] = r
    assert sorted(map(repr, best.values())) == sorted(repr(tuple(r)) for r in exact.collect())
    # near copies
    stay = {eval(x)[0] for x in near_brute([(r[0], r[1]) for r in best.values()], 5) if eval(x)[3]}
    assert sorted(repr(r) for r in best.values() if r[0] in stay) == sorted(repr(tuple(r)) for r in near.collect())
    # mixing: the copies of each document, from the sources' sizes
    left = [r for r in best.values() if r[0] in stay]
    sizes = {}
    for r in left:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1]) + 1
    stated = {s: w for s, w in P.MIX_WEIGHTS.items() if s in sizes}
    rest = (1 - sum(stated.values())) / (len(sizes) - len(stated))
    u = {r.doc_id: r.u for r in near.select("doc_id", mixing.uniform(P.MIX_SEED, "doc_id").alias("u")).collect()}
    want = []
    for r in left:
        low, below = mixing.quantiles(stated.get(r[3], rest) * sum(sizes.values()) / sizes[r[3]])
        want += [repr(r)] * (low + sum(b <= u[r[0]] for b in below))
    assert sorted(want) == sorted(repr(tuple(r)) for r in mixed.collect())
    # packing: every copy's ids once
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r[0]: r[1] for r in rows}
    ids = {}
    total = {}
    for r in packed.collect():
        ids.setdefault(r.doc_id, set()).add((r.start, bytes(r.ids)))
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    copies = {}
    for r in mixed.select("doc_id").collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(ids) == set(copies)
    for doc, n in copies.items():
        whole = np.frombuffer(b"".join(x for _, x in sorted(ids[doc])), "<u4").tolist()
        assert whole == [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert total[doc] == n * len(whole)


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, SF)
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    # the tables of the earlier stages are gone
    last = Path(urlsplit(out.inputFiles()[0]).path).parent
    assert [x.name for x in last.parent.iterdir()] == [last.name] == ["4-packing"]


def test_stages_take_empty_tables_nulls_and_more_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, text_sha256 string, copies int"
    rows = [(1, None, None, None, None, "", 1), (2, "the and of the thing " * 20, "en", "a", 1, "", 2), (2, "the and of the thing " * 20, "en", "a", 1, "", 2),
            (3, "", "en", None, 0, "", 3)]
    for i, data in enumerate(([], rows)):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{i}-{name}")
            stage(spark, docs, "").write.parquet(path)
            docs = spark.read.parquet(path)
