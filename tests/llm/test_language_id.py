import pytest
from pyspark.sql import functions as F

from tillroll.llm import language_id as L


def test_held_out_accuracy_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = L.predict(docs).where("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score"), F.max("score"),
        F.avg(F.col("rejected").cast("double")).alias("rejected"), F.count("*").alias("n")).first()
    assert out.n > 150 and out.right >= 0.96 and out.rejected <= 0.02
    assert 0 <= out[1] and out[2] <= 1


@pytest.fixture(scope="module")
def taught(spark):
    words = {"en": "the and of with thing there", "de": "der die und nicht schön über"}
    rows = [(i, " ".join((w + " ").split() * 40), lang, "x") for i, (lang, w) in enumerate([*words.items()] * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_edges(spark, taught):
    odd = spark.createDataFrame([(1000, None, None, ""), (1001, "", "en", ""), (1002, "12 34 !!", "de", ""), (1003, "DER und nicht " * 30_000, None, ""),
                                 (None, "the thing there and with the thing", "en", ""), (1003, "DER und nicht " * 30_000, None, "")],
                                "doc_id long, text string, lang string, score string")
    out = L.predict(taught.unionByName(odd)).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.lang_pred, r.rejected, r.held_out))
    assert len(out) == 66
    for i in (1000, 1001, 1002):
        assert by[i][0][:2] == ("und", True)
    assert [x[:2] for x in by[1003]] == [("de", False)] * 2 and by[None] == [("en", False, True)]
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "score", "held_out", "lang_pred", "rejected"}


def test_nothing_one_language_and_ties(spark, taught):
    none = L.predict(taught.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = L.predict(taught.where("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in one.select("lang_pred", "score").collect()} == {("de", 1.0)}
    assert L.predict(taught.limit(0)).count() == 0
    encoders = {x: L.Encoder(b"same words in both " * 500) for x in ("bb", "aa")}
    assert L.answer("same words", encoders, L.MARGIN) == ("bb", 0.0, True)


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "concat(md5(string(id)), repeat(' word', 900)) AS text", "'xx' AS lang")
    (lang, sample), = L.fit(docs)
    assert lang == "xx" and len(sample) == L.DICTIONARY + L.CONTEXTS * L.CONTEXT


def test_copies_do_not_thin_the_sample(spark):
    from tillroll.llm import language_id
    docs = spark.range(102_000).selectExpr("IF(id < 100000, 'copied line', concat('own line ', id)) AS text", "'xx' AS lang")
    (lang, sample), = language_id.fit(docs)
    lines = sample.decode().split("\n")
    assert lang == "xx" and len(lines) == len(set(lines)) == language_id.SAMPLE_DOCS


def plain(taught, asked, margin=L.MARGIN):
    """The whole operator anew: samples chosen in Python, whole texts encoded with dictionaries that are loaded as they are."""
    import unicodedata
    import zlib
    from collections import defaultdict

    import zstandard

    def spells(text):
        return any(unicodedata.category(c).startswith("L") for c in text)

    texts, counts = defaultdict(set), defaultdict(int)
    for doc, text, lang in taught:
        if doc is not None and zlib.crc32(str(doc).encode()) % 5 and lang is not None and text is not None and spells(text):
            texts[lang].add((zlib.crc32(f"{lang}/{text}".encode()), text[:1500]))
            counts[lang] += 1
    settings = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **L.SEARCH)
    tools = []
    for lang in sorted(texts, key=lambda x: (-counts[x], x)):
        sample = "\n".join(t.lower() for _, t in sorted(texts[lang])[:300]).encode()[:72 * 1024]
        tail = max(0, min(8192, len(sample) - 1024))
        cut = len(sample) - tail
        book = zstandard.ZstdCompressionDict(sample[:cut][:65536], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(compression_params=settings)
        size = lambda data, book=book: len(zstandard.ZstdCompressor(dict_data=book, compression_params=settings).compress(data))
        tools.append((lang, size, [sample[i:i + 1024] for i in range(cut, len(sample), 1024)] or [b""]))
    out = []
    for doc, text in asked:
        if text is None or not tools or not spells(text):
            out.append((doc, "und", 0.0, True))
            continue
        data = text.lower().encode()
        if len(data) <= 256:
            sizes = [sum(size(x + b" " + data) - size(x) for x in contexts) for _, size, contexts in tools]
        else:
            sizes = [sum(size(data[i:i + 32768]) for i in range(0, len(data), 32768)) for _, size, _ in tools]
        order = sorted(range(len(tools)), key=lambda k: (max(1, sizes[k]), k))
        score = 1 - max(1, sizes[order[0]]) / max(1, sizes[order[1]])
        out.append((doc, tools[order[0]][0], score, score < margin))
    return out


def test_every_answer_equals_a_plain_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9000 + i, t, None) for i, t in enumerate([None, "", "½ ²", "Ⅷ", "①", "12 !?", "ª", "é", "the", "x" * 40_000, "日本語", "_"])]
    every = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows = [tuple(r) for r in every.collect()]
    got = {r.doc_id: (r.lang_pred, round(r.score, 12), r.rejected) for r in L.predict(every).collect()}
    assert got == {doc: (lang, round(score, 12), gone) for doc, lang, score, gone in plain(rows, [r[:2] for r in rows])}
    assert [got[9000 + i][0] for i in range(6)] == ["und"] * 6 and got[9006][0] != "und"


def test_rare_languages_beyond_the_bound_are_not_learned(spark, taught, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGS", 1)
    assert {r.lang_pred for r in L.predict(taught.where("doc_id <> 1")).collect()} == {"en"}
