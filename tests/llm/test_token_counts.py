import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tillroll.llm.packing import Units
from tillroll.llm.token_counts import Lengths, count_tokens, frequent_lengths, frequent_units, trimmed
from tillroll.llm.workers import Recent, kept

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "It's we'll '' 's'S don't", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "123 4,5 x²½", "ΑΣ ΑΣ. œuvre",
         "é é   x y", "İK ﬁ ​ x_y", "word, word! " * 4000, "Straße ÀÉ×÷ß", "a\x1cb\x85c", "  \n\t ",
         "x" * 70_000, "日本語 " * 300, "rare" + "ness" * 40]
SCHEMA = "doc_id long, text string, n_bytes int, n_tokens int, t int"


def library(path):
    if path.endswith(".model"):
        return SentencePieceProcessor(model_file=path).encode
    tokenizer = Tokenizer.from_file(path)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows, path, limit=2048):
    encode = library(path)
    return sorted(((i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > limit) for i, t in rows), key=repr)


def got(df, path, **settings):
    out = count_tokens(df, path, **settings)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["the", "of", "quick", "l'été", "don't", "x9", "(a)", "zymurgy", "!!"]
    made = [" ".join(rng.choice(words) + ("%d" % rng.randrange(3) if rng.random() < .2 else "") for _ in range(rng.randrange(700)))
            for _ in range(150)]
    texts = TEXTS + made + ["the same copy of a text"] * 90
    return [(i, t) for i, t in enumerate(texts)] + [(5, TEXTS[5]), (None, "null id"), ((1 << 62) + 1, "large id")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys_own(spark, rows, name):
    path = public_tokenizers.path(name)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    assert got(df, path) == expected(rows, path)
    assert got(df.limit(0), path) == []


def test_tiers_change_the_speed_alone(spark, rows, monkeypatch):
    import tillroll.llm.token_counts as T
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(2)
    monkeypatch.setattr(T, "REMEMBERED", 4)
    for tracked in (1, 5):
        assert got(df, PATH, tracked=tracked, limit=10) == expected(rows, PATH, limit=10)


def test_first_tier_holds_what_is_frequent(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.unit: r.n for r in frequent_units(df, tracked=50).collect()}
    assert found["word"] >= 7000 and all(n <= 16_000 for n in found.values()) and len(max(found, key=len)) <= 64
    names, lengths = frequent_lengths(df, PATH, tracked=12)
    assert len(names.split("\n")) == len(lengths) // 2 <= 12 and "word" in names.split("\n")
    # by the library's count of each text; units that the table lacks come from the worker's memory
    tiers = Lengths(PATH, (names, lengths))
    assert tiers.counts(TEXTS) == [n for _, _, n, _ in (expected([(0, t)], PATH)[0] for t in TEXTS)]
    assert "zebra" not in tiers and tiers.counts(["zebra"]) == [1] and "zebra" in tiers.rest


def test_misra_gries_trim():
    from collections import Counter
    counts = Counter({f"u{i}": i + 1 for i in range(20)})
    left, lower = trimmed(counts, 5)
    assert len(left) <= 5 and left["u19"] == 5 and lower == 15 and trimmed(counts, 20) == (counts, 0)


def test_worker_memory_is_bounded_and_versioned():
    assert kept("a", lambda: [1]) is kept("a", lambda: [2])
    assert kept("a", lambda: [3], version=2) == [3] and kept("a", lambda: [4]) == [4]
    memory = Recent(8)
    for i in range(100):
        keys = {i, i + 1, 0}
        memory.update((k, -k) for k in memory.unknown(keys))
        assert [memory[k] for k in keys] == [-k for k in keys] and len(memory) <= 7 and len(memory.older) <= 7
    units = Units(PATH)
    assert units.by_unit and not Units(public_tokenizers.path("byte_bpe_50k.json")).by_unit
