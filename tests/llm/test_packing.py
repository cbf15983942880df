import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillroll.llm.packing import Units, differencing, pack, units_of, windows_of

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "It's we'll '' 's'S don't", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "123 4,5 x²½", "ΑΣ ΑΣ. œuvre",
         "e\u0301 é \u00a0 x\u2003y", "İK ﬁ \u200b x_y", "word, word! " * 4000, "Straße ÀÉ×÷ß", "a\x1cb\x85c", "  \n\t "]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def direct(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers_own(tokenizer):
    got = [np.frombuffer(x, "<u4").tolist() for x in Units(PATH).ids(TEXTS)]
    assert got == [direct(tokenizer, x) for x in TEXTS]
    assert units_of("Ab,c  d1") == ["ab", ",", "c", "d", "1"]


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    import tillroll.llm.packing as P
    monkeypatch.setattr(P, "REMEMBERED", 3)
    units = Units(PATH)
    for text in TEXTS[2:8]:
        assert np.frombuffer(units.ids([text])[0], "<u4").tolist() == direct(tokenizer, text)


def test_round_trip_through_sequences(spark, tokenizer):
    rng = random.Random(5)
    texts = TEXTS + [" ".join(rng.choice(["alpha", "be", "gamma!", "x9"]) for _ in range(rng.randrange(900))) for _ in range(120)]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 0), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    out = pack(docs, PATH).collect()
    sequences = {}
    for r in out:
        assert len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids, r.doc_tokens))
    for i, text in enumerate(texts):
        if i != 3:
            whole = b"".join(x for _, x, _ in sorted(by_doc[i]))
            assert np.frombuffer(whole, "<u4").tolist() == [*direct(tokenizer, text), 1]
            assert {n for *_, n in by_doc[i]} == {len(whole) // 4}
    assert len(by_doc[3]) == 2 and len(by_doc[None]) == 1
    used = sum(r.length for r in out)
    assert used / (2048 * len(sequences)) > 0.93
    assert pack(docs.limit(0), PATH).count() == 0


def test_differencing_is_balanced_and_complete():
    rng = random.Random(1)
    lengths = [rng.randrange(1, 513) for _ in range(900)]
    for windows in (1, 2, 37, 130):
        found = differencing(lengths, windows)
        sums = np.bincount(found, weights=lengths, minlength=windows)
        assert len(found) == 900 and sums.sum() == sum(lengths) and sums.max() - sums.min() < 60
    # the textbook case of two parts: {8, 7, 6, 5, 4} leaves a difference of 2
    sums = np.bincount(differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert sorted(sums) == [14, 16]
    assert differencing([], 3).tolist() == [] and windows_of([2000, 2000, 90, 7]).max() == 2


def plain_differencing(lengths, windows):
    """The textbook form: partitions as lists of (sum, items), merged by the largest spread."""
    parts = [(sorted([(n, [i])] + [(0, [])] * (windows - 1), key=lambda x: -x[0]), i) for i, n in enumerate(lengths)]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        (a, i), (b, j), *rest = parts
        merged = [(x + y, left + right) for (x, left), (y, right) in zip(a, reversed(b))]
        parts = [(sorted(merged, key=lambda x: -x[0]), min(i, j)), *rest]
    return sorted(n for n, _ in parts[0][0]), sorted(i for _, items in parts[0][0] for i in items)


def test_differencing_agrees_with_a_plain_one():
    rng = random.Random(12)
    for _ in range(60):
        lengths, windows = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 9)
        sums, items = plain_differencing(lengths, windows)
        found = differencing(lengths, windows)
        assert items == list(range(len(lengths)))
        assert sorted(np.bincount(found, weights=lengths, minlength=windows).astype(int).tolist()) == sums


def test_another_tokenizer_gets_its_own_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)
    by_doc = {}
    for r in pack(docs, path).collect():
        by_doc.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, text in enumerate(TEXTS):
        assert np.frombuffer(b"".join(x for _, x in sorted(by_doc[i])), "<u4").tolist() == [*direct(other, text), 1]


def test_windows_hold_the_capacity_and_are_few():
    rng = random.Random(8)
    for _ in range(12):
        lengths = [rng.randrange(1, 513) for _ in range(rng.randrange(1, 900))]
        found = windows_of(lengths)
        sums = np.bincount(found, weights=lengths)
        assert len(found) == len(lengths) and sums.max() <= 2048
        least = -(-sum(lengths) // 2048)
        assert least <= found.max() + 1 <= least + 1 + least // 32
