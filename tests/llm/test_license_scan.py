import math
import re

from tillroll.llm import license_scan as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(doc, text, phrases=S.PHRASES, templates=S.TEMPLATES, threshold=S.THRESHOLD):
    text = (text or "").translate(LOWER)
    words, places, base = WORD.findall(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        at = [i for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    best, met = 0.0, set(base)
    for label, template in templates:
        size, t = len(template.split()), set(template.split())
        for at in range(0, len(words), size):
            n = len(t & set(words[at:at + 2 * size]))
            if n >= math.ceil(threshold * len(t)):
                met.add(label)
                best = max(best, n / len(t))
    return (doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(met)), 1.0 if places else best)


TEXTS = [None, "", "?!\n--", "Released under the MIT License.", "x under THE mit\nlicense y", "under the mit licenses", "munder the mit license",
         "under the mit license under_the-mit...license", "Apache License, Version 2.0", "APACHE LICENSE VERSION 22", "cc by nc cc by nc cc", "CC-BY-NC 4.0",
         "Licensed under CC BY-NC 4.0.", "This worK is licensed under the GNU General Public License, version 3.", "This worK is licensed under the GNU General Public License",
         "Redistribution and use in source and binary forms, with or without modification, are permitted", "é under é the mit license 😀 cc by nc",
         "word " * 100_000 + "under the mit license", "license mit the under released\nlicensed by nc cc", "a\r\nCC BY\tNC\r\n\r\n" * 3,
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this", "by nc cc", "under\x00the\x7fmit@license"]


def test_against_brute_force(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], ""), (None, TEXTS[7], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").coalesce(1)
    got = sorted(repr(tuple(r)) for r in S.license_scan(docs).collect())
    assert got == sorted(repr(brute(i, t)) for i, t, _ in rows)
    assert S.license_scan(docs.limit(0)).count() == 0


def test_overlapping_places_and_low_thresholds(spark):
    phrases = {"a b a": "aba", "b a b": "bab"}
    templates = (("t", "one two three four five"), ("u", "five six seven"))
    texts = ["a b a b a", "A-B-A", "one two\nthree four five", "six one x two five", "seven five", "four three two y one six seven"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for threshold in (0.4, 0.6, 1.0):
        got = sorted(repr(tuple(r)) for r in S.license_scan(docs, phrases, templates, threshold).collect())
        assert got == sorted(repr(brute(i, t, phrases, templates, threshold)) for i, t in enumerate(texts))


def test_no_python_runs(spark):
    docs = spark.createDataFrame([(1, "cc by nc")], "doc_id long, text string")
    plan = S.license_scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions are met:
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer."""


def test_wrapped_notices_and_scattered_words(spark):
    filler = "some other words of no license at all "
    scattered = "x " * 2000 + "licensed " + "y " * 2000 + "under " + "z " * 2000 + "cc " + "q " * 2000 + "by " + "r " * 2000 + "sa"
    texts = [MIT, BSD, filler * 50 + MIT + filler * 50, "\n".join(MIT.split()), MIT[:200], BSD[:140], scattered, filler * 3000,
             "licensed\nunder\ncc\nby\nsa", (filler + MIT + "\n") * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in S.license_scan(docs).collect()}
    assert sorted(repr(tuple(r)) for r in got.values()) == sorted(repr(brute(i, t)) for i, t in enumerate(texts))
    assert [got[i].labels for i in range(10)] == ["mit", "bsd", "mit", "mit", "mit", "bsd", "", "", "cc-by-sa", "mit"]


def test_random_texts_of_template_words(spark):
    import random
    rng = random.Random(8)
    words = sorted({w for _, t in S.TEMPLATES for w in t.split()}) + ["x", "y", "z"]
    runs = [t.split() for _, t in S.TEMPLATES]
    texts = []
    for _ in range(60):
        out = []
        for _ in range(rng.randrange(1, 12)):
            run = rng.choice(runs)
            a = rng.randrange(len(run))
            out += [w for w in run[a:a + rng.randrange(1, 60)] if rng.random() < 0.97] if rng.random() < .6 else rng.choices(words, k=rng.randrange(40))
        texts.append(rng.choice([" ", "\n", ", "]).join(out))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for threshold in (0.7, 0.9):
        got = sorted(repr(tuple(r)) for r in S.license_scan(docs, threshold=threshold).collect())
        assert got == sorted(repr(brute(i, t, threshold=threshold)) for i, t in enumerate(texts))
