"""License scan: phrases in place, and an exact set-similarity join of text blocks with templates.

Words are runs of letters, digits and non-ASCII characters, A-Z in lower case.

* Base: every place where a phrase's words stand consecutively, found by one pattern per phrase
  that consumes the first word only, so places may overlap.  The numbers of words before the first
  place and after the last one come from what the pattern leaves; no word becomes a row.
* Method: a block is a run of words, wherever lines end: for a template of L words, the runs of 2 L
  words that start at every L-th word, so any L words in a row lie whole in a run.  A block meets
  a template if it holds at least ``THRESHOLD`` of the template's distinct words.  All template words
  are ordered by the number of texts that hold them, rarest first.  A block can only meet a
  template of size n, of which it must hold a words, if

  - prefix: it holds one of the template's n - a + 1 rarest words;
  - length: it holds at least a template words;
  - position: after a common word at places i and j there are enough words left on both sides.

  Only runs around a prefix word become blocks; those that pass all three filters are counted exactly.
  The templates are a fixed list, so their index is broadcast; the texts are never shuffled, only a
  row per labelled document is.

Only built-in functions are used.  Each text is read twice: once for the base and to count the template
words, and, once their order is known, for the blocks.

Defined cases: null and empty texts have no words and no labels, with null places and score 0; texts
of any length are scanned whole, and words scattered over more than two lengths of a template do not meet
it; repeated rows are answered one by one; an empty table gives an empty result; other columns, of
whatever name, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.support import ROW, cut, numbered, text_of

#: Characters outside words, before A-Z are lowered.
OUTSIDE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
THRESHOLD = 0.9
#: Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Sentences and notices by which texts state a license, with the label of each.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met redistributions of source code must retain the above copyright notice this list of "
            "conditions and the following disclaimer"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
                 "with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
)


def n_words(text: Column) -> Column:
    """Number of words: each, with what surrounds it, becomes one letter."""
    marks = F.regexp_replace(text, f"[{OUTSIDE}]*+[^{OUTSIDE}]++[{OUTSIDE}]*+", "x")
    return F.when(text.rlike(f"[^{OUTSIDE}]"), F.length(marks)).otherwise(0).cast("long")


def phrase_pattern(phrase: str) -> str:
    """Matches the phrase's first word where the others follow; A-Z and a-z are alike."""
    first, *others = phrase.split()
    ahead = "".join(f"[{OUTSIDE}]+(?i:{word})" for word in others)
    return f"(?<![^{OUTSIDE}])(?i:{first})(?={ahead}(?![^{OUTSIDE}]))"


def _base(phrases: Mapping[str, str]) -> dict[str, Column]:
    """n_base, first_word, last_word and base (labels) from ``t``, ``small`` and the arrays of ``_split``."""
    names = [f"_p{i}" for i in range(len(phrases))]
    places = {name: F.coalesce(F.size(name) - 1, F.lit(0)) for name in names}
    first = [F.when(places[x] > 0, n_words(F.element_at(x, 1))) for x in names]
    last = [F.when(places[x] > 0, F.col("n_words") - 1 - n_words(F.element_at(x, -1))) for x in names]
    labels = [F.when(places[x] > 0, F.lit(y)) for x, y in zip(names, phrases.values())]
    return {"n_base": sum(places.values(), F.lit(0)).cast("long"), "first_word": F.array_min(F.array(*first)),
            "last_word": F.array_max(F.array(*last)), "base": F.array_distinct(F.array_compact(F.array(*labels)))}


def _split(phrases: Mapping[str, str]) -> dict[str, Column]:
    """The text around each phrase's places; null where the text does not hold all of its words."""
    def around(phrase: str) -> Column:
        holds = [F.col("small").contains(word) for word in phrase.split()]
        there = holds[0]
        for x in holds[1:]:
            there = there & x
        return F.when(there, F.split("t", phrase_pattern(phrase), -1))

    return {f"_p{i}": around(phrase) for i, phrase in enumerate(phrases)}


def words_of(text: Column) -> Column:
    """All words, in order; ``text`` is in lower case."""
    return F.filter(F.split(text, f"[{OUTSIDE}]+"), lambda w: w != "")


def lowered(rows: DataFrame) -> DataFrame:
    """``rows`` with small, ``t`` in lower case."""
    # the Kelvin sign is the only other character whose small letter is in a-z
    return rows.withColumn("small", F.lower(F.replace(F.col("t"), F.lit("\u212a"), F.lit("\ufffd"))))


def facts_of(rows: DataFrame, phrases: Mapping[str, str], vocabulary: Sequence[str]) -> DataFrame:
    """What one reading of each text gives: _row, id, n_words, the base columns, and ``hits`` (its template words)."""
    read = lowered(rows).withColumns({"words": words_of(F.col("small"))} | _split(phrases))
    read = read.withColumn("n_words", F.size("words").cast("long"))
    return read.select("_row", "id", "n_words", *[x.alias(name) for name, x in _base(phrases).items()],
                       F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary])).alias("hits"))


def blocks_of(rows: DataFrame, prefixes: Mapping[str, Sequence[int]], rank: Mapping[str, int]) -> DataFrame:
    """_row, length, run and own (the ranks of its template words, in order) of the runs around prefix words.

    ``prefixes``: the lengths of the templates that have the word as a prefix word.
    """
    lengths_of = F.create_map(*[x for w, sizes in prefixes.items() for x in (F.lit(w), F.array(*[F.lit(n) for n in sizes]))])
    rank_of = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    seeds = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("at"), F.element_at(lengths_of, w).alias("lengths"))),
                     lambda x: x["lengths"].isNotNull())
    runs = F.flatten(F.transform("seeds", lambda x: F.flatten(F.transform(x["lengths"], lambda n: F.filter(F.array(
        F.struct(n.alias("length"), F.call_function("div", x["at"], n).alias("run")),
        F.struct(n.alias("length"), (F.call_function("div", x["at"], n) - 1).alias("run"))), lambda r: r["run"] >= 0)))))
    held = lowered(rows).select("_row", words_of(F.col("small")).alias("words")).where(
        F.arrays_overlap("words", F.array(*[F.lit(w) for w in prefixes])))
    found = held.withColumn("seeds", seeds).withColumn("runs", F.array_distinct(runs))
    per_run = F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), r["run"].alias("run"),
        F.slice("words", r["run"].cast("int") * r["length"] + 1, r["length"] * 2).alias("part")))
    parts = found.select("_row", F.explode(per_run).alias("x")).select("_row", "x.length", "x.run", "x.part")
    own = F.array_sort(F.array_distinct(F.filter(F.transform("part", lambda w: F.element_at(rank_of, w)), lambda x: x.isNotNull())))
    return parts.select("_row", "length", "run", own.alias("own"))


def matches(rows: DataFrame, facts: DataFrame, sets: Sequence[tuple[str, int, frozenset[str]]], vocabulary: Sequence[str],
            threshold: float) -> DataFrame:
    """_row, label and containment of every block that meets a template."""
    spark = facts.sparkSession
    counts = facts.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = {row["word"]: row["n"] for row in counts.collect()}  # a row per template word at most
    rank = {w: at for at, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    index, prefixes = [], {}
    for number, (label, length, words) in enumerate(sets):
        need = needed(len(words), threshold)
        rarest = sorted(words, key=rank.__getitem__)
        ranks = [rank[w] for w in rarest]
        for i, w in enumerate(rarest[:len(words) - need + 1]):
            index.append((ranks[i], length, number, label, i, len(words), need, ranks))
            prefixes.setdefault(w, set()).add(length)
    listed = spark.createDataFrame(index, "rank int, size int, template int, label string, i int, n int, need int, ranks array<int>")
    blocks = blocks_of(rows, {w: sorted(x) for w, x in prefixes.items()}, rank)
    shared = blocks.select("_row", "length", "run", "own", F.posexplode("own").alias("j", "rank")).withColumnRenamed("rank", "r").join(
        F.broadcast(listed), (F.col("r") == F.col("rank")) & (F.col("length") == F.col("size")))
    left = F.least(F.col("n") - F.col("i"), F.size("own") - F.col("j"))
    found = shared.where((F.size("own") >= F.col("need")) & (left >= F.col("need"))).withColumn(
        "overlap", F.size(F.array_intersect("own", "ranks"))).where(F.col("overlap") >= F.col("need"))
    return found.select("_row", "label", (F.col("overlap") / F.col("n")).alias("containment")).distinct()


def needed(size: int, threshold: float) -> int:
    """Words that a block must share with a template of ``size`` words."""
    return math.ceil(threshold * size)


def license_scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES,
                 threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest containment met; a base phrase counts 1.
    """
    sets = [(label, len(text.split()), frozenset(text.split())) for label, text in templates]
    vocabulary = sorted(frozenset().union(*[words for *_, words in sets]))
    rows = numbered(docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))).withColumnRenamed(ROW, "_row")
    facts = cut(facts_of(rows, phrases, vocabulary))
    met = matches(rows, facts, sets, vocabulary, threshold).groupBy("_row").agg(
        F.collect_set("label").alias("met"), F.max("containment").alias("most"))
    all_labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return facts.join(met, "_row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(all_labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))
