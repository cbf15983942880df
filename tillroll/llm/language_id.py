"""Language identification by compression with per-language zstandard dictionaries.

For every language a raw-content dictionary is cut from a bounded sample of labelled texts.  A
text is encoded with each dictionary, and the language with the smallest encoding wins.  The score
is the saving against the runner-up, from 0 to 1; narrow margins are rejected.

* Sample: ``SAMPLE_DOCS`` distinct texts per language at most (those with the smallest hash), however
  often they are repeated, ``EXCERPT`` code points of each.  The first of them yield ``DICTIONARY`` bytes of dictionary and
  ``CONTEXTS`` contexts of ``CONTEXT`` bytes: 72 KB, which about 49 full excerpts fill.  Of more than
  ``MOST_LANGS`` languages, the rarest are not learned and never answered.  These bounds are parameters of
  the fit alone: every prediction reads the whole text.
* A text of over ``BLOCK`` bytes is encoded in blocks, so the dictionary is at work everywhere.
* A text of up to ``SHORT`` bytes is too small for zstandard to shorten.  It is appended to each
  context, and the growth of the encodings is summed.

Defined cases: null texts and texts without a letter get ``und`` and score 0 and are rejected;
ties go to the language with more training documents, then by name, with score 0; a null language
teaches nothing; with no labelled text at all every answer is ``und``; with one language there is
no runner-up and the score is 1; equal texts get equal answers; other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tillroll.llm.support import OWN, cut, small_batches

SAMPLE_DOCS, EXCERPT = 300, 1500
DICTIONARY, CONTEXTS, CONTEXT = 64 * 1024, 8, 1024
BLOCK, SHORT = 32 * 1024, 256
#: Languages that are learned: those with most labelled texts.  With the bytes above, the samples have 29 MB at most.
MOST_LANGS = 400
#: Smaller savings than this against the runner-up are rejected.
MARGIN = 0.002
#: Greedy matching from four bytes on: as good as the slower levels on prose, and twice as fast.
SEARCH = dict(window_log=17, chain_log=15, hash_log=15, search_log=4, min_match=4, strategy=zstandard.STRATEGY_GREEDY)
ANSWER, ANSWER_COL = "lang_pred string, score double, rejected boolean", f"{OWN}answer"


class Encoder:
    """The sizes of a text's encoding with one language's dictionary."""

    def __init__(self, sample: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters(
            write_content_size=False, write_checksum=False, write_dict_id=False, **SEARCH)
        contexts = max(0, min(CONTEXTS * CONTEXT, len(sample) - 1024))
        dictionary = zstandard.ZstdCompressionDict(
            sample[: len(sample) - contexts][:DICTIONARY], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=settings)
        self.encode = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress
        tail = sample[len(sample) - contexts:]
        self.contexts = [tail[i:i + CONTEXT] for i in range(0, len(tail), CONTEXT)] or [b""]
        self.alone = [len(self.encode(x)) for x in self.contexts]

    def size(self, text: bytes) -> int:
        if len(text) <= SHORT:
            return sum(len(self.encode(x + b" " + text)) - n for x, n in zip(self.contexts, self.alone))
        return sum(len(self.encode(text[i:i + BLOCK])) for i in range(0, len(text), BLOCK))


def has_letter(text: str) -> bool:
    """Whether a character is a letter (Unicode's L categories; number signs such as a Roman numeral sign are none)."""
    return any(map(str.isalpha, text))


def answer(text: str | None, encoders: dict[str, Encoder], margin: float) -> tuple[str, float, bool]:
    if text is None or not encoders or not has_letter(text):
        return "und", 0.0, True
    if len(encoders) == 1:
        return next(iter(encoders)), 1.0, False
    data = text.lower().encode("utf-8", "replace")
    sizes = {lang: max(1, encoder.size(data)) for lang, encoder in encoders.items()}
    first, second = sorted(sizes, key=sizes.__getitem__)[:2]  # stable: ties keep the order of the samples
    score = 1.0 - sizes[first] / sizes[second]
    return first, score, score < margin


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> list[tuple[str, bytes]]:
    """(language, sample), the most frequent language first; bounded by the parameters above."""
    known = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).where(
        F.col("lang").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64("t")).alias("texts"))
    counts = F.broadcast(cut(counts.orderBy(F.desc("n"), "lang").limit(MOST_LANGS)))
    # thin first: only about four times the wanted texts of a language are ranked; copies have one mark, so
    # distinct texts are counted (an estimate does: the smallest marks pass, whatever its few percent)
    mark = F.crc32(F.concat_ws("/", "lang", "t")).cast("double") / F.lit(float(1 << 32))
    thin = (known.withColumn("mark", mark).join(counts, "lang")
            .where(F.col("mark") * F.col("texts") <= 4 * SAMPLE_DOCS)
            .select("lang", "n", "mark", F.substring("t", 1, EXCERPT).alias("t")).distinct())
    order = W.partitionBy("lang").orderBy("mark", "t")
    chosen = thin.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_DOCS)
    samples = {}
    for row in chosen.orderBy(F.desc("n"), "lang", "place").toLocalIterator():
        samples.setdefault(row["lang"], []).append(row["t"].lower())
    most = DICTIONARY + CONTEXTS * CONTEXT
    return [(lang, "\n".join(texts).encode("utf-8", "replace")[:most]) for lang, texts in samples.items()]


def identify(docs: DataFrame, samples: list[tuple[str, bytes]], margin: float = MARGIN,
             text_col: str = "text") -> Column:
    """Struct column: lang_pred, score, rejected."""
    small_batches(docs.sparkSession, 250)
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    @F.pandas_udf(ANSWER)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoders = {lang: Encoder(sample) for lang, sample in shared.value}
        for batch in batches:
            yield pd.DataFrame([answer(x, encoders, margin) for x in batch],
                               columns=["lang_pred", "score", "rejected"])

    return judge(text_col)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of the documents that teaches nothing."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def predict(docs: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", lang_col: str = "lang",
            text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, lang_pred, score and rejected (in place of columns with these names),
    learned from the other four fifths.

    A null id is in no fold: it teaches nothing and counts as held out.
    """
    new = ("held_out", "lang_pred", "score", "rejected")
    judged = _judged(docs, margin, id_col, lang_col, text_col)
    return judged.select(*[c for c in docs.columns if c not in new], _in_no_fold(id_col).alias("held_out"), f"{ANSWER_COL}.*")


def drop_unclear(docs: DataFrame, margin: float = MARGIN, id_col: str = "doc_id", lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is clear, with the columns of ``docs`` alone."""
    return _judged(docs, margin, id_col, lang_col, text_col).where(~F.col(f"{ANSWER_COL}.rejected")).select(*docs.columns)


def _judged(docs: DataFrame, margin: float, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    samples = fit(docs.where(~_in_no_fold(id_col)), lang_col, text_col)
    return docs.withColumn(ANSWER_COL, identify(docs, samples, margin, text_col))


def _in_no_fold(id_col: str) -> Column:
    return F.coalesce(held_out(id_col), F.lit(True))
