"""Dirty-text clean-up: fake nulls, numbers with units, comma lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of "no value" that arrive as text in raw tables.
FAKE_NULLS = ("null", "NaN")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_fake_null(c: str | Column, sentinels: Iterable[str] = FAKE_NULLS,
                 blank: bool = False) -> Column:
    """True when the value is SQL NULL, one of ``sentinels`` or (optionally) ''."""
    c = _col(c)
    values = list(sentinels) + ([""] if blank else [])
    cond = c.isNull()
    if values:
        cond = cond | c.isin(values)
    return cond


def replace_fake_null(c: str | Column, replacement: str | None,
                      sentinels: Iterable[str] = FAKE_NULLS, blank: bool = False) -> Column:
    """Map SQL NULL and text sentinels to one replacement ('' or NULL)."""
    c = _col(c)
    repl = F.lit(replacement) if replacement is not None else F.lit(None).cast("string")
    return F.when(is_fake_null(c, sentinels, blank), repl).otherwise(c)


# Numbers read from text: room for 18 digits before and 6 after the point.
MEASURE_PRECISION, MEASURE_SCALE = 24, 6


def parse_measure(c: str | Column, precision: int = MEASURE_PRECISION, scale: int = MEASURE_SCALE,
                  mode: str = "digits", unit: str = "km") -> Column:
    """Turn text such as '13.4km', '20 mins' or 'null' into decimal(precision, scale).

    ``mode``:
      - ``digits``: keep digits and dots only, '' -> NULL, then cast (the main parser);
      - ``replace``: drop the unit text, 'null' -> NULL, then cast;
      - ``left``: keep the characters of the leading number, however long it is, then cast.
    Unparseable text becomes NULL (``try_cast``), so a stray '1.2.3' cannot fail a job;
    ``operators.quality.parse_counts`` counts such values.
    """
    c = _col(c)
    dtype = f"decimal({precision},{scale})"
    if mode == "digits":
        text = F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit(""))
    elif mode == "replace":
        text = F.when(c == "null", F.lit(None).cast("string")).otherwise(F.replace(c, F.lit(unit), F.lit("")))
    elif mode == "left":
        text = F.nullif(F.left(c, F.length(F.regexp_extract(c, r"^\s*[0-9.]*", 0))), F.lit(""))
    else:
        raise ValueError(f"unknown parse mode {mode!r}")
    return F.trim(text).try_cast(dtype)


def parse_timestamp(c: str | Column, sentinels: Iterable[str] = FAKE_NULLS) -> Column:
    """Text timestamp -> timestamp_ntz; sentinels and bad text -> NULL."""
    return replace_fake_null(c, None, sentinels, blank=True).try_cast("timestamp_ntz")


def split_list(c: str | Column, sep: str = ",", element_type: str | None = "int") -> Column:
    """'1, 5' -> [1, 5].  '' and NULL give an empty array (no element).  Blanks
    around the separators and at the ends are dropped (the separator is matched
    with the blanks around it), and the whole array is cast at once -- no
    per-element lambda."""
    c = _col(c)
    pattern = r"\s*" + re.escape(sep) + r"\s*"
    parts = F.split(F.trim(c), pattern)
    if element_type:
        parts = parts.try_cast(f"array<{element_type}>")
    empty = F.array().cast(f"array<{element_type or 'string'}>")
    return F.when(c.isNull() | (F.trim(c) == ""), empty).otherwise(parts)


def list_is_bad(c: str | Column, sep: str = ",", element_type: str = "int") -> Column:
    """True if an entry of the list cannot be read as ``element_type`` (an empty entry included)."""
    entries = split_list(c, sep, None)
    return F.exists(entries, lambda x: x.try_cast(element_type).isNull())


def clean_sentinels(df: DataFrame, rules: dict[str, tuple[Iterable[str], str | None]],
                    blank: bool = False) -> DataFrame:
    """Apply ``replace_fake_null`` to several columns at once:
    ``{"extras": (("null", "NaN"), ""), "cancellation": (("null", "NaN"), None)}``."""
    out = df
    for col, (sentinels, replacement) in rules.items():
        out = out.withColumn(col, replace_fake_null(col, replacement, sentinels, blank))
    return out
