"""URL filter: a blocked Bloom filter in front of an exact hash join (built-in functions only).

Listed entries are keys: ``host/path-prefix`` rules, which hold for a host with all its
subdomains, and whole canonical URLs.  A URL asks for each key that could fit it: every suffix of
its host with as many labels as some rule has, with every path prefix of a length that some rule has,
and its own canonical form.

1. The filter is made in Spark: a key's hash picks one block of 256 bits and eight bits in it; the
   bits of a block are or-ed in a partial aggregate.  One key touches one block.
2. The keys asked for are joined with their block and tested.  The blocks are broadcast only if
   they are at most ``BROADCAST_BLOCKS``; a larger filter is joined by a shuffle on the block.
3. Possible hits go to an exact join with the listed keys, which removes false positives.  A key
   that holds over ``1 / HOT`` of the possible hits (there are at most ``HOT`` of them) is joined
   on the map side; the others by a shuffle.
4. Of a URL's hits the longest rule wins; a hit in the list of URLs counts where no rule fits.

Canonical form: host in lower case without port, path without a trailing slash (and ``.html`` or
``/index`` at the end), then the query's parameters sorted, without those that only track; no
fragment.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no hit, and the
default verdict; repeated rows are judged row by row and get equal answers; URLs of any length, with
any number of labels, are judged whole; an empty table gives an empty result; an empty list hits nothing;
other columns, of whatever name, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.support import ROW, cut, numbered

#: Bits of filter per key, lanes of 32 bits in a block, and the largest filter that is broadcast.
BITS, LANES, BROADCAST_BLOCKS = 16, 8, 1 << 20
HOT = 500
#: Query parameters that do not change the page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|mc_[a-z]+"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Canonical form of a URL; empty without ``://``."""
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(_after(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^({TRACKING})(=|$)")))
    host = F.regexp_replace(host_of(url), r":\d*$", "")
    return F.when(host_of(url) == "", F.lit("")).otherwise(
        F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path prefix, verdict) entries as listed keys."""
    rows = [(f"rule {host}{path}", f"{host}{path}", verdict) for host, path, verdict in rules]
    return spark.createDataFrame(rows, "key string, rule string, verdict string")


def url_table(urls: DataFrame, url_col: str = "url", verdict: str = "block") -> DataFrame:
    """Listed URLs as keys of their canonical form."""
    return urls.select(F.concat(F.lit("url "), canonical(F.col(url_col))).alias("key"),
                       F.lit(None).cast("string").alias("rule"), F.lit(verdict).alias("verdict")
                       ).where(F.col("key") != "url ").distinct()


def _asked(url_parts: DataFrame, label_counts: Sequence[int], path_lengths: Sequence[int]) -> DataFrame:
    """An array ``keys`` of all keys that could fit the row's host, path and canonical form: suffixes of
    the host with as many labels as some rule has, so a host of very many labels costs no more than others."""
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in label_counts])) if label_counts else F.array()
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in path_lengths])) if path_lengths else F.array()
    rules = F.flatten(F.transform(suffixes, lambda host: F.transform(
        prefixes, lambda path: F.concat(F.lit("rule "), host, path))))
    own = F.array(F.concat(F.lit("url "), F.col("canon")))
    return url_parts.withColumn("keys", F.when(F.col("host") == "", F.array().cast("array<string>"))
                                .otherwise(F.array_distinct(F.concat(rules, own))))


def _block(key: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _bit(key: str, lane: int) -> Column:
    """One bit of a lane: five bits of a second hash choose it."""
    five = F.shiftright(F.xxhash64(key, F.lit("bits")), 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    return F.call_function("shiftleft", F.lit(1), five)


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: block, w0 .. w7."""
    return (listed.select(_block("key", n_blocks).alias("block"), *[_bit("key", i).alias(f"b{i}") for i in range(LANES)])
            .groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(LANES)]))


def blocks_for(n_keys: int) -> int:
    """Blocks of a filter for so many keys."""
    return max(64, -(-n_keys * BITS // (32 * LANES)))


def without_rows(rows: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """``rows`` whose number (column ``name``) is not in ``gone``.

    Rows that do not pass the filter of the numbers that go stay where they are; only possible hits
    travel to the exact join.
    """
    n_blocks = blocks_for(gone.count())
    if n_blocks > BROADCAST_BLOCKS:
        return rows.join(gone, name, "left_anti")
    blocks = cut(bloom_blocks(gone.select(F.col(name).alias("key")), n_blocks))
    blocks = F.broadcast(blocks.select(*[F.col(c).alias(f"__llm_{c}") for c in blocks.columns]))
    tested = rows.withColumn("__llm_block", _block(name, n_blocks)).join(blocks, "__llm_block", "left")
    hit = F.lit(True)
    for i in range(LANES):
        hit = hit & (F.coalesce(F.col(f"__llm_w{i}"), F.lit(0)).bitwiseAND(_bit(name, i)) != 0)
    tested = tested.withColumn("__llm_hit", hit)
    stay = tested.where(~F.col("__llm_hit")).select(*rows.columns)
    return stay.unionByName(tested.where("__llm_hit").select(*rows.columns).join(gone, name, "left_anti"))


def possible(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows of ``asked`` (with ``key``) that pass the filter of the listed keys."""
    n_blocks = blocks_for(listed.count())
    blocks = cut(bloom_blocks(listed, n_blocks))
    if n_blocks <= BROADCAST_BLOCKS:
        blocks = F.broadcast(blocks)
    tested = asked.withColumn("block", _block("key", n_blocks)).join(blocks, "block")
    for i in range(LANES):
        tested = tested.where(F.col(f"w{i}").bitwiseAND(_bit("key", i)) != 0)
    return tested.select(*asked.columns)


def confirmed(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """The possible hits that are listed, with rule and verdict."""
    totals = hits.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    all_hits = totals.agg(F.sum("n").alias("n")).select("n").scalar()
    hot = cut(totals.where(F.col("n") * HOT > all_hits).join(listed, "key", "left").drop("n"))
    cold = hits.join(F.broadcast(hot.select("key")), "key", "left_anti").join(listed, "key")
    return hits.join(F.broadcast(hot.where("verdict is not null")), "key").unionByName(cold)


def judge(urls: DataFrame, rules: Sequence[tuple[str, str, str]], listed_urls: DataFrame, default: str = "allow",
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``urls``: id, host, path, rule, verdict, listed (the URL itself is listed)."""
    spark = urls.sparkSession
    slim = urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    lengths = sorted({len(path) for _, path, _ in rules})
    listed = cut(rule_table(spark, rules).unionByName(url_table(listed_urls, url_col)))
    parts = numbered(slim).select(F.col(ROW).alias("_row"), "id", host_of(F.col("url")).alias("host"),
                                  path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canon"))
    labels = sorted({host.count(".") + 1 for host, _, _ in rules})
    asked = _asked(parts, labels, lengths).select("_row", F.explode("keys").alias("key"))
    hits = cut(possible(asked, listed))
    best = confirmed(hits, listed).groupBy("_row").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("by_rule"),
        F.max(F.when(F.col("rule").isNull(), F.col("verdict"))).alias("by_list"))
    return parts.join(best, "_row", "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("by_rule.rule").alias("rule"),
        F.coalesce("by_rule.verdict", "by_list", F.lit(default)).alias("verdict"),
        F.col("by_list").isNotNull().alias("listed"))
