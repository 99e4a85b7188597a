"""URL filters: host and path rules, and a list of URLs behind a blocked Bloom filter.

Listed canonical URLs set eight bits in one block of a fixed-size filter. Only
URLs whose bits are all set are joined with the list itself, which removes the
filter's false positives; the others never reach a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blocks of the filter at most: 2 ** 16 rows of eight 64-bit words, 4 MB, bound the broadcast.
MAX_BLOCKS = 1 << 16
WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change a page (fixed values).
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, and sorted parameters without tracking ones.

    Null for a null URL or one without ``://``.
    """
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(url, _PARTS, 3), "&"),
                                               lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    whole = F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), "/+$", ""),
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(url, "://") > 0, whole)


def rule_column(host: Column, path: Column, rules: list[tuple[str, str, str]], what: int) -> Column:
    """The longest fitting rule's text (``what`` 0) or verdict (1); null when none fits."""
    out = F.lit(None).cast("string")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.lit(verdict if what else rule_host + rule_path)).otherwise(out)
    return out


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1).cast("long")).cast("int")


def _mask(h: Column, word: int) -> Column:
    bit = F.shiftrightunsigned(h, 16 + 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom_blocks(keys: DataFrame, key: str, n_keys: int, bits_per_key: int = 16) -> tuple[DataFrame, int]:
    """(block, w0..w7) with one row per block that is not empty, and the number of blocks.

    The number follows ``n_keys`` up to ``MAX_BLOCKS``; a longer list only
    lets more false positives through.
    """
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 64 * WORDS < n_keys * bits_per_key:
        blocks *= 2
    h = F.xxhash64(key)
    bits = keys.select(_block(h, blocks).alias("block"), *[_mask(h, i).alias(f"w{i}") for i in range(WORDS)])
    return bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def may_contain(rows: DataFrame, key: str, filter_blocks: DataFrame, blocks: int, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether all bits of the key are set. A null key is never contained."""
    h = F.xxhash64(key)
    probe = filter_blocks.select(F.col("block").alias("__block"), *[F.col(f"w{i}").alias(f"__w{i}") for i in range(WORDS)])
    hit = F.col(key).isNotNull()
    for i in range(WORDS):
        hit = hit & (F.col(f"__w{i}").bitwiseAND(_mask(h, i)) != 0)
    return (rows.join(F.broadcast(probe), _block(h, blocks) == F.col("__block"), "left")
            .withColumn(flag, F.coalesce(hit, F.lit(False))).drop("__block", *[f"__w{i}" for i in range(WORDS)]))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]],
                id_col: str = "page_id", url_col: str = "url", listed_col: str = "url",
                listed_verdict: str = "block", default_verdict: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row of ``pages``.

    A fitting rule decides; else a URL whose canonical form is listed gets
    ``listed_verdict``, all others ``default_verdict``. A null URL, or one
    without ``://``, has empty host and path, fits no rule and is never listed.
    Ids may be null or repeated. Nulls and repeats in the list count once or
    not at all; an empty list blocks nothing. Rows of one very common URL are
    split by the adaptive skew join.
    """
    keys = listed.select(canonical_url(F.col(listed_col)).alias("key")).where("key is not null").groupBy("key").count().select("key")
    blocks, n_blocks = bloom_blocks(keys, "key", keys.count())
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"),
                        canonical_url(url).alias("key"))
    rows = rows.withColumns({"rule": rule_column(F.col("host"), F.col("path"), rules, 0),
                             "by_rule": rule_column(F.col("host"), F.col("path"), rules, 1)})
    rows = may_contain(rows, "key", blocks, n_blocks, "maybe")
    out = ["page_id", "host", "path", "rule", "verdict", "listed"]
    clear = rows.where("not maybe").withColumns({"listed": F.lit(False), "verdict": F.coalesce("by_rule", F.lit(default_verdict))})
    hits = rows.where("maybe").join(keys.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "key", "left")
    hits = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).withColumn(
        "verdict", F.coalesce("by_rule", F.when(F.col("listed"), F.lit(listed_verdict)).otherwise(F.lit(default_verdict))))
    return clear.select(*out).unionAll(hits.select(*out))


def oracle_sql(pages: str, listed: str, rules: list[tuple[str, str, str]]) -> str:
    """DuckDB text of ``filter_urls`` with its default verdicts; ``listed`` is a query with a ``url`` column."""

    def part(i: int) -> str:
        return f"regexp_extract(url, '{_PARTS}', {i})"

    host = f"translate({part(1)}, '{UPPER}', '{LOWER}')"
    params = f"array_to_string(list_sort([p FOR p IN string_split({part(3)}, '&') IF p <> '' AND NOT regexp_matches(p, '{TRACKING}')]), '&')"
    key = (f"CASE WHEN instr(url, '://') > 0 THEN regexp_replace({host}, '^www\\.', '') || regexp_replace({part(2)}, '/+$', '') || "
           f"CASE WHEN {params} <> '' THEN '?' || {params} ELSE '' END END")
    fits = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}"
                   for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])))
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE" + fits.format(*[f"'{h + p}'" for h, p, _ in ordered]) + " END"
    verdict = "CASE" + fits.format(*[f"'{v}'" for *_, v in ordered]) + " WHEN listed THEN 'block' ELSE 'allow' END"
    return f"""WITH bad AS (SELECT DISTINCT {key} AS key FROM ({listed})),
parts AS (SELECT page_id, coalesce({host}, '') AS host, coalesce({part(2)}, '') AS path, {key} AS key FROM {pages}),
found AS (SELECT parts.*, bad.key IS NOT NULL AS found FROM parts LEFT JOIN bad ON bad.key = parts.key),
ruled AS (SELECT page_id, host, path, {rule} AS rule, found AS listed FROM found)
SELECT page_id, host, path, rule, {verdict} AS verdict, listed FROM ruled"""
