r"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter, in DataFrame functions only.

The filter is a table of 64-bit blocks: a URL sets a few bits of the one block that its hash names, `bit_or` builds
the blocks, and a join on the block number tests a URL with one comparison. Only possible hits go on to an exact hash
join with the list, which removes false positives. Both joins deal hot URLs out over salts when the filter or list is
too large to broadcast; its size is counted first.

The list of the query comes from what pages contain, not from their URLs: a page full of junk lists its canonical URL,
and every URL of that form is judged by it, under whatever host prefix, scheme, query or page suffix.

Defined results: of rules of equal length the later one counts; URLs of any length are judged whole; null or `://`-less URLs have empty host and path, no rule and verdict allow unless the empty URL is
listed (it never is); repeated rows are judged one by one; empty pages or an empty list give their natural results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (verdict, host, path); the longest host and path wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A page whose raw text holds this mark so often puts its URL on the block list of the query.
JUNK, LEAST_JUNK = "%%%", 10
KEYS_PER_BLOCK, BITS_PER_KEY, BROADCAST_BLOCKS, SALTS = 4, 5, 1 << 20, 16


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., m., blog. and port, path without page suffix and closing slashes; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(?:(?:www|m|blog)\.)+|:\d*$", ""), F.regexp_replace(path, r"(?:\.html)?/*$", ""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def _mask(key: Column) -> Column:
    """Up to BITS_PER_KEY bits of a 64-bit block, from six bits each of a second hash."""
    h = F.xxhash64(F.lit(7), key)
    out = F.lit(0).cast("long")
    for i in range(BITS_PER_KEY):
        bit = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, bits) of the keys in column `key`."""
    return keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), _mask(F.col("key")).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def _deal(left: DataFrame, right: DataFrame, on: str, small: bool, row: Column) -> DataFrame:
    """left outer join right; the right side is broadcast if small, else repeated for each salt so that hot keys spread."""
    if small:
        return left.join(F.broadcast(right), on, "left")
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(row), F.lit(SALTS)).cast("int")).join(salted, [on, "_salt"], "left").drop("_salt")


def with_possible(rows: DataFrame, urls: DataFrame, n: int, key: str = "_key", row: str = "page_id", keys_per_block: int | None = None) -> DataFrame:
    """rows with `_possible`: whether the filter of the n distinct urls (column `key`) takes their key for a listed one. All listed ones are, and few others."""
    n_blocks = max(1, -(-n // (keys_per_block or KEYS_PER_BLOCK)))
    blocks = bloom_blocks(urls.withColumnRenamed(key, "key"), n_blocks).withColumnRenamed("block", "_block").withColumnRenamed("bits", "_bits")
    mask = _mask(F.col(key))
    tested = _deal(rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n_blocks))), blocks, "_block", n_blocks <= BROADCAST_BLOCKS, F.col(row))
    return tested.withColumn("_possible", F.coalesce(mask.bitwiseAND(F.col("_bits")) == mask, F.lit(False))).drop("_block", "_bits")


def with_listed(rows: DataFrame, urls: DataFrame, key: str = "_key", row: str = "page_id", keys_per_block: int | None = None) -> DataFrame:
    """rows with `_listed`: whether the canonical URL in `key` is among those in column `key` of urls."""
    urls = cut(urls.filter("key IS NOT NULL AND key <> ''").select(F.col("key").alias(key)).distinct())
    n = urls.count()
    tested = with_possible(rows, urls, n, key, row, keys_per_block)
    exact = _deal(tested.filter("_possible"), urls.withColumn("_listed", F.lit(True)), key, n <= BROADCAST_BLOCKS // 16, F.col(row))
    sure = tested.filter("NOT _possible").withColumn("_listed", F.lit(False))
    return exact.withColumn("_listed", F.coalesce("_listed", F.lit(False))).unionByName(sure).drop("_possible")


def ruled(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (null where no rule fits) and the canonical URL `_key`. Columns of these names are replaced."""
    rows = pages.withColumn("_url", F.col(url)).drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}).drop("_url")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumns({"rule": rule, "verdict": verdict, "_key": canonical(F.col("host"), F.col("path"))})


def judge_urls(pages: DataFrame, urls: DataFrame, rules=RULES, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """pages with host, path, rule, verdict; urls: canonical URLs to block in column `key`. A row per row of pages."""
    rows = ruled(pages, rules, url)
    by_list = with_listed(rows.filter("verdict IS NULL"), urls, row=page_id)
    by_list = by_list.withColumn("verdict", F.when(F.col("_listed"), "block").otherwise("allow")).drop("_listed")
    return rows.filter("verdict IS NOT NULL").unionByName(by_list).drop("_key")


def listed_urls(pages: DataFrame, mark: str = JUNK, least: int = LEAST_JUNK) -> DataFrame:
    """Canonical URLs (`key`) of pages whose raw text holds a mark `least` times or more. pages: url, html."""
    often = (F.length("html") - F.length(F.replace("html", F.lit(mark), F.lit("")))) >= least * len(mark)
    return ruled(pages.filter(often).select("url")).select(F.col("_key").alias("key"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url"), listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"lower(CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://([^/?#]*)', 1) ELSE '' END)"
_PATH = r"CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END"
OP5_SQL = rf"""
WITH p AS (SELECT page_id, html, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path FROM pages),
r AS (SELECT *,
  CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
       WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
  regexp_replace(regexp_replace(host, '^((www|m|blog)\.)+', ''), ':\d*$', '') || regexp_replace(path, '(\.html)?/*$', '') AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM r WHERE canonical <> '' AND len(html) - len(replace(html, '%%%', '')) >= 30)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (SELECT canonical FROM l) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
