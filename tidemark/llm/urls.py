"""URL rules and block lists: a blocked Bloom filter passes possible hits to an exact join.

Every URL asks for the keys (last labels of its host, first characters of its path) of the shapes that occur
among the listed ones. The filter drops nearly all keys that are not listed, and the join with the list removes what
it let through by chance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .joins import attach
from .scratch import written

#: Bits of the filter per listed key, and the most blocks (of 512 bits: 32 MB). A longer list fills the
#: filter more, so more keys reach the exact join; the result stays the same.
BITS_PER_KEY, MOST_BLOCKS = 16, 1 << 19
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Canonical URLs that the registered query blocks where no rule decides.
LISTED = [
    (f"{name}.example.{end}", "/")
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")
]


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listing(
    spark: SparkSession, rules: list[tuple[str, str, str]], listed: list[tuple[str, str]] = ()
) -> DataFrame:
    """host, path, verdict and is_rule of a list given as rows; larger lists come as such a table."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(h, p, "block", False) for h, p in listed]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(key, F.lit(7))


def _bits(second: Column) -> list[Column]:
    """One bit in each of the eight words of a block."""
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")) for i in range(8)]


class BloomFilter:
    """The filter as an array of blocks, filled by Spark (bitwise or per block) and of bounded size."""

    def __init__(self, keys: DataFrame, n_keys: int):
        self.blocks = max(1, min(MOST_BLOCKS, -(-n_keys * BITS_PER_KEY // 512)))
        first, second = _hashes(F.col("key"))
        filled = keys.select(F.pmod(first, F.lit(self.blocks)).alias("block"), *[b.alias(f"w{i}") for i, b in enumerate(_bits(second))])
        rows = filled.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)]).toPandas()
        self.words = np.zeros((self.blocks, 8), np.uint64)
        self.words[rows["block"].to_numpy(np.int64)] = rows[[f"w{i}" for i in range(8)]].to_numpy(np.int64).view(np.uint64)

    def probe(self, spark: SparkSession, key: Column) -> Column:
        shared = spark.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def may_hold(first: pd.Series, second: pd.Series) -> pd.Series:
            words = shared.value
            own = words[np.mod(first.to_numpy(np.int64), len(words))]
            bits = second.to_numpy(np.int64).view(np.uint64)[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(6))
            return pd.Series(((own >> (bits & np.uint64(63))) & np.uint64(1)).all(axis=1))

        return may_hold(*_hashes(key))


def judge(pages: DataFrame, lists: DataFrame) -> DataFrame:
    """``pages`` with host, path, rule and verdict (allow or block) of each url.

    The host is what stands from the first ``://`` to the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path what follows up to
    ``?`` or ``#``; a url that is null or has no ``://`` has both empty and is allowed. A listed entry fits its host and all
    subdomains where the path starts with the entry's; of the rules that fit the longest decides (of equally long ones that
    with the longer host, then the one that blocks). Without a rule a fitting entry of the block list blocks, else the url is allowed.
    Repeated rows are judged alike; columns of ``pages`` named like a new one are replaced; an empty list allows everything.
    """
    spark = pages.sparkSession
    new = ("host", "path", "rule", "verdict")
    pages = pages.select(*[F.col(f"`{c.replace('`', '``')}`") for c in pages.columns if c.lower() not in new])
    entries = written(
        lists.withColumn("key", F.concat("host", "path")).groupBy("key", F.length("host").alias("host_length")).agg(
            F.max(F.when(F.col("is_rule"), F.col("verdict"))).alias("ruled"),
            F.coalesce(F.bool_or(~F.col("is_rule") & (F.col("verdict") == "block")), F.lit(False)).alias("listed"),
            F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("path_length"),
        ),
        "url-list",
    )
    shapes = entries.agg(F.count("*").alias("n"), F.collect_set("labels").alias("labels"), F.collect_set("path_length").alias("lengths")).first()
    labels, lengths = sorted(shapes["labels"]), sorted(shapes["lengths"])  # a few numbers, whatever the length of the list
    bloom = BloomFilter(entries, shapes["n"])
    urls = pages.select("url").where("url is not null").distinct()
    parts = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    has = F.length("host") - F.length(F.replace("host", F.lit("."))) + 1
    asked = (
        parts.withColumn("n", F.explode(F.array(*map(F.lit, labels)).cast("array<int>"))).where(F.col("n") <= has)
        .withColumn("m", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.col("m") <= F.length("path"))
        .select("url", F.concat(F.expr("substring_index(host, '.', -n)"), F.expr("substring(path, 1, m)")).alias("key"))
    )
    possible = asked.where(bloom.probe(spark, F.col("key")))
    hits = attach(possible, entries.select("key", "host_length", "ruled", "listed"), "key").where("listed is not null")
    length = F.struct(F.length("key"), F.col("host_length"), F.col("ruled"))
    best = hits.groupBy("url").agg(
        F.max_by(F.when(F.col("ruled").isNotNull(), F.struct("key", "ruled")), F.when(F.col("ruled").isNotNull(), length)).alias("best"),
        F.bool_or("listed").alias("listed"),
    )
    best = written(best.select(F.col("url").alias("__url"), F.col("best.key").alias("rule"), F.col("best.ruled").alias("ruled"), "listed"), "url-hits")
    known = pages.where("url is not null").join(best, F.col("url") == F.col("__url"), "left").drop("__url")
    bare = pages.where("url is null").select(
        "*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("ruled"), F.lit(None).cast("boolean").alias("listed")
    )
    verdict = F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")), F.lit("allow"))
    return (
        known.union(bare).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
        .withColumn("verdict", verdict).drop("ruled", "listed")
    )


ORACLE = f"""
WITH parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), lists(h, p, v, is_rule) AS (
  VALUES ('net', '/', 'block', true), ('example.net', '/en/', 'allow', true), ('example.com', '/de/', 'block', true), ('org', '/fr/', 'allow', true),
    {", ".join(f"('{h}', '{p}', 'block', false)" for h, p in LISTED)}
), hosts AS (
  SELECT DISTINCT host, path FROM parts
), fit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) FILTER (is_rule) AS rule, arg_max(v, length(h || p)) FILTER (is_rule) AS ruled,
    bool_or(NOT is_rule) AS listed
  FROM hosts JOIN lists ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL
)
SELECT page_id, parts.host, parts.path, rule, coalesce(ruled, CASE WHEN listed THEN 'block' END, 'allow') AS verdict
FROM parts LEFT JOIN fit ON parts.host = fit.host AND parts.path = fit.path
"""
