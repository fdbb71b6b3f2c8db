"""Mixing sources to target weights, with DataFrame functions only.

Words are summed per source, targets follow from the weights with a ceiling of
``most`` times a source's words, and every document is taken floor(rate) times plus
once more with the probability of the remaining fraction, drawn from a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import attach
from .scratch import written

#: The characters between words, in the notation of a regular expression's class.
BLANK = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """source, source_size -> target of each source.

    Sources in code point order, null last, weigh ``weights`` in turn and divide
    ``share`` times all words. Nobody gets more than ``most`` times its own; what is over
    goes to the others by weight until all fit. In order of size per weight, those that hit
    the ceiling come first: the source at place i is full if an even division of what the earlier
    ones leave would give it more than its ceiling, which running sums tell at once; after the first
    that is not full, levels only sink, so the highest of them is the one that holds.
    The windows hold one row a source.
    """
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(
        F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")
    ).cast("long")
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left", F.col("budget") - earlier("cap"))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - earlier("weight")))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("even", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
        .select(
            "source", "source_size",
            F.when(F.col("full"), F.col("cap").cast("double"))
            .otherwise(F.least(F.col("even") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
        )
    )


def draw(seed: int, *key: Column) -> Column:
    """A number from 0 to 1 (never 1) that depends on seed and key alone."""
    text = F.concat_ws(":", F.lit(str(seed)), *key)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def with_copies(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document).

    A null text has size 0; null sources form one source, last in order; a source without words has
    target and rate 0. Documents of one doc_id draw alike (repeated rows share their fate), those
    of null doc_id draw by their text. Columns of ``docs`` that are named like a new one
    (in any case) are replaced. Sums precede the shuffle, so a hot source costs a row a task.
    """
    new = ["size", "source_size", "target", "copies"]
    own = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in new]
    sized = docs.select(*own, word_count(F.col("text")).alias("size"))
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    targets = source_targets(sizes, list(weights), share, most)
    joined = attach(sized, written(targets, "mix-targets"), "source")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    rate = F.coalesce(rate, F.lit(0.0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    more = (draw(seed, key) < rate - F.floor(rate)).cast("long")
    return joined.withColumn("copies", F.floor(rate) + more)


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    taken = with_copies(docs.select(F.struct("*").alias("__row"), "doc_id", "text", "source"), **settings)
    return (
        taken.where(F.col("copies") > 0)
        .select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
        .select("__row.*")
    )


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
    source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
    AS level
  FROM w
  WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, level * weight >= cap AS is_full FROM l
), u AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE
    ELSE least(max(CASE WHEN NOT is_full THEN level END) OVER () * weight, cap::DOUBLE) END AS target
  FROM t
), r AS (
  SELECT doc_id, size, source_size, target, k,
    CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS rate
  FROM sized JOIN u ON sized.source IS NOT DISTINCT FROM u.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('17:' || k), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate)
      THEN 1 ELSE 0 END)
  AS taken
FROM r
"""
