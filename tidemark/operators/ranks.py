"""Ranks and running totals whose windows stay small however large a group is.

A window over a whole class or feature would sort it in one task. Here each group
is cut into ordered buckets; bucket totals (a small table) are accumulated per
group and joined back, and the window only runs inside a bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import hash52, q

ROWS_PER_BUCKET = 1_000_000


def running_total(
    df: DataFrame, group: list[str], bucket: str, order: list[Column], weight: Column, out: str
) -> DataFrame:
    """Add the inclusive running sum of ``weight`` in (bucket, order) per group.

    ``bucket`` must rise with the order. Both the join and the window hash on
    (group, bucket), so the rows move once.
    """
    keys = [*group, bucket]
    totals = df.groupBy(*keys).agg(F.sum(weight).alias("_t"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        df.join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.sum(weight).over(inner)))
        .select(*[q(c) for c in df.columns], out)
    )


def hashed_rank(
    df: DataFrame,
    group: list[str],
    ids: list[Column],
    seed: object,
    n: int,
    out: str = "_rank",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """1-based rank inside each group in the order of a hash of ``ids``.

    Equals ``row_number() over (partition by group order by hash, ids)``.
    """
    hashed = df.withColumn("_h", hash52(seed, *ids))
    buckets = max(1, math.ceil(n / rows_per_bucket))
    order = [F.col("_h"), *ids]
    if buckets == 1:
        w = Window.partitionBy(*group).orderBy(*order)
        return hashed.withColumn(out, F.row_number().over(w).cast("bigint")).drop("_h")
    cut = hashed.withColumn("_b", F.floor(F.col("_h") / F.lit(2.0**52) * buckets).cast("int"))
    return running_total(cut, group, "_b", order, F.lit(1), out).drop("_h", "_b")


def range_bucket(value: Column, splits: list[float]) -> Column:
    """Number of splits below ``value``, by a two-level search over literals."""
    if not splits:
        return F.lit(0)
    step = max(1, math.isqrt(len(splits)))
    blocks = [splits[i : i + step] for i in range(0, len(splits), step)]
    heads = F.array(*[F.lit(b[0]) for b in blocks])
    coarse = F.size(F.filter(heads, lambda s: s < value))
    body = F.array(*[F.array(*[F.lit(x) for x in b]) for b in blocks])
    fine = F.size(F.filter(F.element_at(body, F.greatest(coarse, F.lit(1))), lambda s: s < value))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + fine)


def row_identity(df: DataFrame, ids: list[str] | None) -> list[Column]:
    """Columns that order rows reproducibly: the given ids, else all cells.

    Without ids, rows that tie are equal in every cell, so any order of them
    gives the same table.
    """
    return [q(c) for c in (ids or df.columns)]
