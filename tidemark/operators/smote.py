"""Synthetic minority rows: points on the segment to a near neighbour of the same class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import q, unit
from ..session import materialise
from .neighbours import BLOCK_ROWS, nearest
from .ranks import hashed_rank, row_identity

_BROADCAST_CLASSES = 10_000


def oversample(
    df: DataFrame,
    features: list[str],
    target: str,
    ids: list[str] | None = None,
    seed: int = 42,
    neighbours: int = 5,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(features + target of the synthetic rows, class sizes). Every class reaches the largest.

    Seeds, neighbours and positions come from hashes of the row identity, so the
    synthetic rows do not depend on partitioning.
    """
    sizes = df.groupBy(q(target).alias("_class")).agg(F.count(F.lit(1)).alias("_size"))
    ends = sizes.agg(F.max("_size"), F.min("_size"), F.sum("_size"), F.count(F.lit(1))).first()
    largest, smallest, total, classes = ends
    if smallest < 2:
        raise ValueError("a class with a single row has no neighbour to interpolate with")
    k = max(1, min(neighbours, smallest - 1))
    codes = sizes.withColumn("grp", F.dense_rank().over(Window.orderBy("_class")).cast("bigint"))
    if classes <= _BROADCAST_CLASSES:
        codes = F.broadcast(codes)
    minor = df.join(codes.where(F.col("_size") < largest), q(target) == F.col("_class"))
    vec = F.array(*[q(f).cast("double") for f in features])
    seeds = minor.withColumn("_vec", vec)
    points = seeds.groupBy(F.col("grp"), F.col("_vec").alias("vec")).agg(F.count(F.lit(1)).alias("mult"))
    identity = row_identity(df, ids)
    ranked = hashed_rank(seeds, ["_class"], identity, seed, total)
    need = F.lit(largest) - F.col("_size")
    copies = F.floor(need / F.col("_size")) + (F.col("_rank") <= need % F.col("_size")).cast("int")
    # A class may need fewer new rows than it has: only the seeds that get one are searched for, among all rows of their class.
    chosen = materialise(ranked.withColumn("_copies", copies.cast("int")).where(F.col("_copies") > 0), "seeds")
    wanted = chosen.select("grp", F.col("_vec").alias("vec")).distinct()
    picked = nearest(wanted, points, len(features), k, False, block_rows)
    expanded = picked.groupBy("grp", "vec").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("dist", "hit", "take"))),
                lambda c: F.array_repeat(c["hit"], c["take"].cast("int")),
            )
        ).alias("_near")
    )
    grown = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    joined = grown.join(
        expanded.select(F.col("grp").alias("_g"), F.col("vec").alias("_v"), "_near"),
        (F.col("grp") == F.col("_g")) & (F.col("_vec") == F.col("_v")),
    )
    pick = F.floor(unit(seed, "neighbour", *identity, F.col("_copy")) * F.size("_near")).cast("int")
    along = unit(seed, "along", *identity, F.col("_copy"))
    placed = joined.withColumn("_to", F.col("_near")[pick]).withColumn("_u", along)
    made = placed.select(
        *[
            (q(f).cast("double") + F.col("_u") * (F.col("_to")[j] - q(f).cast("double"))).alias(f)
            for j, f in enumerate(features)
        ],
        q(target),
    )
    return made, sizes
