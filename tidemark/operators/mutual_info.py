"""Mutual information of continuous features with a class, by nearest neighbours (k = 3).

The 1-D estimator of Ross (2014): for each point the distance to its k-th
neighbour of the same class is a radius, and the points of any class strictly
inside that radius are counted. One dimension needs no distance join: values are
sorted, neighbours are the next distinct values of the class, and the count inside
an interval is a difference of running totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import digamma, q
from .ranks import range_bucket, running_total

ROWS_PER_BUCKET = 1_000_000
_MAX_BUCKETS = 4096


def _splits(df: DataFrame, features: list[str], n: int, rows_per_bucket: int) -> list[list[float]]:
    """Cut points per feature so that a bucket holds about ``rows_per_bucket`` values."""
    buckets = min(_MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    if buckets <= 1:
        return [[] for _ in features]
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(
        *[F.percentile_approx(q(f).cast("double"), F.array(*[F.lit(p) for p in probs]), 10 * buckets) for f in features]
    ).first()
    return [sorted(set(cuts or [])) for cuts in row]


def _bucket(pos: Column, value: Column, splits: list[list[float]]) -> Column:
    out = F.lit(0)
    for i, cuts in enumerate(splits):
        if cuts:
            out = F.when(pos == i, range_bucket(value, cuts)).otherwise(out)
    return out.cast("int")


def mutual_information(
    df: DataFrame,
    features: list[str],
    target: str,
    neighbours: int = 3,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(pos, feature, score), one row per feature; features hold no missing cells."""
    sizes = df.groupBy(q(target).alias("cls")).agg(F.count(F.lit(1)).alias("size"))
    n, n_all = sizes.where("size > 1").agg(F.sum("size")).first()[0] or 0, df.count()
    splits = _splits(df, features, n_all, rows_per_bucket)
    long = df.select(
        q(target).alias("cls"),
        F.stack(
            F.lit(len(features)), *[x for i, f in enumerate(features) for x in (F.lit(i), q(f).cast("double"))]
        ).alias("pos", "value"),
    )
    # Equal values of a class are one row with a count: a hot value costs one row.
    points = (
        long.groupBy("pos", "cls", "value").agg(F.count(F.lit(1)).alias("freq"))
        .withColumn("bucket", _bucket(F.col("pos"), F.col("value"), splits))
    )
    radius = _radii(points.join(sizes, "cls").where("size > 1"), neighbours, rows_per_bucket)

    # Every interval end is looked up in the running count of all values: both are
    # sorted together once, ends after (before) the values they include (exclude).
    # The neighbour itself is one end, exactly; the other end mirrors it.
    right = F.when(F.col("to") > F.col("value"), F.col("to")).otherwise(F.col("value") + F.col("r"))
    left = F.when(F.col("to") < F.col("value"), F.col("to")).otherwise(F.col("value") - F.col("r"))
    ends = radius.select("pos", "cls", "value", "freq", "size", "k", F.explode(F.array(
        F.struct(F.lit(1).alias("sign"), right.alias("at"), F.when(F.col("r") > 0, 0).otherwise(2).alias("ord")),
        F.struct(F.lit(-1).alias("sign"), left.alias("at"), F.when(F.col("r") > 0, 2).otherwise(0).alias("ord")),
    )).alias("e")).select("pos", "cls", "value", "freq", "size", "k", "e.*")
    marks = points.groupBy("pos", "value", "bucket").agg(F.sum("freq").alias("w")).select(
        "pos", F.lit(None).cast(points.schema["cls"].dataType).alias("cls"), "value",
        F.lit(0).cast("bigint").alias("freq"), F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("k"),
        F.lit(0).alias("sign"), F.col("value").alias("at"), F.lit(1).alias("ord"), "bucket", "w",
    )
    asked = ends.withColumn("bucket", _bucket(F.col("pos"), F.col("at"), splits)).withColumn("w", F.lit(0).cast("bigint"))
    counted = running_total(
        marks.unionByName(asked), ["pos"], "bucket", [F.col("at"), F.col("ord")], F.col("w"), "upto"
    ).where("sign <> 0")
    inside = counted.groupBy("pos", "cls", "value", "freq", "size", "k").agg(
        F.sum(F.col("sign") * F.col("upto")).alias("m")
    )
    total = F.sum("freq")
    scores = inside.groupBy("pos").agg(
        (
            F.lit(_digamma_number(n))
            + (F.sum(F.col("freq") * digamma(F.col("k"))) - F.sum(F.col("freq") * digamma(F.col("size")))
               - F.sum(F.col("freq") * digamma(F.col("m")))) / total
        ).alias("raw")
    )
    names = F.array(*[F.lit(f) for f in features])
    return scores.select("pos", names[F.col("pos")].alias("feature"), F.greatest(F.col("raw"), F.lit(0.0)).alias("score"))


def _digamma_number(n: int) -> float:
    x, shift = float(max(n, 1)), 0.0
    while x < 6:
        shift, x = shift + 1.0 / x, x + 1.0
    z2 = x * x
    return math.log(x) - 0.5 / x - 1 / (12 * z2) + 1 / (120 * z2 * z2) - 1 / (252 * z2 * z2 * z2) - shift


def _radii(points: DataFrame, neighbours: int, rows_per_bucket: int) -> DataFrame:
    """Distance of every distinct (feature, class, value) to its k-th same-class neighbour.

    The rank of a value within its class cuts the class into equal chunks; the few
    values next to a chunk border are copied over it, so ``lag`` and ``lead`` see
    all neighbours although no window spans a whole class.
    """
    k0 = neighbours
    chunk_rows = max(rows_per_bucket, 4 * k0)
    ranked = running_total(points, ["pos", "cls"], "bucket", [F.col("value")], F.lit(1), "rank")
    at = F.col("rank") - 1
    chunk, offset = F.floor(at / chunk_rows), at % chunk_rows
    spread = ranked.withColumn(
        "_chunks",
        F.filter(
            F.array(
                chunk,
                F.when(offset < k0, chunk - 1),
                F.when(offset >= chunk_rows - k0, chunk + 1),
            ),
            lambda c: c.isNotNull(),
        ),
    ).withColumn("_home", chunk).withColumn("_chunk", F.explode("_chunks"))
    w = Window.partitionBy("pos", "cls", "_chunk").orderBy("value")
    k = F.least(F.lit(k0), F.col("size") - 1)
    near = [F.struct(F.lit(0.0).alias("dist"), (F.col("freq") - 1).alias("freq"), F.col("value").alias("to"))]
    for step in range(1, k0 + 1):
        for move in (F.lag, F.lead):
            near.append(
                F.struct(
                    F.abs(F.col("value") - move("value", step).over(w)).alias("dist"),
                    move("freq", step).over(w).alias("freq"),
                    move("value", step).over(w).alias("to"),
                )
            )
    listed = spread.withColumn("_near", F.array(*near)).where("_chunk = _home").withColumn("k", k)
    ordered = F.array_sort(F.filter("_near", lambda c: c["dist"].isNotNull()))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(0.0).alias("r"), F.lit(0.0).alias("to"))
    walk = F.aggregate(
        ordered,
        start,
        lambda acc, c: F.struct(
            (acc["seen"] + c["freq"]).alias("seen"),
            F.when(acc["seen"] >= F.col("k"), acc["r"]).otherwise(c["dist"]).alias("r"),
            F.when(acc["seen"] >= F.col("k"), acc["to"]).otherwise(c["to"]).alias("to"),
        ),
    )
    done = listed.withColumn("_w", walk)
    return done.select(
        "pos", "cls", "value", "freq", "size", F.col("k").cast("bigint"), F.col("_w.r").alias("r"), F.col("_w.to").alias("to")
    )


def best_features(df: DataFrame, features: list[str], target: str, keep: int = 10) -> list[str]:
    """Names of the ``keep`` features with the highest score, in their original order."""
    scores = mutual_information(df, features, target)
    top = scores.orderBy(F.desc("score"), "pos").limit(keep).select("pos").collect()
    return [features[i] for i in sorted(r["pos"] for r in top)]
