"""Joining a table of any size with a small one whose size is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows (a few dozen bytes each) up to which the small side is broadcast.
FEW_ROWS = 10_000
_SALTS = 32


def attach(rows: DataFrame, small: DataFrame, key: str, few: int = FEW_ROWS) -> DataFrame:
    """``rows`` with the other columns of ``small``, which has one row for each ``key`` (null counts as a key).

    A small side of at most ``few`` rows is broadcast. A larger one is repeated for each salt and joined by
    (key, salt), so that a key with a third of all rows is dealt to many tasks.
    """
    renamed = small.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if small.count() <= few:
        return rows.join(F.broadcast(renamed), same, "left").drop("__key")
    salted = renamed.withColumn("__theirs", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(_SALTS)).cast("int")
    joined = rows.withColumn("__ours", salt).join(salted, same & (F.col("__ours") == F.col("__theirs")), "left")
    return joined.drop("__key", "__ours", "__theirs")
