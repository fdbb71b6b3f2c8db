"""Value counts of many columns in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.scalars import q
from ..session import is_moment, is_real, is_text, is_whole

_LONG_TEXT = 128


def value_counts(df: DataFrame, columns: list[str], digest_long_text: bool = False) -> DataFrame:
    """(pos, text, real, whole, freq): one row per distinct non-null value.

    ``stack`` keeps every value in its own type, so nothing is rendered as text
    that is not text. One map-side-combined shuffle serves all columns, and a hot
    value is a single pre-aggregated row per task. With ``digest_long_text`` long
    strings shuffle as a SHA-256, enough to count distinct values.
    """
    args: list[Column] = []
    for pos, name in enumerate(columns):
        dtype = df.schema[name].dataType
        text, real, whole = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("bigint")
        if is_text(dtype):
            text = q(name)
            if digest_long_text:
                text = F.when(F.length(text) > _LONG_TEXT, F.sha2(text, 256)).otherwise(text)
        elif is_real(dtype):
            real = q(name).cast("double")
        elif is_moment(dtype):
            whole = F.unix_micros(q(name).cast("timestamp"))
        elif is_whole(dtype):
            whole = q(name).cast("bigint")
        else:
            whole = q(name).cast("int").cast("bigint")
        args += [F.lit(pos), text, real, whole]
    long = df.select(F.stack(F.lit(len(columns)), *args).alias("pos", "text", "real", "whole"))
    present = F.col("text").isNotNull() | F.col("real").isNotNull() | F.col("whole").isNotNull()
    return long.where(present).groupBy("pos", "text", "real", "whole").agg(F.count(F.lit(1)).alias("freq"))


def row_digest(df: DataFrame) -> Column:
    """128 bits of a row's cells (hex): equal rows, equal digests. A cell is its length and text, or ``-`` for NULL."""
    cells = []
    for name in df.columns:
        cell = q(name)
        text = (cell + F.lit(0.0) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else cell).cast("string")  # -0.0 is 0.0
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat(*cells))


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False, rows: bool = False) -> dict[str | None, int]:
    """Exact (or approximate) number of distinct non-null values per column; with ``rows`` under None also that of whole rows.

    Rows count by their digest, whatever ``approx`` says: 16 bytes of each move, not the rows.
    """
    if not columns:
        return {}
    if approx:
        row = df.agg(*[F.approx_count_distinct(q(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        found = {c: row[i] for i, c in enumerate(columns)}
        if rows:
            found[None] = df.select(row_digest(df).alias("d")).groupBy("d").count().count()
        return found
    if rows:
        df, columns = df.withColumn("__row_digest", row_digest(df)), [*columns, "__row_digest"]
    per = value_counts(df, columns, digest_long_text=True).groupBy("pos").agg(F.count(F.lit(1)).alias("k"))
    counted = {r["pos"]: r["k"] for r in per.collect()}
    found = {c: counted.get(i, 0) for i, c in enumerate(columns)}
    return {(None if c == "__row_digest" and rows else c): k for c, k in found.items()}


def modes(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """Most frequent value per column, smallest value on ties; None if all missing.

    The final step is ``min_by`` on (-freq, value): constant memory, unlike the
    built-in ``mode`` which keeps every distinct value of a column in one task.
    """
    if not columns:
        return {}
    order = F.struct(-F.col("freq"), F.col("text"), F.col("real"), F.col("whole"))
    best = (
        value_counts(df, columns)
        .groupBy("pos")
        .agg(F.min_by(F.struct("text", "real", "whole"), order).alias("v"))
        .select("pos", "v.text", "v.real", "v.whole", F.timestamp_micros("v.whole").cast("timestamp_ntz").alias("ts"))
    )
    out: dict[str, object] = {c: None for c in columns}
    for r in best.collect():
        name = columns[r["pos"]]
        dtype = df.schema[name].dataType
        if is_text(dtype):
            out[name] = r["text"]
        elif is_real(dtype):
            out[name] = r["real"]
        elif is_moment(dtype):
            out[name] = r["ts"]
        elif is_whole(dtype):
            out[name] = r["whole"]
        else:
            out[name] = bool(r["whole"])
    return out
