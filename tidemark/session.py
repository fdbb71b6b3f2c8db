"""Session helpers: where intermediate tables go, and how cells enter."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .functions.scalars import q

_DIR_SETTING = "spark.checkpoint.dir"


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder of the cluster; a local one only where none is configured."""
    folder = spark.conf.get(_DIR_SETTING, None) or spark.sparkContext.getConf().get(_DIR_SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_DIR_SETTING} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(_DIR_SETTING, folder)
    return folder


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage so that later passes survive lost executors and do not repeat
    the shuffles behind ``df``; the copy is columnar, so they still prune.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_real(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType))


def is_number(dtype: T.DataType) -> bool:
    return is_whole(dtype) or is_real(dtype)


def is_moment(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_flag(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.BooleanType)


def on_entry(df: DataFrame) -> DataFrame:
    """One notion of missing: NaN becomes NULL. Nested columns are refused."""
    out = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name))
            changed = True
        elif is_text(f.dataType) or is_number(f.dataType) or is_moment(f.dataType) or is_flag(f.dataType):
            out.append(q(f.name))
        else:
            raise ValueError(f"column {f.name!r} has unsupported type {f.dataType.simpleString()}")
    return df.select(*out) if changed else df
