"""Tables and files that tasks share, below the folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there and a lost executor costs nothing.

    Its shuffle files go with the write. Else they stay until the driver happens to collect its garbage, and a query of many steps holds those of all.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
