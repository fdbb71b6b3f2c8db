"""Run history (signature, recipe, n, mean) as Parquet versions.

A version is a folder of its own. It counts once the claim for its number names it: a small file that can be made only once, whoever
is first. Who comes second reads the new version and adds its scores to that.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

HISTORY_SCHEMA = "signature string, recipe string, n bigint, mean double"
_CLAIMS = "_claims"
_ATTEMPTS = 50
# What Spark's reader says of files that are cut off or no Parquet at all.
_DAMAGE = ("is not a Parquet file", "Could not read footer", "CANNOT_READ_FILE_FOOTER", "corrupt", "EOFException", "Expected magic")


def empty_history(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], HISTORY_SCHEMA)


def _store(spark: SparkSession, path: str):
    """The file system of a path, and paths on it."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _claimed(spark: SparkSession, path: str) -> dict[int, str]:
    """Number -> folder of every version that was claimed."""
    fs, make = _store(spark, path)
    folder = make(f"{path.rstrip('/')}/{_CLAIMS}")
    found = {}
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        if m := re.fullmatch(r"v(\d{8})", s.getPath().getName()):
            file = fs.open(s.getPath())
            try:
                found[int(m[1])] = bytes(file.readAllBytes()).decode()
            finally:
                file.close()
    return found


def _claim(spark: SparkSession, path: str, number: int, folder: str) -> bool:
    """Make ``folder`` the version of that number, unless another one is. The claim appears whole or not at all."""
    fs, make = _store(spark, path)
    claims = f"{path.rstrip('/')}/{_CLAIMS}"
    fs.mkdirs(make(claims))
    draft, claim = make(f"{claims}/draft-{uuid.uuid4().hex}"), make(f"{claims}/v{number:08d}")
    out = fs.create(draft, False)
    out.write(bytearray(folder.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a rename would replace the other claim there, a link does not
            files, paths = spark._jvm.java.nio.file.Files, spark._jvm.java.nio.file.Path
            local = lambda p: paths.of(make(p.toUri().getPath()).toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.String, 0))
            try:
                files.createLink(local(claim), local(draft))
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                return False
            return True
        return not fs.exists(claim) and fs.rename(draft, claim)
    finally:
        fs.delete(draft, False)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions in order; a number without a claim stands for the folders of that number."""
    fs, make = _store(spark, path)
    if not fs.exists(make(path)):
        return []
    claimed = _claimed(spark, path)
    found = []
    for s in fs.listStatus(make(path)):
        m = re.fullmatch(r"v(\d{8})-[0-9a-f]+", s.getPath().getName())
        if m and s.isDirectory() and claimed.get(int(m[1]), s.getPath().getName()) == s.getPath().getName():
            if fs.exists(make(s.getPath(), "_SUCCESS")):
                found.append(s.getPath().toString())
    return sorted(found)


def _next_number(spark: SparkSession, path: str) -> int:
    taken = [int(re.search(r"/v(\d{8})-[0-9a-f]+/?$", v)[1]) for v in _versions(spark, path)]
    return max([0, *taken, *_claimed(spark, path)]) + 1


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Latest complete version that can be read; damaged ones are passed over, a missing store is empty.

    Any other failure (access, network) is raised: what was learnt must not be taken for gone and overridden.
    """
    for version in reversed(_versions(spark, path)):
        table = spark.read.schema(HISTORY_SCHEMA).parquet(version)
        try:
            table.agg(F.count("signature"), F.sum("n"), F.sum("mean")).collect()
        except Exception as e:  # noqa: BLE001 - sorted out by what it says
            if not any(sign in str(e) for sign in _DAMAGE):
                raise
        else:
            return table
    return empty_history(spark)


def _write(history: DataFrame, path: str, number: int) -> str:
    target = f"{path.rstrip('/')}/v{number:08d}-{uuid.uuid4().hex[:8]}"
    history.write.parquet(target)
    return target


def save_history(history: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, whatever they hold; readers switch once it is complete."""
    spark = history.sparkSession
    for _ in range(_ATTEMPTS):
        number = _next_number(spark, path)
        target = _write(history, path, number)
        if _claim(spark, path, number, target.rsplit("/", 1)[1]):
            return target
    raise RuntimeError(f"{path}: other writers were first {_ATTEMPTS} times")


def commit_scores(scores: DataFrame, path: str) -> DataFrame:
    """Fold (signature, recipe, reward) rows into the newest version and return the result.

    If another writer commits meanwhile, its version is read and the scores are folded into that: no update is lost.
    """
    spark = scores.sparkSession
    for _ in range(_ATTEMPTS):
        number = _next_number(spark, path)
        target = _write(update_history(load_history(spark, path), scores), path, number)
        if _claim(spark, path, number, target.rsplit("/", 1)[1]):
            return spark.read.schema(HISTORY_SCHEMA).parquet(target)
    raise RuntimeError(f"{path}: other writers were first {_ATTEMPTS} times")


def update_history(history: DataFrame, scores: DataFrame) -> DataFrame:
    """Fold (signature, recipe, reward) rows into the running means."""
    fresh = scores.select("signature", "recipe", F.lit(1).cast("bigint").alias("n"), F.col("reward").alias("mean"))
    return (
        history.select("signature", "recipe", "n", "mean").unionByName(fresh)
        .groupBy("signature", "recipe")
        .agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_m"), F.sum("n").alias("n"))
        .select("signature", "recipe", "n", F.col("_m").alias("mean"))
    )
