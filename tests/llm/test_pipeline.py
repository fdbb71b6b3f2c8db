import time

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm.queries import ORACLES, QUERIES


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), f"test-{name}")
        assert out.columns == docs.columns and 0 < out.count() <= 2 * docs.count()
        if name == "quality-rules":
            assert out.join(docs, docs.columns, "left_anti").count() == 0
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()


def test_shuffle_files_go_with_the_write(spark):
    """pipeline (F1): shuffle files of all steps stayed until the driver collected its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    rows = spark.range(20_000).repartition(3, F.xxhash64("id"))
    assert rows.count() == 20_000 and files() - before  # what an action of its own leaves
    before = files()
    out = corpus_pipeline.written(rows.groupBy((F.col("id") % 97).alias("k")).agg(F.count("*").alias("n")), "test-shuffled")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert ORACLES.keys() <= QUERIES.keys()
