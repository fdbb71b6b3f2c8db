"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of ``parts`` partial scores over slices of the dimensions. First every block of
vectors gives, for each query, the leaders of each slice with their whole scores; the k-th best of them
all is a safe cutoff, because the k-th best score of the table is no less. The cutoffs go back with the queries.
A score that reaches a cutoff has a slice that reaches its even share of it, so each block then collects the
entries with such a slice, and resolves just these exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import written

#: Vectors in a block and queries in a block: what one task holds at once (a few MB each).
VECTOR_BLOCK, QUERY_BLOCK = 4096, 1024
_QUERIES = 128  # queries scored at once within a block


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id and whole: floor(scale * x) of every component as double; rows of null id, of a null vector or with a null or non-finite component are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("whole")
    )


def _packed(rows: DataFrame) -> DataFrame:
    """The rows in blocks: ids and a matrix as bytes, with its width; shorter vectors are filled up with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(lo, VECTOR_BLOCK)
                ids, lists = part.column("id").to_numpy(), part.column("whole")
                ends = lists.offsets.to_numpy().astype(np.int64)
                counts = np.diff(ends)
                matrix = np.zeros((len(ids), int(counts.max(initial=0))), np.int64)
                own = np.repeat(np.arange(len(ids)), counts)
                matrix[own, np.arange(counts.sum()) - np.repeat(ends[:-1] - ends[0], counts)] = lists.flatten().to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int64())],
                    names=["ids", "matrix", "width"],
                )

    return rows.mapInArrow(run, "ids binary, matrix binary, width long")


def _matrix(ids: bytes, data: bytes, width: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    matrix = np.frombuffer(data, np.int64).reshape(len(ids), width)
    return ids, np.pad(matrix, ((0, 0), (0, max(0, to - width))))


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers: by floating point where that is exact, else in 64-bit numbers."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64) if reach < 2**53 else q @ v.T


def _best(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query: high scores first, then small ids."""
    order = np.lexsort((vec, -score, query))
    sorted_query = query[order]
    starts = np.flatnonzero(np.diff(sorted_query, prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def top_k(
    vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, parts: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` best partners of each row whose id ``every`` divides.

    Partners are all rows of another id; equal scores go to the smaller id; fewer than k partners give fewer rows. Rows of null id, null vectors and
    vectors with null or non-finite components take no part; of vectors of unlike length the shorter counts as filled up with 0, an
    empty one scores 0. Repeated rows of one id are one query, and partners each. Other columns are ignored. The stated
    queries meet all rows in blocks; only k entries per query and block leave a task.
    """
    spark = vectors.sparkSession
    rows = written(whole_numbers(vectors, id_col, vector_col, scale), "vectors")
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("whole").alias("whole"))
    n = asked.count()
    n_blocks = max(1, -(-n // QUERY_BLOCK))
    blocks = written(_packed(rows), "vector-blocks")

    def query_blocks(cutoffs: DataFrame | None) -> DataFrame:
        own = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(n_blocks)))
        own = own.withColumn("cutoff", F.lit(None).cast("long")) if cutoffs is None else own.join(cutoffs, "id", "left")

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            width = max(map(len, frame["whole"]))
            matrix = np.zeros((len(frame), width), np.int64)
            for i, row in enumerate(frame["whole"]):
                matrix[i, : len(row)] = row
            low = np.iinfo(np.int64).min
            cut = np.array([low if pd.isna(c) else int(c) for c in frame["cutoff"]], np.int64)
            return pd.DataFrame({
                "q": [int(frame["q"].iloc[0])], "q_ids": [frame["id"].to_numpy(np.int64).tobytes()], "q_matrix": [matrix.tobytes()],
                "q_width": [width], "q_cut": [cut.tobytes()],
            })

        return written(
            own.groupBy("q").applyInPandas(pack, "q long, q_ids binary, q_matrix binary, q_width long, q_cut binary"), "query-blocks"
        )

    def paired(queries: DataFrame) -> DataFrame:
        return blocks.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(queries, "q").repartition(
            spark.sparkContext.defaultParallelism * 4
        )

    def scored(leaders: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for x in frame.itertuples(index=False):
                    width = max(x.width, x.q_width)
                    ids, v = _matrix(x.ids, x.matrix, x.width, width)
                    q_ids, q = _matrix(x.q_ids, x.q_matrix, x.q_width, width)
                    cut = np.frombuffer(x.q_cut, np.int64)
                    cuts = np.linspace(0, width, parts + 1).astype(int)
                    for lo in range(0, len(q), _QUERIES):
                        own = slice(lo, lo + _QUERIES)
                        slice_scores = [_scores(q[own, a:b], v[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
                        if leaders:
                            k_own = min(k + 1, len(ids))  # one more: the query itself may lead
                            take = [np.argpartition(-s, k_own - 1, axis=1)[:, :k_own] for s in slice_scores]
                            at = np.concatenate(take, axis=1)
                            i = np.repeat(np.arange(len(at)), at.shape[1])
                            pair = np.unique(i * len(ids) + at.reshape(-1))
                        else:
                            reach = np.zeros(slice_scores[0].shape, bool)
                            for s in slice_scores:
                                reach |= s * parts >= cut[own, None]
                            pair = np.flatnonzero(reach)
                        i, j = pair // len(ids), pair % len(ids)
                        score = sum(s[i, j] for s in slice_scores)
                        keep = (ids[j] != q_ids[own][i]) & (score >= cut[own][i])
                        i, j, score = i[keep], j[keep], score[keep]
                        best = _best(i, ids[j], score, k)
                        yield pd.DataFrame({"query_id": q_ids[own][i[best]], "vec_id": ids[j[best]], "score": score[best]})

        return run

    # The same partner can lead in two blocks only under one id, so ids need no check here.
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    first = paired(query_blocks(None)).mapInPandas(scored(True), "query_id long, vec_id long, score long")
    ranked = first.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    cutoffs = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("cutoff"))
    second = paired(query_blocks(written(cutoffs, "cutoffs"))).mapInPandas(scored(False), "query_id long, vec_id long, score long")
    ranked = second.withColumn("rank", F.row_number().over(place).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
WHERE rank <= 20
"""
