"""Cross-product sums of numeric columns: the only thing correlation, PCA and regression need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import q

_BUILT_IN_WIDTH = 12


def centred_products(df: DataFrame, features: list[str], centres: list[float | None]) -> np.ndarray:
    """Sum over rows of (x - centre)(x - centre)^T as a d x d array; no missing cells.

    Narrow tables use plain ``sum`` aggregates. Wide ones reduce each Arrow batch
    to one d x d block inside the tasks, and the blocks are added by Spark.
    """
    d = len(features)
    mid = [0.0 if c is None else float(c) for c in centres]
    x = df.select(*[(q(f).cast("double") - F.lit(m)).alias(f"x{i}") for i, (f, m) in enumerate(zip(features, mid))])
    if d <= _BUILT_IN_WIDTH:
        cells = [(i, j) for i in range(d) for j in range(i, d)]
        row = x.agg(*[F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in cells]).first()
        out = np.zeros((d, d))
        for (i, j), v in zip(cells, row):
            out[i, j] = out[j, i] = v or 0.0
        return out

    def blocks(batches: Iterator) -> Iterator:
        import pandas as pd

        total = np.zeros((d, d))
        for pdf in batches:
            m = pdf.to_numpy(dtype=float)
            total += m.T @ m
        yield pd.DataFrame({"block": [total.ravel()]})

    return sum_blocks(x.mapInPandas(blocks, "block array<double>"), d * d).reshape(d, d)


def sum_blocks(blocks: DataFrame, size: int) -> np.ndarray:
    """Element-wise sum of array rows; partial sums are combined map-side."""
    cells = blocks.select(F.posexplode("block").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in cells:
        out[r["i"]] = r["v"]
    return out


def correlation_matrix(df: DataFrame, features: list[str], means: list[float], n: int) -> list[list[float]]:
    """Pearson matrix; NaN where a column has no spread."""
    products = centred_products(df, features, means)
    scale = np.sqrt(np.diag(products))
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = products / np.outer(scale, scale)
    corr[~np.isfinite(corr)] = np.nan
    return np.clip(corr, -1.0, 1.0).tolist()
