"""Iterative imputation: each incomplete column regressed on all others, in rounds.

Rows with the same gaps are filled by one affine map of their observed cells, so the sums a
regression needs follow from the sums of observed cells per pattern of gaps. One scan of the
table takes those; no round reads a complete row again. Only the largest move of a round is
read from rows, and from incomplete ones alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import q
from ..session import materialise
from .gram import sum_blocks

#: Sums of all patterns (8 bytes each) up to which they are kept on the driver; more stay a table that every step reads.
MOST_SUMS = 2_000_000
#: Sums a task holds before it passes them on.
_TASK_SUMS = 4_000_000


@dataclass
class ChainedImputer:
    """Start values and the ordered regressions (feature, coefficients, intercept)."""

    features: list[str]
    start: list[float]
    steps: list[tuple[int, np.ndarray, float]] = field(default_factory=list)
    rounds: int = 0

    def fill(self, raw: np.ndarray) -> np.ndarray:
        """Replay every regression on a batch of rows."""
        gaps = np.isnan(raw)
        x = np.where(gaps, np.array(self.start), raw)
        for j, coef, intercept in self.steps:
            at = gaps[:, j]
            if at.any():
                x[at, j] = np.delete(x[at], j, axis=1) @ coef + intercept
        return x

    def apply(self, df: DataFrame) -> DataFrame:
        """Other columns pass as the Arrow columns they are, so that large whole numbers with gaps keep every digit."""
        casted = df.select(*[q(c).cast("double").alias(c) if c in self.features else q(c) for c in df.columns])
        places, imputer = [df.columns.index(c) for c in self.features], self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [batch.column(i).to_numpy(zero_copy_only=False) for i in places]
                x = imputer.fill(np.column_stack(raw).astype(float))
                columns = list(batch.columns)
                for k, i in enumerate(places):
                    columns[i] = pa.array(x[:, k], pa.float64(), from_pandas=True)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return casted.mapInArrow(run, casted.schema)


def _evidence_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> np.ndarray:
    """Bayesian ridge coefficients from centred sums (MacKay's evidence updates)."""
    prior = 1e-6
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ xy
    noise, weight = 1.0 / (yy / n + np.finfo(float).eps), 1.0
    coef = np.zeros(len(xy))
    for step in range(300):
        new = vectors @ (rotated / (values + weight / noise))
        rss = max(yy - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float((noise * values / (weight + noise * values)).sum())
        weight = (gamma + 2 * prior) / (float(new @ new) + 2 * prior)
        noise = (n - gamma + 2 * prior) / (rss + 2 * prior)
        if step and np.abs(new - coef).sum() < 1e-3:
            return new
        coef = new
    return coef


def fit_chained(
    train: DataFrame, features: list[str], rounds: int = 10, tolerance: float = 1e-3, most_sums: int = MOST_SUMS
) -> ChainedImputer:
    """Learn the regressions; columns with fewer gaps come first, at most ``rounds`` rounds.

    A column without any value starts at 0. ``most_sums`` decides where the sums lie, not what they are.
    """
    d = len(features)
    row = train.agg(
        F.count(F.lit(1)), *[F.count(q(f)) for f in features], *[F.avg(q(f)) for f in features],
        *[F.max(F.abs(q(f).cast("double"))) for f in features],
    ).first()
    n, present, means = row[0], row[1 : 1 + d], row[1 + d : 1 + 2 * d]
    largest = max((v for v in row[1 + 2 * d :] if v is not None), default=0.0)
    model = ChainedImputer(features, [0.0 if m is None else float(m) for m in means])
    order = [j for j in sorted(range(d), key=lambda j: n - present[j]) if 0 < present[j] < n]
    if not order or d < 2:
        return model
    raw = train.select(*[q(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)])
    sums = _PatternSums(raw, model, most_sums)
    incomplete = materialise(raw.where(" or ".join(f"x{i} is null or isnan(x{i})" for i in range(d))), "incomplete-rows")
    for _ in range(rounds):
        before = len(model.steps)
        for j in order:
            xx, xy, yy, mid, m = sums.regression(model, j)
            coef = _evidence_ridge(xx, xy, yy, m)
            model.steps.append((j, coef, float(mid[j] - np.delete(mid, j) @ coef)))
        model.rounds += 1
        if _largest_change(incomplete, model, before) < tolerance * largest:
            break
    return model


def _moved_steps(model: ChainedImputer, first: int) -> list[tuple[int, np.ndarray, float]]:
    """Steps from ``first`` on in coordinates whose origin is the start values."""
    start = np.array(model.start)
    return [(j, coef, c + float(np.delete(start, j) @ coef) - start[j]) for j, coef, c in model.steps[first:]]


def _start_maps(gaps: np.ndarray) -> np.ndarray:
    """For each pattern the map (d x d+1) from observed cells and 1 to the filled row; gaps begin at the origin."""
    p, d = gaps.shape
    maps = np.zeros((p, d, d + 1))
    maps[:, np.arange(d), np.arange(d)] = ~gaps
    return maps


def _advance(maps: np.ndarray, gaps: np.ndarray, steps: list[tuple[int, np.ndarray, float]]) -> None:
    for j, coef, constant in steps:
        at = np.flatnonzero(gaps[:, j])
        moved = np.einsum("k,pkl->pl", coef, np.delete(maps[at], j, axis=1))
        moved[:, -1] += constant
        maps[at, j] = moved


def _filled_sums(maps: np.ndarray, gaps: np.ndarray, sums: np.ndarray, j: int) -> np.ndarray:
    """Cross products of filled rows (and 1) over all patterns in which column ``j`` is observed."""
    seen, d = ~gaps[:, j], gaps.shape[1]
    one = np.zeros((int(seen.sum()), 1, d + 1))
    one[:, 0, d] = 1.0
    full = np.concatenate([maps[seen], one], axis=1)
    return np.einsum("pik,pkl,pjl->ij", full, sums[seen], full, optimize=True)


class _PatternSums:
    """Cross products of observed cells for each pattern of gaps, from one scan."""

    def __init__(self, raw: DataFrame, model: ChainedImputer, most_sums: int) -> None:
        self.d, self.done = len(model.features), 0
        self.table = materialise(_pattern_sums(raw, model.start), "pattern-sums")
        self.here = self.table.count() * (self.d + 1) ** 2 <= most_sums
        if self.here:
            self.gaps, self.sums = _unpacked(self.table.orderBy("gaps").toPandas(), self.d)
            self.maps = _start_maps(self.gaps)

    def regression(self, model: ChainedImputer, j: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, int]:
        """Centred cross products over the rows where column ``j`` was observed, and the means."""
        d = self.d
        if self.here:
            _advance(self.maps, self.gaps, _moved_steps(model, self.done))
            self.done = len(model.steps)
            s = _filled_sums(self.maps, self.gaps, self.sums, j)
        else:
            steps = _moved_steps(model, 0)

            def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                total = np.zeros((d + 1, d + 1))
                for pdf in batches:
                    gaps, sums = _unpacked(pdf, d)
                    maps = _start_maps(gaps)
                    _advance(maps, gaps, steps)
                    total += _filled_sums(maps, gaps, sums, j)
                yield pd.DataFrame({"block": [total.ravel()]})

            s = sum_blocks(self.table.mapInPandas(blocks, "block array<double>"), (d + 1) ** 2).reshape(d + 1, d + 1)
        n, mean = s[d, d], s[d, :d] / s[d, d]
        centred = s[:d, :d] - n * np.outer(mean, mean)
        others = [i for i in range(d) if i != j]
        return centred[np.ix_(others, others)], centred[others, j], float(centred[j, j]), mean + np.array(model.start), round(n)


def _unpacked(pdf: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.array([[c == "1" for c in g] for g in pdf["gaps"]], bool).reshape(-1, d)
    sums = np.array([np.asarray(v, float) for v in pdf["sums"]]).reshape(-1, d + 1, d + 1)
    return gaps, sums


def _pattern_sums(raw: DataFrame, start: list[float]) -> DataFrame:
    """(gaps, sums): one row for each pattern of gaps that occurs, ``1`` marking a gap.

    A task adds the rows of a pattern before anything is shuffled, so a pattern that all rows share is as
    many rows as there are tasks.
    """
    d, anchor = len(start), np.array(start)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, np.ndarray] = {}

        def out() -> pd.DataFrame:
            marks = ["".join("1" if b else "0" for b in key) for key in held]
            return pd.DataFrame({"gaps": marks, "sums": [v.ravel() for v in held.values()]})

        for pdf in batches:
            m = pdf.to_numpy(dtype=float)
            gaps = np.isnan(m)
            x = np.hstack([np.where(gaps, 0.0, m - anchor), np.ones((len(m), 1))])
            keys, which = np.unique(gaps, axis=0, return_inverse=True)
            which = which.ravel()
            order = np.argsort(which, kind="stable")
            cuts = np.searchsorted(which[order], np.arange(len(keys) + 1))
            for key, a, b in zip(keys, cuts[:-1], cuts[1:]):
                part = x[order[a:b]]
                mark = key.tobytes()
                held[mark] = held.get(mark, 0.0) + part.T @ part
            if len(held) * (d + 1) ** 2 > _TASK_SUMS:
                yield out()
                held.clear()
        if held:
            yield out()

    parts = raw.mapInPandas(partial, "gaps string, sums array<double>")
    added = parts.select("gaps", F.posexplode("sums").alias("i", "v")).groupBy("gaps", "i").agg(F.sum("v").alias("v"))
    listed = added.groupBy("gaps").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("cells"))
    return listed.select("gaps", F.transform("cells", lambda c: c["v"]).alias("sums"))


def _largest_change(raw: DataFrame, model: ChainedImputer, before: int) -> float:
    """Largest move of any filled cell in the latest round; ``raw`` needs only rows with gaps."""
    earlier = ChainedImputer(model.features, model.start, model.steps[:before])

    def moves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = 0.0
        for pdf in batches:
            m = pdf.to_numpy(dtype=float)
            if len(m):
                top = max(top, float(np.abs(model.fill(m) - earlier.fill(m)).max()))
        yield pd.DataFrame({"move": [top]})

    return raw.mapInPandas(moves, "move double").agg(F.max("move")).first()[0] or 0.0
