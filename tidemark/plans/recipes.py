"""Preparation recipes: registry, fit on training rows, apply to any rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import q
from ..operators.chained import fit_chained
from ..operators.counts import modes
from ..operators.gram import centred_products
from ..operators.mutual_info import best_features
from ..operators.neighbours import knn_impute
from ..operators.quantiles import exact_quantiles
from ..operators.smote import oversample

ORIGIN = "_row_origin"
SELECT_COUNT = 10
COMPONENTS = 5
_KEEP_SHARE = 0.5
_KEEP_ROWS = 10


@dataclass(frozen=True)
class Recipe:
    name: str
    purpose: str
    impute: str                     # mean | median | most_frequent | knn | iterative
    scale: str | None = None        # standard | minmax | robust
    rows: str | None = None         # iqr | zscore
    select: bool = False
    pca: bool = False
    smote: bool = False
    variance: bool = False
    core: bool = True

    def output_width(self, d: int) -> int:
        """Features after selection and projection."""
        if self.select:
            d = min(d, SELECT_COUNT)
        return min(d, COMPONENTS) if self.pca else d

    def steps(self, d: int) -> list[str]:
        """Stage names in the order they run."""
        plan = [
            ("impute", True), ("variance", self.variance), ("outliers", bool(self.rows)), ("smote", self.smote),
            ("scale", bool(self.scale)), ("select", self.select and d > SELECT_COUNT), ("pca", self.pca),
        ]
        return [name for name, on in plan if on]


# The eight recipes.
RECIPES = {
    r.name: r
    for r in [
        Recipe("phalanx", "general purpose, moderate gaps", "median", "standard", rows="iqr"),
        Recipe("skirmisher", "many features per row", "mean", "standard", select=True),
        Recipe("heavy_cavalry", "strongly correlated features", "median", "robust", rows="zscore", pca=True),
        Recipe("guerrilla", "imbalanced classes", "most_frequent", "standard", smote=True),
        Recipe("scorched_earth", "strongest preparation", "median", "robust", rows="iqr", select=True, pca=True),
        Recipe("reconnaissance", "clean data, little change", "mean"),
        Recipe("siege", "complex gaps, structured data", "knn", "minmax", variance=True, core=False),
        Recipe("diplomat", "interdependent features", "iterative", "standard", core=False),
    ]
}


def recipe_names(include_extras: bool = True) -> list[str]:
    return [r.name for r in RECIPES.values() if include_extras or r.core]


def recipe_table(spark) -> DataFrame:
    rows = [
        (i, r.name, r.purpose, r.impute, r.scale, r.rows, r.select, r.pca, r.smote, r.variance, r.core)
        for i, r in enumerate(RECIPES.values())
    ]
    return spark.createDataFrame(
        rows,
        "idx int, recipe string, purpose string, impute string, scale string, row_filter string, "
        "feature_select boolean, pca boolean, smote boolean, variance boolean, core boolean",
    )


Step = Callable[[DataFrame], DataFrame]


def _replace(df: DataFrame, exprs: dict[str, Column], drop: list[str] = ()) -> DataFrame:
    """One projection that swaps feature columns and keeps all others."""
    return df.select(*[exprs[c].alias(c) if c in exprs else q(c) for c in df.columns if c not in drop])


def fit_impute(train: DataFrame, features: list[str], kind: str) -> tuple[Step, list[str]]:
    """Imputer and the features left: columns never observed in training are dropped."""
    present = train.agg(*[F.count(q(f)) for f in features]).first()
    kept = [f for f, k in zip(features, present) if k]
    gone = [f for f in features if f not in kept]
    if kind in ("knn", "iterative"):
        if kind == "knn":
            return lambda df: knn_impute(df.drop(*gone), train, kept), kept
        model = fit_chained(train, kept)
        return lambda df: model.apply(df.drop(*gone)), kept
    if kind == "median":
        fills = {f: v[0] for f, v in exact_quantiles(train, {f: q(f) for f in kept}, [0.5]).items()}
    elif kind == "mean":
        fills = dict(zip(kept, train.agg(*[F.avg(q(f)) for f in kept]).first()))
    elif kind == "most_frequent":
        fills = modes(train, kept)
    else:
        raise ValueError(f"unknown imputation {kind!r}")
    exprs = {f: F.coalesce(q(f).cast("double"), F.lit(float(fills[f]))) for f in kept}
    return lambda df: _replace(df, exprs, gone), kept


def fit_variance(train: DataFrame, features: list[str]) -> list[str]:
    """Features with any spread."""
    row = train.agg(*[F.min(q(f)) < F.max(q(f)) for f in features]).first()
    kept = [f for f, spread in zip(features, row) if spread]
    if not kept:
        raise ValueError("no feature has any variance")
    return kept


def fit_row_filter(train: DataFrame, features: list[str], target: str, kind: str) -> tuple[Column | None, int, int]:
    """(condition, rows, rows kept). The condition is None when the guard keeps all rows."""
    if kind == "iqr":
        bounds = {}
        for f, (q1, q3) in exact_quantiles(train, {f: q(f) for f in features}, [0.25, 0.75]).items():
            bounds[f] = (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        inside = [q(f).between(F.lit(lo), F.lit(hi)) for f, (lo, hi) in bounds.items()]
    elif kind == "zscore":
        row = train.agg(*[g(q(f)) for f in features for g in (F.avg, F.stddev_pop)]).first()
        inside = [F.abs((q(f) - row[2 * i]) / (row[2 * i + 1] or 1.0)) < 3 for i, f in enumerate(features)]
    else:
        raise ValueError(f"unknown row filter {kind!r}")
    keep = inside[0]
    for c in inside[1:]:
        keep = keep & c
    per_class = train.groupBy(q(target)).agg(F.count(F.lit(1)).alias("n"), F.count_if(keep).alias("k"))
    n, kept, least = per_class.agg(F.sum("n"), F.sum("k"), F.min("k")).first()
    if kept < max(_KEEP_ROWS, int(_KEEP_SHARE * n)) or least == 0:
        return None, n, n
    return keep, n, kept


def fit_scale(train: DataFrame, features: list[str], kind: str) -> dict[str, tuple[float, float]]:
    """(centre, scale) per feature; a zero scale becomes 1."""
    if kind == "robust":
        qs = exact_quantiles(train, {f: q(f) for f in features}, [0.25, 0.5, 0.75])
        return {f: (med, (q3 - q1) or 1.0) for f, (q1, med, q3) in qs.items()}
    pair = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[kind]
    row = train.agg(*[g(q(f)) for f in features for g in pair]).first()
    out = {}
    for i, f in enumerate(features):
        a, b = row[2 * i], row[2 * i + 1]
        out[f] = (a, (b if kind == "standard" else b - a) or 1.0)
    return out


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return _replace(df, {f: (q(f) - F.lit(c)) / F.lit(s) for f, (c, s) in params.items()})


@dataclass
class Components:
    """Centred principal axes; the largest loading of each axis is positive."""

    features: list[str]
    means: list[float]
    axes: np.ndarray            # components x features
    variances: list[float]

    @property
    def names(self) -> list[str]:
        return [f"pc_{i + 1}" for i in range(len(self.axes))]

    def apply(self, df: DataFrame) -> DataFrame:
        out = []
        for axis in self.axes:
            expr = None
            for f, m, w in zip(self.features, self.means, axis):
                term = (q(f) - F.lit(float(m))) * F.lit(float(w))
                expr = term if expr is None else expr + term
            out.append(expr)
        others = [c for c in df.columns if c not in self.features]
        return df.select(*[q(c) for c in others], *[e.alias(n) for e, n in zip(out, self.names)])


def fit_pca(train: DataFrame, features: list[str], components: int = COMPONENTS) -> Components:
    row = train.agg(F.count(F.lit(1)), *[F.avg(q(f)) for f in features]).first()
    n, means = row[0], [float(m) for m in row[1:]]
    cov = centred_products(train, features, means) / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(values)[::-1][: min(components, len(features))]
    axes = vectors[:, top].T
    for axis in axes:
        if axis[int(np.argmax(np.abs(axis)))] < 0:
            axis *= -1
    return Components(features, means, axes, [float(max(values[i], 0.0)) for i in top])


@dataclass
class FittedRecipe:
    """Learnt stages. ``transform`` never drops or adds rows."""

    recipe: Recipe
    features: list[str]
    stages: list[Step] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage(df)
        return df


def fit_recipe(
    train: DataFrame,
    features: list[str],
    target: str,
    recipe: Recipe,
    ids: list[str] | None = None,
    seed: int = 42,
    imputed: tuple[Step, list[str]] | None = None,
) -> tuple[FittedRecipe, DataFrame, dict]:
    """(fitted stages, prepared training rows, row counts).

    Row filters and oversampling act on the training rows only. ``imputed`` shares
    a fitted imputer between recipes on the same rows. The expensive imputers are
    written out once, because every later stage reads their result.
    """
    from ..session import materialise

    step, features = imputed or fit_impute(train, features, recipe.impute)
    stages = [step]
    rows = step(train).withColumn(ORIGIN, F.lit("original"))
    if recipe.impute in ("knn", "iterative"):
        rows = materialise(rows, "imputed")
    counts = {"removed": 0, "synthetic": 0}
    if recipe.variance:
        kept = fit_variance(rows, features)
        gone = [f for f in features if f not in kept]
        if gone:
            stages.append(lambda df, gone=gone: df.drop(*gone))
            rows = rows.drop(*gone)
        features = kept
    if recipe.rows:
        keep, n, left = fit_row_filter(rows, features, target, recipe.rows)
        if keep is not None:
            rows = rows.where(keep)
        counts["removed"] = n - left
    if recipe.smote:
        made, sizes = oversample(rows, features, target, ids, seed)
        grown = sizes.agg(F.max("_size") * F.count(F.lit(1)) - F.sum("_size")).first()[0]
        counts["synthetic"] = grown
        if grown:
            rows = materialise(
                rows.unionByName(made.withColumn(ORIGIN, F.lit("synthetic")), allowMissingColumns=True), "grown"
            )
    if recipe.scale:
        params = fit_scale(rows, features, recipe.scale)
        stages.append(lambda df, p=params: apply_scale(df, p))
        rows = apply_scale(rows, params)
    if recipe.select and len(features) > SELECT_COUNT:
        best = best_features(rows, features, target, SELECT_COUNT)
        gone = [f for f in features if f not in best]
        stages.append(lambda df, gone=gone: df.drop(*gone))
        rows, features = rows.drop(*gone), best
    if recipe.pca:
        axes = fit_pca(rows, features)
        stages.append(axes.apply)
        rows, features = axes.apply(rows), axes.names
    return FittedRecipe(recipe, features, stages), rows, counts


ENHANCE_SCHEMA = (
    "recipe string, input_rows bigint, input_columns int, output_rows bigint, output_columns int, "
    "synthetic_rows bigint, removed_rows bigint, steps array<string>"
)


def guard_reserved(columns: list[str]) -> None:
    if ORIGIN in columns:
        raise ValueError(f"{ORIGIN} is reserved for row provenance")


def enhance(
    df: DataFrame, recipe: str, target: str, ids: list[str] | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Apply one recipe to all rows: features, target and row origin, plus a metrics row.

    ``ids`` name rows for reproducible oversampling; they are not features and are
    left out of the result. A table that fails a check of ``validate_classification`` (missing labels, a class of one row, ...)
    is refused with that check's message.
    """
    if recipe not in RECIPES:
        raise ValueError(f"unknown recipe: {recipe}")
    guard_reserved(df.columns)
    from .validation import numeric_features, require_classification

    require_classification(df, target, 2, ids)
    r = RECIPES[recipe]
    features = numeric_features(df, target, ids)
    base = df.select(*[q(c) for c in dict.fromkeys([*(ids or []), *features, target])])
    n = base.count()
    fitted, rows, counts = fit_recipe(base, features, target, r, ids, seed)
    table = rows.select(*[q(f) for f in fitted.features], q(target), ORIGIN)
    out_rows = n - counts["removed"] + counts["synthetic"]
    metrics = (
        recipe, n, len(features) + 1, out_rows, len(table.columns), counts["synthetic"], counts["removed"],
        r.steps(len(features)),
    )
    return table, df.sparkSession.createDataFrame([metrics], ENHANCE_SCHEMA)
