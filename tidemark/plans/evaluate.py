"""Shared folds, leak-free scores and the composite index."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import gaussian, hash52, q
from ..operators.ranks import ROWS_PER_BUCKET, hashed_rank, row_identity
from ..session import materialise
from .recipes import RECIPES, Recipe, fit_impute, fit_recipe, fit_row_filter, recipe_names
from .validation import class_values, label_of

# Weights of the composite index and the simplicity penalty.
WEIGHT_ACCURACY = 0.40
WEIGHT_STABILITY = 0.25
WEIGHT_RETENTION = 0.20
WEIGHT_SIMPLICITY = 0.15
SIMPLICITY_PENALTY = 0.05

FOLD = "_fold"
SCORE_SCHEMA = (
    "idx int, recipe string, fold int, rows bigint, correct bigint, retention double, n_after bigint, "
    "d_before int, d_after int, error string"
)
_WINDOW_LIMIT = 1000        # Spark prunes row_number() <= k per task up to this k


def stratified_folds(
    df: DataFrame,
    target: str,
    ids: list[str] | None = None,
    folds: int = 3,
    seed: int = 42,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``_fold``: classes are spread evenly (+-1), in hash order of the row identity."""
    n = df.count()
    ranked = hashed_rank(df, [target], row_identity(df, ids), seed, n, "_rank", rows_per_bucket)
    return ranked.withColumn(FOLD, ((F.col("_rank") - 1) % folds).cast("int")).drop("_rank")


def sample_quotas(counts: dict, rows: int) -> dict:
    """Rows per class for a proportional sample: largest remainder, class order on ties."""
    total = sum(counts.values())
    exact = {c: n * rows / total for c, n in counts.items()}
    quota = {c: int(v) for c, v in exact.items()}
    by_rest = sorted(exact, key=lambda c: quota[c] - exact[c])
    for c in by_rest[: rows - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_sample(
    df: DataFrame, target: str, rows: int, ids: list[str] | None = None, seed: int = 42
) -> DataFrame:
    """``rows`` rows with class proportions kept; the whole table when it is not larger."""
    classes = class_values(df, target)
    counts = {r["t"]: r["n"] for r in df.groupBy(q(target).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if n <= rows:
        return df
    quota = sample_quotas({c: counts[c] for c in classes}, rows)
    allowed = F.element_at(F.create_map(*[x for c, k in quota.items() for x in (F.lit(c), F.lit(k))]), q(target))
    identity = row_identity(df, ids)
    most = max(quota.values())
    if most <= _WINDOW_LIMIT:
        # A literal limit lets every task keep only its own best rows before the shuffle.
        order = [hash52(seed, *identity), *identity]
        ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(q(target)).orderBy(*order)))
        ranked = ranked.where(F.col("_rank") <= most)
    else:
        ranked = hashed_rank(df, [target], identity, seed, n)
    return ranked.where(F.col("_rank") <= allowed).drop("_rank")


def make_classifier(kind: str | Estimator, n: int, seed: int = 42, trees: int = 50, depth: int = 10):
    """``logreg`` (unit L2 penalty on the summed loss of ``n`` training rows), ``rf``, or any Spark ML classifier.

    A classifier passed as an object keeps its settings; only its columns are set. ``depth`` bounds what a forest costs;
    Spark ML allows 30 at most.
    """
    if isinstance(kind, Estimator):
        return kind.copy({kind.getParam("featuresCol"): "_x", kind.getParam("labelCol"): "_y"})
    if kind == "logreg":
        return LogisticRegression(
            featuresCol="_x", labelCol="_y", maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False
        )
    if kind == "rf":
        return RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
    raise ValueError(f"unknown classifier {kind!r}")


def model_input(df: DataFrame, features: list[str], target: str, classes: list) -> DataFrame:
    return df.select(
        array_to_vector(F.array(*[q(f).cast("double") for f in features])).alias("_x"),
        label_of(q(target), classes).alias("_y"),
    )


def simplicity(d_after: Column, d_before: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + SIMPLICITY_PENALTY * F.abs(d_after - d_before))


def composite(accuracy: Column, stability: Column, retention: Column, simple: Column) -> Column:
    return (
        WEIGHT_ACCURACY * accuracy + WEIGHT_STABILITY * stability
        + WEIGHT_RETENTION * retention + WEIGHT_SIMPLICITY * simple
    )


@dataclass
class FoldShare:
    """Imputers fitted once per (kind, fold) and shared by the recipes that use them."""

    lock: threading.Lock = field(default_factory=threading.Lock)
    slots: dict = field(default_factory=dict)

    def imputer(self, key: tuple, fit):
        with self.lock:
            slot = self.slots.setdefault(key, {"lock": threading.Lock()})
        with slot["lock"]:
            if "value" not in slot:
                slot["value"] = fit()
            return slot["value"]


def score_fold(df, features, target, classes, recipe: Recipe, fold: int, classifier, ids, seed, share, size) -> tuple[int, int]:
    """(rows, correct) on one held-out fold; everything is fitted on the other folds."""
    train, test = df.where(F.col(FOLD) != fold).drop(FOLD), df.where(F.col(FOLD) == fold).drop(FOLD)
    imputed = share.imputer((recipe.impute, fold), lambda: fit_impute(train, features, recipe.impute))
    fitted, rows, _ = fit_recipe(train, features, target, recipe, ids, seed, imputed)
    data = model_input(rows, fitted.features, target, classes)
    model = make_classifier(classifier, rows.count() if classifier == "logreg" else 1, seed, **size).fit(data)
    scored = model.transform(model_input(fitted.transform(test), fitted.features, target, classes))
    row = scored.agg(F.count(F.lit(1)), F.count_if(F.col("prediction") == F.col("_y"))).first()
    return row[0], row[1]


def retention(df, features, target, recipe: Recipe, share) -> tuple[float, int, int]:
    """(share, rows kept, rows) that survive the recipe's row filter on the whole imputed table."""
    n = df.count()
    if recipe.rows is None:
        return 1.0, n, n
    step, kept_features = share.imputer((recipe.impute, "all"), lambda: fit_impute(df, features, recipe.impute))
    _, _, kept = fit_row_filter(step(df), kept_features, target, recipe.rows)
    return min(1.0, kept / n), kept, n


def score_recipes(
    df: DataFrame,
    features: list[str],
    target: str,
    names: list[str],
    classifier: str | Estimator = "rf",
    ids: list[str] | None = None,
    folds: int = 3,
    seed: int = 42,
    parallel: int = 4,
    **size: int,
) -> DataFrame:
    """One row per recipe and fold. ``df`` carries ``_fold``; a failing recipe keeps its error text.

    ``size`` is ``trees`` and ``depth`` of a forest.

    The fold jobs are independent and run from a small pool of driver threads.
    """
    df = materialise(df, "folded")  # hundreds of jobs read it, and each would rank all rows anew
    classes = class_values(df, target)
    share = FoldShare()
    d = len(features)
    whole = df.drop(FOLD)

    def attempt(job, *args):
        """(result, error text)"""
        try:
            return job(*args), ""
        except Exception as exc:  # noqa: BLE001 - one recipe must not end the sweep
            return None, f"{type(exc).__name__}: {str(exc).splitlines()[0] if str(exc) else ''}"

    def one_fold(name: str, kept, k: int) -> tuple:
        error = kept.result()[1]
        if error:
            return None, error
        return attempt(score_fold, df, features, target, classes, RECIPES[name], k, classifier, ids, seed, share, size)

    # Folds of one recipe run side by side too: oversampling takes as long as all other recipes together, in many short stages.
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        kept = {n: pool.submit(attempt, retention, whole, features, target, RECIPES[n], share) for n in names}
        scored = {n: [pool.submit(one_fold, n, kept[n], k) for k in range(folds)] for n in names}
    rows = []
    for name in names:
        idx, after = list(RECIPES).index(name), RECIPES[name].output_width(d)
        share_kept, n_after, _ = kept[name].result()[0] or (1.0, 0, 0)
        results = [f.result() for f in scored[name]]
        error = next((text for _, text in results if text), "")
        for k, (counted, _) in enumerate(results):
            rows.append((idx, name, k, *((0, 0) if error else counted), share_kept, n_after, d, after, error))
    return df.sparkSession.createDataFrame(rows, SCORE_SCHEMA)


def combine_scores(fold_rows: DataFrame) -> DataFrame:
    """Per recipe: accuracy, stability, retention, simplicity and the composite index."""
    acc = F.try_divide(F.col("correct"), F.col("rows"))
    per = fold_rows.groupBy("idx", "recipe").agg(
        F.coalesce(F.avg(acc), F.lit(0.0)).alias("accuracy"),
        F.coalesce(1 - F.stddev_pop(acc), F.lit(0.0)).alias("stability"),
        F.max("retention").alias("retention"),
        F.max("n_after").alias("n_after"),
        F.max("d_before").alias("d_before"),
        F.max("d_after").alias("d_after"),
        F.max("error").alias("error"),
    )
    failed = F.col("error") != ""
    simple = simplicity(F.col("d_after"), F.col("d_before"))
    total = composite(F.col("accuracy"), F.col("stability"), F.col("retention"), simple)
    return per.select(
        "idx", "recipe",
        F.when(failed, 0.0).otherwise(total).alias("sei"),
        F.when(failed, 0.0).otherwise(F.col("accuracy")).alias("accuracy"),
        F.when(failed, 0.0).otherwise(F.col("stability")).alias("stability"),
        "retention", simple.alias("simplicity"), "n_after", "d_after", "error",
    )


def scoreboard(scores: DataFrame) -> DataFrame:
    """Ranked and rounded; equal scores keep registry order. At most one row per recipe."""
    order = Window.orderBy(F.desc("sei"), "idx")
    return scores.select(
        F.row_number().over(order).alias("rank"), "recipe",
        F.round("sei", 4).alias("sei"), F.round("accuracy", 4).alias("accuracy"),
        F.round("stability", 4).alias("stability"), F.round("retention", 3).alias("retention"),
        F.round("simplicity", 3).alias("simplicity"), "error",
    )


def add_noise(df: DataFrame, features: list[str], sigma: float, ids: list[str] | None, seed: int, turn: int) -> DataFrame:
    """Add N(0, sigma) to every feature cell, from hashes of (seed, round, column, row)."""
    identity = row_identity(df, ids)
    swap = {f: q(f).cast("double") + sigma * gaussian(seed, turn, f, *identity) for f in features}
    return df.select(*[swap[c].alias(c) if c in swap else q(c) for c in df.columns])


__all__ = [
    "stratified_folds", "stratified_sample", "score_recipes", "combine_scores", "scoreboard", "add_noise",
    "sample_quotas", "make_classifier", "model_input", "recipe_names",
]
