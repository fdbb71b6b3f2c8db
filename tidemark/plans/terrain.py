"""Characterisation of a labelled numeric table: one row of facts and what follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.scalars import q
from ..operators.gram import correlation_matrix

FACTS_SCHEMA = (
    "n_samples bigint, n_features int, missing_ratio double, class_balance double, dim_ratio double, "
    "mean_abs_correlation double, minority_count bigint"
)

# Short name of an axis, its fact, limit, side of the limit that is high, tag and recipe where it is high.
AXES = [
    ("dim", "dim_ratio", 0.10, "above", "high_dimensional", "skirmisher"),
    ("miss", "missing_ratio", 0.05, "above", "severe_missing", "phalanx"),
    ("bal", "class_balance", 0.50, "below", "imbalanced", "guerrilla"),
    ("corr", "mean_abs_correlation", 0.70, "above", "high_correlation", "heavy_cavalry"),
]
# The tag of few gaps (it follows the one of many), that of a table without any tag, and the recipe of the rest.
FEW_GAPS, NO_TAG, PLAIN_RECIPE = "some_missing", "well_behaved", "phalanx"


def _high(fact: str, limit: float, side: str) -> Column:
    return F.col(fact) > limit if side == "above" else F.col(fact) < limit


def described(facts: DataFrame) -> DataFrame:
    """Adds signature, tags and default_recipe to rows of facts."""
    tags, recipe, levels = [], None, []
    for short, fact, limit, side, tag, choice in AXES:
        high = _high(fact, limit, side)
        levels.append(F.concat(F.lit(f"{short}:"), F.when(high, "hi").otherwise("lo")))
        tags.append(F.when(high, tag))
        if fact == "missing_ratio":
            tags.append(F.when(~high & (F.col(fact) > 0), FEW_GAPS))
        recipe = F.when(high, choice) if recipe is None else recipe.when(high, choice)
    found = F.array_compact(F.array(*tags))
    return facts.withColumns({
        "signature": F.concat_ws("|", *levels),
        "tags": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NO_TAG))),
        "default_recipe": recipe.otherwise(PLAIN_RECIPE),
    })


def terrain_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """One row from three small results: gaps and means, class sizes, correlations of mean-filled columns."""
    row = df.agg(F.count(F.lit(1)), *[F.count(q(c)) for c in features], *[F.avg(q(c)) for c in features]).first()
    n, d = row[0], len(features)
    present, means = row[1 : 1 + d], row[1 + d :]
    sizes = df.groupBy(q(target)).count().agg(F.min("count"), F.max("count")).first()
    filled = df.select(*[F.coalesce(q(c).cast("double"), F.lit(m)).alias(c) for c, m in zip(features, means)])
    corr = correlation_matrix(filled, features, list(means), n) if d > 1 else None
    pairs = [] if corr is None else [abs(v) for i, r in enumerate(corr) for j, v in enumerate(r) if i != j and v == v]
    facts = (
        n, d, sum(n - k for k in present) / (n * d), sizes[0] / sizes[1], d / n,
        sum(pairs) / len(pairs) if pairs else 0.0, sizes[0],
    )
    return described(df.sparkSession.createDataFrame([facts], FACTS_SCHEMA))


def characterize(df: DataFrame, features: list[str], target: str) -> Row:
    """The row of ``terrain_table``."""
    return terrain_table(df, features, target).first()
