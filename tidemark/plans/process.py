"""Route a table: rank and enhance when it is a valid classification table, else clean."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.clean import Cleaned, clean
from .ranking import Ranking, rank_recipes
from .recipes import enhance
from .validation import MAX_CLASSES, validate_classification


@dataclass
class Processed:
    route: str                  # ranked | cleaned
    checks: DataFrame
    table: DataFrame
    metrics: DataFrame
    ranking: Ranking | None = None
    cleaned: Cleaned | None = None


def choose_route(checks: DataFrame) -> str:
    """Ranked when all checks pass and the classes fit the lookup of the ranking; else cleaned."""
    wide = (F.col("check") == "class_count") & (F.col("observed") > MAX_CLASSES)
    return "ranked" if checks.where(~F.col("passed") | wide).limit(1).count() == 0 else "cleaned"


def process(df: DataFrame, target: str | None = None, ids: list[str] | None = None, **ranking_options) -> Processed:
    """Cheap checks pick the branch before any heavy job runs."""
    names = [c for c in df.columns if c not in (ids or [])]
    target = target or names[-1]
    checks = validate_classification(df, target, 3, ids)
    if choose_route(checks) == "ranked":
        ranking = rank_recipes(df, target, ids=ids, **ranking_options)
        table, metrics = enhance(df, ranking.best, target, ids)
        return Processed("ranked", checks, table, metrics, ranking=ranking)
    done = clean(df, keep_apart=ids)
    return Processed("cleaned", checks, done.table, done.metrics, cleaned=done)
