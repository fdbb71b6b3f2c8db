"""Is this table fit for ranking or enhancing? Checks as rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import q
from ..session import is_moment, is_number, is_real, on_entry

CHECK_SCHEMA = "position int, check string, passed boolean, observed double, message string"
_MIN_ROWS = 10
# Classes are looked up by a literal map in the plan; ``process`` cleans a table with more of them.
MAX_CLASSES = 10_000


def numeric_features(df: DataFrame, target: str, ids: list[str] | None = None) -> list[str]:
    """Numeric columns other than the target and row ids."""
    skip = {target, *(ids or [])}
    return [f.name for f in df.schema.fields if is_number(f.dataType) and f.name not in skip]


def validate_classification(
    df: DataFrame, target: str | None = None, min_class_rows: int = 3, ids: list[str] | None = None
) -> DataFrame:
    """(position, check, passed, observed, message) rows: one scan and one class count."""
    names = [c for c in df.columns if c not in (ids or [])]
    target = target or names[-1]
    rows: list[tuple] = []

    def check(name: str, passed: bool, observed: float, message: str) -> None:
        rows.append((len(rows) + 1, name, bool(passed), float(observed), "" if passed else message))

    check("columns", len(names) >= 2, len(names), "needs at least one feature and a target column")
    check("target_exists", target in names, float(target in names), f"target column not found: {target}")
    if target in names:
        df = on_entry(df)
        features = numeric_features(df, target, ids)
        t, dtype = q(target), df.schema[target].dataType
        bad = t.isNotNull() & (t.cast("double") != F.floor(t.cast("double"))) if is_real(dtype) else F.lit(False)
        infinite = F.lit(False)
        for f in features:
            if is_real(df.schema[f].dataType):
                infinite = infinite | F.coalesce(F.abs(q(f).cast("double")) == F.lit(float("inf")), F.lit(False))
        per = (
            df.select(t.alias("t"), bad.alias("bad"), infinite.alias("inf"))
            .groupBy("t")
            .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if("inf").alias("inf"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(F.col("t").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
                F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
                F.coalesce(F.sum("inf"), F.lit(0)).alias("inf"),
                F.count("t").alias("classes"),
                F.coalesce(F.min(F.when(F.col("t").isNotNull(), F.col("n"))), F.lit(0)).alias("least"),
            )
            .first()
        )
        check("target_complete", per["missing"] == 0, per["missing"], "target column cannot contain missing values")
        discrete = per["bad"] == 0 and not is_moment(dtype)
        check("target_discrete", discrete, per["bad"], "target must contain discrete classes, not continuous values")
        check("numeric_features", bool(features), len(features), "needs at least one numeric feature column")
        check("finite_features", per["inf"] == 0, per["inf"], "feature columns cannot contain infinite values")
        check("row_count", per["rows"] >= _MIN_ROWS, per["rows"], f"needs at least {_MIN_ROWS} rows")
        check("class_count", per["classes"] >= 2, per["classes"], "target must contain at least two classes")
        check("class_rows", per["least"] >= min_class_rows, per["least"],
              f"each target class must contain at least {min_class_rows} rows")
    return df.sparkSession.createDataFrame(rows, CHECK_SCHEMA)


def require_classification(df: DataFrame, target: str | None, min_class_rows: int, ids: list[str] | None = None) -> None:
    """Raise the message of the first check that fails."""
    failed = validate_classification(df, target, min_class_rows, ids).where("not passed").orderBy("position").first()
    if failed is not None:
        raise ValueError(failed["message"])


def class_values(df: DataFrame, target: str) -> list:
    """Sorted classes; refuses missing labels and a target whose classes would not fit a lookup."""
    found = df.select(q(target).alias("t")).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification target")
    if any(r["t"] is None for r in found):
        raise ValueError(f"{target}: target column cannot contain missing values")
    return sorted(r["t"] for r in found)


def encode_labels(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Classes to 0..k-1 in sorted order, by a literal lookup: no shuffle of the rows."""
    return df.withColumn(out, label_of(q(target), class_values(df, target)))


def label_of(c: Column, classes: list) -> Column:
    lookup = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(float(i)))])
    return F.element_at(lookup, c)
