"""Cleaning for people: repair, standardise, fill gaps and say what was missing."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import q, strict_number
from ..session import is_moment, is_text, materialise, on_entry
from .counts import modes
from .profile import Profile, profile
from .quantiles import exact_quantiles
from .repair import LOG_SCHEMA, repair_with_log
from .roles import column_facts, decide_role
from .standardise import standardise

METRICS_SCHEMA = (
    "input_rows bigint, input_columns int, output_rows bigint, output_columns int, "
    "duplicate_rows_in_input bigint, duplicate_rows_removed bigint, missing_filled bigint, "
    "completeness_before double, completeness_after double, steps array<string>"
)
FLAG_SUFFIX = "__was_missing"


@dataclass
class Cleaned:
    table: DataFrame
    metrics: DataFrame
    before: Profile
    after: Profile
    repair_log: DataFrame
    steps: list[str]


def literal_like(value: object, df: DataFrame, name: str) -> Column:
    return F.lit(value).cast(df.schema[name].dataType)


def fill_missing(
    df: DataFrame, keep_apart: list[str] | None = None
) -> tuple[DataFrame, dict[str, object], int]:
    """Fill every gap by role and append ``__was_missing`` flags.

    Numeric columns take the median, all others the most frequent value (smallest
    on ties), or ``Unknown`` when nothing was observed.
    """
    names = [c for c in df.columns if c not in (keep_apart or [])]
    present = df.agg(F.count(F.lit(1)), *[F.count(q(c)) for c in names]).first()
    n, gaps = present[0], [c for c, k in zip(names, present[1:]) if k < present[0]]
    if not gaps:
        return df, {}, 0
    facts = {f.name: f for f in column_facts(df, gaps)}
    numeric = {}
    for c in gaps:
        if decide_role(facts[c]) == "numeric":
            numeric[c] = strict_number(q(c)) if is_text(df.schema[c].dataType) else q(c)
    medians = exact_quantiles(df, numeric, [0.5])
    top = modes(df, [c for c in gaps if c not in numeric])
    fills: dict[str, object] = {}
    for c in gaps:
        if c in numeric:
            m = medians[c][0]
            fills[c] = m if m is not None and math.isfinite(m) else 0.0
        else:
            fills[c] = top[c] if top[c] is not None else "Unknown"
    out = []
    for name in df.columns:
        if name not in fills:
            out.append(q(name))
            continue
        dtype = df.schema[name].dataType
        if fills[name] == "Unknown" and not is_text(dtype):
            out.append(F.coalesce(q(name).cast("string"), F.lit("Unknown")).alias(name))
        elif name in numeric and not is_text(dtype):
            out.append(F.coalesce(q(name).cast("double"), F.lit(float(fills[name]))).alias(name))
        else:
            out.append(F.coalesce(q(name), literal_like(fills[name], df, name)).alias(name))
    flags = [
        q(c).isNull().cast("int").alias(c + FLAG_SUFFIX) for c in gaps if c + FLAG_SUFFIX not in df.columns
    ]
    return df.select(*out, *flags), fills, sum(n - facts[c].present for c in gaps)


def iso_dates(df: DataFrame) -> DataFrame:
    """Timestamps as ``yyyy-MM-dd`` text; the time of day is dropped."""
    return df.select(
        *[
            F.date_format(q(f.name), "yyyy-MM-dd").alias(f.name) if is_moment(f.dataType) else q(f.name)
            for f in df.schema.fields
        ]
    )


def clean(df: DataFrame, keep_apart: list[str] | None = None, parse_steps: list[str] | None = None) -> Cleaned:
    """Profile, repair, standardise, fill, render dates, profile again."""
    keep_apart = keep_apart or []
    df = on_entry(df)
    data = df.drop(*keep_apart)
    pool = ThreadPoolExecutor(1)
    measuring = pool.submit(profile, data)   # needs only the input
    repaired, log = repair_with_log(df, keep_apart=keep_apart)
    tidy, semantic = standardise(repaired.drop(*keep_apart)) if not keep_apart else _apart(repaired, keep_apart)
    # Gaps, roles, medians, modes and the result each read it, and would parse every cell anew.
    filled, _, missing = fill_missing(materialise(tidy, "tidy"), keep_apart)
    table = materialise(iso_dates(filled), "cleaned")
    after = profile(table.drop(*keep_apart))
    before = measuring.result()
    pool.shutdown()
    removed = sum(e[2] - e[3] for e in log)
    steps = (parse_steps or []) + [e[0] for e in log] + semantic
    metrics = (
        before.dataset_row["n_rows"], before.dataset_row["n_cols"],
        after.dataset_row["n_rows"], after.dataset_row["n_cols"],
        before.dataset_row["n_duplicate_rows"], removed, missing,
        before.dataset_row["completeness_pct"], after.dataset_row["completeness_pct"], steps,
    )
    spark = df.sparkSession
    return Cleaned(
        table,
        spark.createDataFrame([metrics], METRICS_SCHEMA),
        before,
        after,
        spark.createDataFrame(log, LOG_SCHEMA),
        steps,
    )


def _apart(df: DataFrame, keep_apart: list[str]) -> tuple[DataFrame, list[str]]:
    """Standardise all but the bookkeeping columns."""
    renamed = df
    for i, c in enumerate(keep_apart):
        renamed = renamed.withColumnRenamed(c, f"_apart_{i}")
    tidy, steps = standardise(renamed)
    for i, c in enumerate(keep_apart):
        tidy = tidy.withColumnRenamed(f"_apart_{i}", c)
    return tidy, steps
