"""Structural repair: steps that estimate nothing, so they may run before any split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import words
from ..functions.scalars import coerce_numeric, parse_mixed_date, q, strip
from ..session import is_text, materialise, on_entry
from .counts import row_digest
from .roles import _CHUNK, column_facts, decide_role

LOG_SCHEMA = (
    "step string, detail string, rows_before bigint, rows_after bigint, cols_before int, cols_after int"
)
_CAST_SHARE = 0.95
_HELD = "identifier_held_as_text"   # column metadata: keeps a second repair from undoing the first


def missing_word(text: Column) -> Column:
    """True for the spellings of "missing" (already trimmed text)."""
    return F.lower(text).isin(words.MISSING_WORDS)


def trim_and_null(df: DataFrame) -> DataFrame:
    """Trim every string cell, then turn missing-words into NULL: one projection."""
    out = []
    for f in df.schema.fields:
        if is_text(f.dataType):
            t = strip(q(f.name))
            out.append(F.when(~missing_word(t), t).alias(f.name, metadata=f.metadata))
        else:
            out.append(q(f.name))
    return df.select(*out)


def _text_counts(df: DataFrame) -> tuple[int, int, int, dict[str, tuple]]:
    """Rows, trimmed cells, sentinel cells and (present, constant) per column: one aggregate per 5 columns."""
    n, trimmed, nulled, per = 0, 0, 0, {}
    for start in range(0, max(1, len(df.columns)), _CHUNK):
        aggs = [F.count(F.lit(1)).alias("n")]
        cols, fields = [], df.schema.fields[start : start + _CHUNK]
        for i, f in enumerate(fields):
            if is_text(f.dataType):
                t = strip(q(f.name))
                cols += [
                    F.when(~missing_word(t), t).alias(f"c{i}"),
                    (t != q(f.name)).alias(f"t{i}"),
                    missing_word(t).alias(f"w{i}"),
                ]
                aggs += [F.count_if(f"t{i}").alias(f"trim{i}"), F.count_if(f"w{i}").alias(f"word{i}")]
            else:
                cols.append(q(f.name).alias(f"c{i}"))
            aggs += [
                F.count(f"c{i}").alias(f"present{i}"),
                (F.min(f"c{i}") == F.max(f"c{i}")).alias(f"constant{i}"),
            ]
        row = df.select(*cols).agg(*aggs).first().asDict()
        n = row["n"]
        trimmed += sum(row.get(f"trim{i}", 0) for i in range(len(fields)))
        nulled += sum(row.get(f"word{i}", 0) for i in range(len(fields)))
        per |= {f.name: (row[f"present{i}"], row[f"constant{i}"]) for i, f in enumerate(fields)}
    return n, trimmed, nulled, per


def cast_to_roles(df: DataFrame, keep_apart: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Cast columns to their inferred role; a text cast needs 95 % of non-null cells to parse."""
    keep_apart = keep_apart or []
    facts = {f.name: f for f in column_facts(df, [c for c in df.columns if c not in keep_apart])}
    dates = [f.name for f in facts.values() if f.kind == "text" and decide_role(f) == "datetime"]
    parsed = {}
    if dates:
        row = df.agg(*[F.count(parse_mixed_date(q(c))).alias(f"d{i}") for i, c in enumerate(dates)]).first()
        parsed = dict(zip(dates, row))
    out, casts = [], []
    for name in df.columns:
        expr, f = q(name), facts.get(name)
        role = decide_role(f) if f else None
        if role == "identifier" and f.kind != "text":
            out.append(expr.cast("string").alias(name, metadata={_HELD: True}))
            casts.append(f"{name}->string (identifier)")
            continue
        if df.schema[name].metadata.get(_HELD):
            pass   # an earlier repair made it text on purpose
        elif role == "numeric" and f.kind == "text" and f.parsed >= _CAST_SHARE * f.present:
            expr = coerce_numeric(expr)
            casts.append(f"{name}->numeric")
        elif name in parsed and parsed[name] >= _CAST_SHARE * f.present:
            expr = parse_mixed_date(expr)
            casts.append(f"{name}->datetime")
        elif role == "categorical" and f.kind == "text":
            casts.append(f"{name}->category")
        out.append(expr.alias(name, metadata=df.schema[name].metadata))
    return df.select(*out), casts


#: Digests that occur more than once (16 bytes each), up to which they are broadcast.
FEW_DIGESTS = 2_000_000


def without_copies(df: DataFrame, keep_apart: list[str] | None = None) -> DataFrame:
    """One row of each set of equal rows; of ``keep_apart`` columns, which do not take part in the test, the least values stay.

    Only the 128-bit digests of rows are shuffled. Rows whose digest occurs once stay where they are; the others meet and are
    compared cell by cell. Rows and digests are written once, as three passes read them and each would make all cells anew.
    """
    keep_apart = keep_apart or []
    names = [c for c in df.columns if c not in keep_apart]
    marked = materialise(df.withColumn("__digest", F.unhex(row_digest(df.select(*[q(c) for c in names])))), "marked")
    seen = marked.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).select("__digest")
    seen = materialise(seen, "copied")
    seen = F.broadcast(seen) if seen.count() <= FEW_DIGESTS else seen
    once = marked.join(seen, "__digest", "left_anti").drop("__digest")
    more = marked.join(seen, "__digest", "left_semi").drop("__digest")
    if not keep_apart:
        return once.unionByName(more.dropDuplicates())
    first = more.groupBy(*[q(c) for c in names]).agg(F.min(F.struct(*[q(c) for c in keep_apart])).alias("__first"))
    kept = first.select(*[F.col("__first").getField(c).alias(c) for c in keep_apart], *[q(c) for c in names])
    return once.unionByName(kept.select(*[q(c) for c in df.columns]))


def structural_repair(
    df: DataFrame,
    *,
    drop_duplicate_rows: bool = True,
    drop_empty_columns: bool = True,
    drop_constant_columns: bool = False,
    keep_apart: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Repaired table and its log (one row per step that changed something).

    ``keep_apart`` names bookkeeping columns (a row id) that pass through
    untouched and do not take part in the duplicate test.
    """
    repaired, log = repair_with_log(
        df,
        drop_duplicate_rows=drop_duplicate_rows,
        drop_empty_columns=drop_empty_columns,
        drop_constant_columns=drop_constant_columns,
        keep_apart=keep_apart,
    )
    return repaired, df.sparkSession.createDataFrame(log, LOG_SCHEMA)


def repair_with_log(
    df: DataFrame,
    *,
    drop_duplicate_rows: bool = True,
    drop_empty_columns: bool = True,
    drop_constant_columns: bool = False,
    keep_apart: list[str] | None = None,
) -> tuple[DataFrame, list[tuple]]:
    keep_apart = keep_apart or []
    df = on_entry(df)
    data = df.drop(*keep_apart)
    n, trimmed, nulled, per = _text_counts(data)
    out = trim_and_null(df)
    log: list[tuple] = []
    width = len(data.columns)
    if trimmed:
        log.append(("trim_whitespace", f"{trimmed} string cells trimmed", n, n, width, width))
    if nulled:
        log.append(("normalise_missing_sentinels", f"{nulled} sentinel strings to NULL", n, n, width, width))
    if drop_empty_columns:
        empty = [c for c, (present, _) in per.items() if present == 0]
        if empty:
            out = out.drop(*empty)
            log.append(("drop_empty_columns", f"dropped {', '.join(empty)}", n, n, width, width - len(empty)))
            width -= len(empty)
    if drop_constant_columns:
        constant = [c for c, (present, same) in per.items() if present and same]
        if constant:
            out = out.drop(*constant)
            log.append(("drop_constant_columns", f"dropped {', '.join(constant)}", n, n, width, width - len(constant)))
            width -= len(constant)
    if drop_duplicate_rows and width:
        kept = without_copies(out, keep_apart)
        # Later passes (roles, parse rates, fills) would each repeat this shuffle.
        out = materialise(kept, "repaired")
        left = out.count()
        if left < n:
            log.append(("drop_duplicate_rows", f"removed {n - left} exact duplicate rows", n, left, width, width))
            n = left
    out, casts = cast_to_roles(out, keep_apart)
    if casts:
        log.append(("cast_types", "; ".join(casts), n, n, width, width))
    return out, log
