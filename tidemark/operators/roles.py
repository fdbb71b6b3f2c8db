"""Role of each column: numeric, categorical, datetime, text, identifier, constant, empty."""

from __future__ import annotations

import hashlib
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import words
from ..functions.scalars import coerce_numeric, q, starts_within
from ..session import is_flag, is_moment, is_number, is_text, is_whole, on_entry
from .counts import distinct_counts
from .quantiles import Sketch, sketch_of

_HINT = re.compile(r"(^|_)(" + "|".join(words.IDENTIFIER_TOKENS) + r")($|_)", re.IGNORECASE)
_CHUNK = 5    # columns per aggregate: ten in one took twice as long, probably since the JVM leaves very large methods uncompiled


@dataclass
class ColumnFacts:
    """Everything one scan and one distinct count say about a column."""

    name: str
    dtype: str
    kind: str            # text | number | moment | flag
    whole: bool
    n: int
    present: int
    distinct: int = 0
    parsed: int = 0      # non-null values that read as numbers
    padded: bool = False
    iso_like: int = 0
    day_like: int = 0
    mean: float | None = None
    std: float | None = None
    skew: float | None = None
    sketch: Sketch | None = None

    @property
    def missing(self) -> int:
        return self.n - self.present


def decide_role(f: ColumnFacts) -> str:
    """The ordered rule over a column's facts."""
    if f.present == 0:
        return "empty"
    if f.distinct == 1:
        return "constant"
    ratio = f.distinct / f.present
    if f.padded or (_HINT.search(f.name) and ratio > 0.5):
        return "identifier"
    if f.kind == "number":
        return "identifier" if f.whole and f.missing == 0 and ratio > 0.98 else "numeric"
    if f.kind == "moment":
        return "datetime"
    if f.kind == "flag":
        return "categorical"
    if f.parsed / f.present >= 0.95:
        return "numeric"
    if max(f.iso_like, f.day_like) / f.present >= 0.95:
        return "datetime"
    if f.distinct <= 50 or (f.distinct <= 200 and ratio < 0.05):
        return "categorical"
    return "identifier" if ratio > 0.98 else "text"


def kind_of(dtype) -> str:
    if is_number(dtype):
        return "number"
    if is_moment(dtype):
        return "moment"
    return "flag" if is_flag(dtype) else "text"


@dataclass
class TableFacts:
    columns: list[ColumnFacts]
    distinct_rows: int = 0
    fingerprint: str = ""


def column_facts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> list[ColumnFacts]:
    """One shuffle-free aggregate per 5 columns, plus one distinct count for all."""
    return table_facts(df, columns, approx).columns


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[c for name in df.columns for c in (q(name), q(name).isNull())])


def _hash_sums(h: Column) -> list[Column]:
    product = h.bitwiseAND(F.lit(0x7FFFFFFF)) * F.shiftrightunsigned(h, 33)
    return [F.sum(h.cast("decimal(38,0)")).alias("id_sum"), F.sum(product.cast("decimal(38,0)")).alias("id_product")]


def _content_id(columns: list[str], row: dict) -> str:
    text = f"{','.join(columns)}|{row['n']}|{row['id_sum']}|{row['id_product']}"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def fingerprint(df: DataFrame) -> str:
    """Order-free content id: same rows, same id. NULL positions are hashed too."""
    row = df.select(_row_hash(df).alias("h")).agg(F.count(F.lit(1)).alias("n"), *_hash_sums(F.col("h"))).first()
    return _content_id(df.columns, row.asDict())


def table_facts(df: DataFrame, columns: list[str] | None = None, approx: bool = False, whole: bool = False) -> TableFacts:
    """The columns' facts; with ``whole`` also sketches of their numbers, the number of different rows and the content id, from the same scans."""
    df = on_entry(df)
    columns = list(columns if columns is not None else df.columns)
    facts: list[ColumnFacts] = []
    found = TableFacts(facts)
    # The distinct count shuffles, the aggregates do not: let them share the cluster.
    with ThreadPoolExecutor(1) as pool:
        counting = pool.submit(distinct_counts, df, columns, approx, whole and bool(columns))
        for start in range(0, len(columns), _CHUNK):
            chunk = columns[start : start + _CHUNK]
            projected, aggs = [], [F.count(F.lit(1)).alias("n")]
            if whole and start == 0:
                projected.append(_row_hash(df).alias("h"))
                aggs += _hash_sums(F.col("h"))
            for i, name in enumerate(chunk):
                dtype = df.schema[name].dataType
                aggs.append(F.count(f"c{i}").alias(f"present{i}"))
                projected.append(q(name).alias(f"c{i}"))
                if is_text(dtype):
                    projected.append(coerce_numeric(q(name)).alias(f"v{i}"))
                    c = F.col(f"c{i}")
                    zero, digit = starts_within(c, "0", "1"), starts_within(c, "0", ":")
                    aggs += [
                        F.max(zero & c.rlike(words.PADDED_NUMBER)).alias(f"padded{i}"),
                        F.count_if(digit & c.rlike(words.ISO_DATE_LIKE)).alias(f"iso{i}"),
                        F.count_if(digit & c.rlike(words.DAY_MONTH_LIKE)).alias(f"day{i}"),
                    ]
                elif is_number(dtype):
                    projected.append(q(name).cast("double").alias(f"v{i}"))
                else:
                    continue
                v = F.col(f"v{i}")
                aggs += [
                    F.count(v).alias(f"parsed{i}"),
                    F.avg(v).alias(f"mean{i}"),
                    F.stddev_samp(v).alias(f"std{i}"),
                    F.skewness(v).alias(f"skew{i}"),
                ]
                if whole and not approx:
                    aggs.append(sketch_of(v.cast("double")).alias(f"sketch{i}"))
            row = df.select(*projected).agg(*aggs).first().asDict()
            if whole and start == 0:
                found.fingerprint = _content_id(df.columns, row)
            for i, name in enumerate(chunk):
                dtype = df.schema[name].dataType
                f = ColumnFacts(name, dtype.simpleString(), kind_of(dtype), is_whole(dtype), row["n"], row[f"present{i}"])
                f.parsed = row.get(f"parsed{i}") or 0
                f.padded = bool(row.get(f"padded{i}"))
                f.iso_like, f.day_like = row.get(f"iso{i}") or 0, row.get(f"day{i}") or 0
                f.mean, f.std, f.skew = row.get(f"mean{i}"), row.get(f"std{i}"), row.get(f"skew{i}")
                f.sketch = Sketch(f.parsed, np.array(row[f"sketch{i}"])) if row.get(f"sketch{i}") else None
                facts.append(f)
        distinct = counting.result()
    for f in facts:
        f.distinct = distinct[f.name]
    found.distinct_rows = distinct.get(None, 0)
    return found


def infer_roles(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, role), one row per column."""
    rows = [(f.name, decide_role(f)) for f in column_facts(df, columns, approx)]
    return df.sparkSession.createDataFrame(rows, "column string, role string")
