"""Standard forms for business fields, chosen by column name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import words
from ..functions.scalars import parse_mixed_date, q, strict_number, strip, title_case
from ..session import is_moment, is_number, is_text

_DATE_SHARE = 0.8


def column_key(name: str) -> str:
    """Lower case, runs of other characters to one underscore, trimmed."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def clean_email(c: Column) -> Column:
    """Trimmed lower-case address, NULL when it has no address shape."""
    t = F.lower(strip(c))
    return F.when(t.rlike(words.EMAIL_SHAPE), t)


def clean_country(c: Column) -> Column:
    """Standard country name for known spellings, title case otherwise."""
    t = strip(c)
    known = F.create_map(*[F.lit(x) for pair in words.COUNTRY_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.lower(t)), title_case(t))


def bounded_age(c: Column) -> Column:
    """Number within [0, 120], else NULL."""
    return F.when(c.between(0, 120), c)


def _as_number(c: Column, dtype) -> Column:
    if is_number(dtype):
        return c.cast("double")
    return strict_number(c) if is_text(dtype) else F.lit(None).cast("double")


def standardise(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Standardised table and the ordered step names.

    One aggregate gathers every parse rate and flag; the result is one projection.
    """
    aggs: list[Column] = [F.lit(0).alias("_none")]
    plans = []
    for i, f in enumerate(df.schema.fields):
        name, dtype, key, c = f.name, f.dataType, column_key(f.name), q(f.name)
        text = is_text(dtype)
        main = None
        if any(t in key for t in words.DATE_TOKENS):
            main = "date"
            if text:
                aggs += [F.count(c).alias(f"n{i}"), F.count(parse_mixed_date(c)).alias(f"d{i}")]
            elif is_moment(dtype):
                aggs.append(F.count(c).alias(f"n{i}"))
        elif "email" in key:
            main = "email"
            source = c.cast("string")
            aggs.append(F.count_if(c.isNotNull() & clean_email(source).isNull()).alias(f"bad{i}"))
        elif key.endswith("name") or "_name" in key:
            main = "name"
        elif "country" in key:
            main = "country"
        elif "category" in key and text:
            main = "category"
        age = key == "age" or key.endswith("_age")
        money = any(t in key for t in words.MONEY_TOKENS)
        number = _as_number(c, dtype)
        if age:
            aggs.append(F.count_if(c.isNotNull() & ~F.coalesce(number.between(0, 120), F.lit(False))).alias(f"age{i}"))
        if money:
            aggs.append(F.count_if(number < 0).alias(f"neg{i}"))
        plans.append((i, name, dtype, key, main, age, money))
    row = df.agg(*aggs).first().asDict() if len(aggs) > 1 else {}

    out, steps = [], []
    for i, name, dtype, key, main, age, money in plans:
        c, text, now = q(name), is_text(dtype), dtype
        if main == "date" and row.get(f"n{i}"):
            if is_moment(dtype):
                steps.append(f"standardized_{key}")
            elif row[f"d{i}"] >= _DATE_SHARE * row[f"n{i}"]:
                c, now = parse_mixed_date(c), None
                steps.append(f"standardized_{key}")
        elif main == "email":
            c = clean_email(c.cast("string"))
            if row[f"bad{i}"]:
                steps.append(f"validated_{key}")
        elif main == "name":
            c = title_case(c) if text else c
            steps.append(f"standardized_{key}")
        elif main == "country":
            c = clean_country(c) if text else c
            steps.append(f"standardized_{key}")
        elif main == "category":
            c = title_case(strip(c))
            steps.append(f"standardized_{key}")
        if age and now is not None:
            c = bounded_age(_as_number(c, dtype))
            if row[f"age{i}"]:
                steps.append(f"bounded_{key}_0_120")
        if money and now is not None and row[f"neg{i}"]:
            number = c if age else _as_number(c, dtype)
            c = F.when(F.coalesce(number, F.lit(0.0)) >= 0, c)
            steps.append(f"removed_negative_{key}")
        out.append(c.alias(name))
    return df.select(*out), list(dict.fromkeys(steps))
