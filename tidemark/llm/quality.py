"""Quality rules whose cutoffs are chosen under a proven limit of false rejections.

Each rule rejects documents whose share of something exceeds a cutoff. For every stratum
(language) and rule the good documents of the labelled holdout are counted beyond
each cutoff of a grid. Cutoffs are tested from the mildest on; one counts as safe while the exact
binomial tail proves, at a level divided by the number of strata and rules, that at most ``risk`` of good
documents are documents are rejected, and the first that fails ends its sequence (so the grid needs no further
correction). Of the safe cutoffs the one is taken that gains most, bad documents caught less ``cost``
times good ones rejected; the mildest of equals, and none where nothing is gained.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .joins import attach
from .scratch import written
from .words import slices, split_words, text_array

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lines"]
#: Rule -> (what is counted, out of what).
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "upper_case": ("n_upper", "word_chars"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
}
#: Cutoffs from the mildest to the strictest.
GRID = tuple(round(1 - 0.05 * i, 2) for i in range(1, 20)) + (0.03, 0.02, 0.01)


def _per_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[ends])


def _groups(keys: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """A number for each distinct combination of the keys (codes with their upper bound), exact at any size."""
    code, bound = keys[0]
    for other, size in keys[1:]:
        if bound * size >= 1 << 62:
            _, code = np.unique(code, return_inverse=True)
            bound = int(code.max(initial=0)) + 1
        code, bound = code * size + other, bound * size
    return code


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text: words, code points in them, symbols, lines that repeat, words in windows that repeat."""
    n = len(texts)
    codes, ends, distinct = split_words(texts)
    of_word = lambda f: f(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    out = {"n_words": np.diff(ends)}
    out["word_chars"] = _per_text(of_word(pc.utf8_length)[codes], ends)
    out["n_symbols"] = _per_text(of_word(lambda w: pc.count_substring_regex(w, r"[#*$%&|<>]"))[codes], ends)
    out["n_upper"] = _per_text(of_word(lambda w: pc.count_substring_regex(w, r"\p{Lu}"))[codes], ends)
    lines = pc.split_pattern(texts, "\n")
    line_ends = lines.offsets.to_numpy().astype(np.int64)
    flat = lines.flatten()
    line_ends = line_ends - line_ends[0]
    full = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(n), np.diff(line_ends))[full]
    line = flat.dictionary_encode().indices.to_numpy().astype(np.int64)[full]
    out["n_lines"] = np.bincount(owner, minlength=n)
    _, first = np.unique(_groups([(owner, n + 1), (line, len(flat) + 1)]), return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(owner[first], minlength=n)
    owner = np.repeat(np.arange(n), np.diff(ends))
    at = np.flatnonzero(owner[2:] == owner[:-2]) if len(codes) > 2 else np.zeros(0, np.int64)
    size = len(distinct) + 1
    window = _groups([(codes[at], size), (codes[at + 1], size), (codes[at + 2], size), (owner[at], n + 1)])
    _, which, times = np.unique(window, return_inverse=True, return_counts=True)
    again = at[times[which] > 1]
    covered = np.zeros(len(codes), bool)
    for step in range(3):
        covered[again + step] = True
    out["n_repeat_words"] = _per_text(covered, ends)
    return out


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the counts of its whole texts (null: all 0); columns named like a count are replaced. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in COUNTS]
    at = [f.name for f in kept].index("text")
    schema = T.StructType([*kept, *(T.StructField(c, T.LongType(), False) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            counts = measure(text_array(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)],
                names=[*batch.schema.names, *COUNTS],
            )

    return docs.select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in kept]).mapInArrow(run, schema)


def binomial_tail(k: int, n: int, p: float) -> float:
    """Probability of at most ``k`` hits in ``n`` draws of probability ``p``, summed from the largest term down."""
    if k >= n:
        return 1.0
    if k >= n * p:
        return 1.0  # never proves anything, whatever its exact value
    log_term = (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    )
    total, ratio, i = 0.0, 1.0, k
    while ratio > 1e-17 * max(total, 1.0) and i >= 0:
        total += ratio
        ratio *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return min(1.0, math.exp(log_term) * total)


def share(rule: str) -> Column:
    part, whole = RULES[rule]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def choose_cutoffs(
    counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.04, level: float = 0.05, cost: float = 5.0
) -> DataFrame:
    """One row per stratum: stratum and a cutoff column per rule (null: the rule is off there).

    ``risk`` bounds the share of good documents that all rules together reject in a stratum (each rule gets
    an equal part), ``level`` the probability that any bound fails. Documents failing the base rules take no part.
    Rows without a label do not count; a stratum with too few labels keeps all its rules off.
    """
    holdout = (
        counted.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), *[share(r).alias(r) for r in RULES])
        .join(labels.where(F.col("quality").isNotNull()).select("doc_id", "quality").distinct(), "doc_id")
    )
    good = F.col("quality") == 1
    over = holdout.groupBy("stratum").agg(
        F.sum(good.cast("long")).alias("n_good"),
        *[
            F.array(*[F.sum((side & (F.col(r) > c)).cast("long")) for c in GRID]).alias(f"{name}_{r}")
            for r in RULES for name, side in (("good", good), ("bad", ~good))
        ],
    )
    over = written(over, "quality-counts")
    alone = level / max(1, over.count() * len(RULES))
    limit = risk / len(RULES)

    def pick(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {"stratum": frame["stratum"]}
            for rule in RULES:
                chosen = []
                for n, rejected, caught in zip(frame["n_good"], frame[f"good_{rule}"], frame[f"bad_{rule}"]):
                    best, most = None, 0
                    for cutoff, k, bad in zip(GRID, rejected, caught):
                        if binomial_tail(int(k), int(n), limit) > alone:
                            break
                        if bad - cost * k > most:
                            best, most = cutoff, bad - cost * k
                    chosen.append(best)
                out[f"cut_{rule}"] = pd.Series(chosen, dtype="float64", index=frame.index)
            yield pd.DataFrame(out)

    kind = counted.schema[stratum].dataType.simpleString()
    return over.mapInPandas(pick, f"stratum {kind}, " + ", ".join(f"cut_{r} double" for r in RULES))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of the words in windows that repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def with_verdict(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``counted`` with base_failed and kept; cutoffs are broadcast while their number is small."""
    cutoffs = written(cutoffs, "quality-cutoffs").withColumnRenamed("stratum", "__stratum")
    judged = attach(counted.withColumn("__stratum", F.col(stratum)), cutoffs, "__stratum")
    bad = F.lit(False)
    for rule in RULES:
        bad = bad | F.coalesce(share(rule) > F.col(f"cut_{rule}"), F.lit(False))
    out = judged.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)
    return out.drop("__stratum", *[f"cut_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Counts and verdict of every document (without its text).

    Null texts count as empty and fail the base rules; repeated rows are judged alike; a null language is
    a stratum of its own; without labels only the base rules reject.
    """
    counted = written(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "quality-features")
    return with_verdict(counted, choose_cutoffs(counted, labels, **settings))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns; texts are never shuffled."""
    own = docs.columns
    counted = written(with_counts(docs.select("doc_id", "lang", "text")).drop("text"), "quality-features")
    packed = docs.select(F.struct("*").alias("__row"), "lang", "text")
    judged = with_verdict(with_counts(packed), choose_cutoffs(counted, labels, **settings))
    return judged.where("kept").select(*[F.col(f"__row.`{c.replace('`', '``')}`") for c in own])
