"""Toxicity scores: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Spark counts in how many toxic and other training documents every n-gram of the words occurs, keeps those
that tell the classes apart best, and scales each by the logarithm of its smoothed ratio. These counts cover all labelled
rows that are not held out. The weights of a logistic regression over the scaled presence of these n-grams are fitted on a bounded sample
of them; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .joins import attach
from .scratch import written
from .words import ragged, slices, split_words, text_array

#: Lengths of n-grams; a word counts with a mark on either side.
LENGTHS = (3, 4, 5)
#: About so many labelled rows, chosen by a hash of their id, are fitted on.
MOST_TRAINING = 40_000
#: Labels (12 bytes each) up to which they are broadcast to the documents; more are joined by a shuffle.
FEW_LABELS = 1_000_000
#: n-grams in the model, and the training documents that must hold one.
MOST_FEATURES, LEAST_DOCUMENTS = 4096, 5
_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every n-gram of the words, and the word that it stands in."""
    text = "".join(f"\x02{w}\x03" for w in pc.utf8_lower(words).to_pylist())
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(_U)
    owner = np.cumsum(codes == 2) - 1
    grams, owners = [], []
    for n in LENGTHS:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, _U(n))
            for i in range(n):
                h = _mixed(h * _U(0x9E3779B97F4A7C15) + codes[i : len(codes) - n + 1 + i])
            inside = owner[: len(h)] == owner[n - 1 :]
            grams.append(h[inside])
            owners.append(owner[: len(h)][inside])
    if not grams:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(grams), np.concatenate(owners)


def document_grams(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of text and n-gram; with ``known`` (sorted hashes) only those, as places among them."""
    codes, ends, distinct = split_words(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends))
    # A word with one of the marks inside it would not be told from two words.
    words = pc.replace_substring_regex(distinct, "[\x02\x03]", "\x04")
    grams, word = word_grams(words)
    if known is not None:
        place = np.minimum(np.searchsorted(known, grams), max(0, len(known) - 1))
        hit = known[place] == grams if len(known) else np.zeros(len(grams), bool)
        grams, word = place[hit].astype(_U), word[hit]
    order = np.argsort(word, kind="stable")
    grams, counts = grams[order], np.bincount(word, minlength=len(distinct))
    pair = np.unique(owner * (len(distinct) + 1) + codes)
    text, code = pair // (len(distinct) + 1), pair % (len(distinct) + 1)
    some = counts[code] > 0
    text, code = text[some], code[some]
    at = ragged((np.cumsum(counts) - counts)[code], counts[code])
    text, gram = np.repeat(text, counts[code]), grams[at]
    both = np.empty(len(text), [("text", "<i8"), ("gram", "<u8")])
    order = np.lexsort((gram, text))
    both["text"], both["gram"] = text[order], gram[order]
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    return both["text"][first], both["gram"][first]


@dataclass
class Model:
    """Sorted hashes of the n-grams, their weights, and the constant."""

    grams: np.ndarray
    weights: np.ndarray
    constant: float

    def score(self, texts: pa.Array) -> np.ndarray:
        text, place = document_grams(texts, self.grams)
        total = np.bincount(text, self.weights[place.astype(np.int64)], minlength=len(texts)) if len(text) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.constant, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are kept from training; rows without an id always are."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def _fit_weights(features: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression over the scaled features by adaptive gradient steps."""
    sizes = np.fromiter(map(len, features), np.int64, len(features))
    at = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
    row, n = np.repeat(np.arange(len(y)), sizes), len(y)
    w, b = np.zeros(len(ratios)), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m1, m2 = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, (w * ratios)[at], minlength=n) + b, -500, 500)))
        g = np.append(np.bincount(at, (p - y)[row], minlength=len(w)) * ratios / n + ridge * w, (p - y).mean())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - float(step[-1])
    return w * ratios, b


def fit(docs: DataFrame, labels: DataFrame, most_training: int = MOST_TRAINING, most_features: int = MOST_FEATURES, few_labels: int = FEW_LABELS) -> Model:
    """A model of ``labels.toxic`` learnt from rows that are not held out: n-grams and ratios from all, weights from about ``most_training``.

    Rows without a label, text counts as empty where null. Without rows of both classes every text gets the same score,
    the smoothed share of the labels there are (a half if none).
    """
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    ).distinct()
    n = known.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where(chance < most_training / max(1, n))
    train = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"), "toxicity-training")
    labelled = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), known, "doc_id", few_labels).where("toxic is not null")
    seen = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = seen.get(1, 0), seen.get(0, 0)
    if not bad or not good:
        return Model(np.zeros(0, _U), np.zeros(0), float(np.log((bad + 1) / (good + 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            text, gram = document_grams(text_array(batch.column("text")))
            toxic = batch.column("toxic").to_numpy()[text]
            grams, which = np.unique(gram, return_inverse=True)
            in_bad = np.bincount(which, toxic, minlength=len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams.astype(np.int64)), pa.array(in_bad), pa.array(np.bincount(which, minlength=len(grams)) - in_bad)],
                names=["gram", "in_bad", "in_good"],
            )

    counts = labelled.select("text", "toxic").mapInArrow(count, "gram long, in_bad long, in_good long").groupBy("gram").agg(
        F.sum("in_bad").alias("p"), F.sum("in_good").alias("q")
    ).where(F.col("p") + F.col("q") >= LEAST_DOCUMENTS)
    # Likelihood ratio of class and presence: how much a gram tells.
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    total = bad + good
    has = F.col("p") + F.col("q")
    told = (
        part(F.col("p"), has * bad / total) + part(F.col("q"), has * good / total)
        + part(bad - F.col("p"), (total - has) * bad / total) + part(good - F.col("q"), (total - has) * good / total)
    )
    chosen = counts.withColumn("told", told).orderBy(F.col("told").desc(), "gram").limit(most_features).toPandas()
    grams = chosen["gram"].to_numpy(np.int64).view(np.uint64)
    ratios = np.log((chosen["p"].to_numpy() + 1) / (bad + 2)) - np.log((chosen["q"].to_numpy() + 1) / (good + 2))
    order = np.argsort(grams)
    grams, ratios = grams[order], ratios[order]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            text, place = document_grams(text_array(batch.column("text")), grams)
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            own = [place[a:b].astype("<u2").tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column("toxic")], names=["own", "toxic"])

    rows = train.mapInArrow(mark, "own binary, toxic int").toPandas()  # two bytes a feature of the bounded sample
    features = [np.frombuffer(own, "<u2") for own in rows["own"]]
    weights, constant = _fit_weights(features, rows["toxic"].to_numpy(float), ratios)
    return Model(grams, weights, constant)


def with_scores(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text, a null one as empty; a column of that name is replaced. No shuffle."""
    kept = [f for f in docs.schema.fields if f.name.lower() != column.lower()]
    at = [f.name for f in kept].index("text")
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(model.score(text_array(batch.column(at))))], names=[*batch.schema.names, column]
            )

    return docs.select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in kept]).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; repeated rows are scored alike, empty texts too."""
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
