import math
import random

import numpy as np

from tidemark.llm import topk


def by_force(rows, k, every):
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        own = min(v for i, v in rows if i == q)
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in rows if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    r = random.Random(7)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, [0.5] * 8) for i in range(150, 200)]  # ties
    rows += [(200, None), (None, [1.0] * 8), (220, [float("nan")] * 8), (240, [None] + [1.0] * 7), (260, [0.1, 0.2]), (280, []), (3, [0.3] * 8)]
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    got = [tuple(x) for x in topk.top_k(vectors, k=7, every=20).orderBy("query_id", "rank").collect()]
    assert got == by_force(rows, 7, 20)
    assert topk.top_k(vectors.where("false"), k=7).count() == 0


def test_large_numbers_stay_exact():
    q = np.array([[2**40, 3]], np.int64)
    assert topk._scores(q, np.array([[2**20, 1]], np.int64))[0, 0] == 2**60 + 3
