"""Quantile search, ranks, neighbours, oversampling, selection, scoring, history."""

import math
import os
import threading
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators.chained import fit_chained
from tidemark.operators.mutual_info import mutual_information
from tidemark.operators.neighbours import knn_impute, nearest
from tidemark.operators import neighbours, quantiles, repair, smote
from tidemark.operators.counts import distinct_counts
from tidemark.operators.profile import profile
from tidemark.operators.quantiles import exact_quantiles, spreads
from tidemark.operators.ranks import hashed_rank, range_bucket
from tidemark.operators.smote import oversample
from tidemark.plans import catalogue, evaluate, ranking
from tidemark.plans.evaluate import combine_scores, sample_quotas, score_recipes, stratified_folds
from tidemark.plans.process import process
from tidemark.plans.ranking import recommend, refine_round, select_recipe
from tidemark.plans.recipes import RECIPES, enhance, fit_pca, recipe_names, recipe_table
from tidemark.plans.terrain import characterize
from tidemark.plans.validation import validate_classification
from tidemark.sources import history as store_module
from tidemark.sources.history import commit_scores, empty_history, load_history, save_history, update_history


def frame(spark, x, names, ids=True, extra=None):
    rows = [
        tuple(([i] if ids else []) + [None if np.isnan(v) else float(v) for v in r] + ([extra[i]] if extra is not None else []))
        for i, r in enumerate(x)
    ]
    schema = ("id long, " if ids else "") + ", ".join(f"{n} double" for n in names)
    if extra is not None:
        schema += ", label " + ("string" if isinstance(extra[0], str) else "int")
    return spark.createDataFrame(rows, schema).repartition(3)


def hot_values(seed, n=4000):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(n) < 0.34, 5.0, np.round(rng.lognormal(1, 1, n), 3))


@pytest.mark.parametrize("misled", [False, True])
def test_quantiles_equal_sorting(spark, monkeypatch, misled):
    """Also where sketches are coarse and trusted beyond reason, so that ranks fall into gaps."""
    if misled:
        monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
        monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    v = np.stack([hot_values(3), np.arange(4000.0), np.full(4000, 2.0), np.where(np.arange(4000) % 2, 0.0, np.arange(4000.0))], axis=1)
    v[:37, 1] = np.nan
    df = frame(spark, v, ["a", "b", "c", "d"])
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns], F.lit(None).cast("double").alias("e"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = exact_quantiles(df, {c: F.col(c) for c in df.columns}, probs)
    for i, c in enumerate("abcd"):
        assert np.allclose(got[c], np.nanquantile(v[:, i], probs), rtol=0, atol=1e-9), c
    assert got["e"] == [None] * len(probs)


@pytest.mark.parametrize("misled", [False, True])
def test_spreads_equal_numpy(spark, monkeypatch, misled):
    if misled:
        monkeypatch.setattr(quantiles, "SKETCH_SIZE", 8)
        monkeypatch.setattr(quantiles, "MARGIN", 0.0)
    rng = np.random.default_rng(9)
    v = np.stack([
        hot_values(5), rng.normal(0, 1, 4000), np.where(rng.random(4000) < 0.6, 0.0, rng.normal(0, 9, 4000)), np.full(4000, 2.0),
        np.where(rng.random(4000) < 0.5, 1.0, rng.normal(0, 9, 4000)), rng.standard_cauchy(4000), np.where(rng.random(4000) < 0.9, 0.0, 1.0),
    ], axis=1)
    df = frame(spark, v, list("abcdefg"))
    got = spreads(df, {c: F.col(c) for c in df.columns}, [0.01, 0.5, 0.99])
    for i, c in enumerate("abcdefg"):
        x = v[:, i]
        q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        mad = np.median(np.abs(x - med))
        extreme = np.abs(0.6745 * (x - med) / mad) > 3.5 if mad > 0 else (x < q1 - 3 * (q3 - q1)) | (x > q3 + 3 * (q3 - q1)) if q3 > q1 else x < x
        assert np.allclose(got[c].quantiles, np.quantile(x, [0.01, 0.5, 0.99])), c
        assert np.isclose(got[c].deviation, mad) and got[c].extreme == extreme.sum(), c


def test_a_profile_takes_three_scans(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    n = 3000
    df = frame(spark, np.stack([hot_values(1, n), np.arange(n) % 7], axis=1), ["a", "b"]).withColumn("t", F.col("b").cast("string"))
    seen = df.mapInArrow(counted, df.schema)
    assert exact_quantiles(seen, {"a": F.col("a")}, [0.1, 0.5]) and rows.value == 2 * n
    rows.value = 0
    report = profile(seen)
    assert rows.value == 3 * n
    copies = {tuple(r) for r in df.collect()}
    assert report.dataset_row["n_duplicate_rows"] == n - len(copies)


def test_row_digests_tell_cells_apart(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("", "ab"), (None, "ab"), ("-", "ab"), ("a", "b")], "x string, y string")
    assert distinct_counts(df, ["x"], rows=True)[None] == 5
    zero = spark.createDataFrame([(0.0,), (-0.0,), (None,)], "x double")
    assert distinct_counts(zero, ["x"], rows=True) == {"x": 1, None: 2}


def test_bucketed_rank_equals_plain_rank(spark):
    df = spark.range(900).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise("b"))
    plain = hashed_rank(df, ["g"], [F.col("id")], 1, 900).collect()
    cut = hashed_rank(df, ["g"], [F.col("id")], 1, 900, rows_per_bucket=40).collect()
    assert sorted(plain) == sorted(cut)
    splits = [float(i) for i in range(0, 100, 7)]
    got = spark.range(100).select("id", range_bucket(F.col("id").cast("double"), splits).alias("b")).collect()
    assert all(r["b"] == sum(s < r["id"] for s in splits) for r in got)


def brute_mi(x, y):
    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))

    out = []
    for v in x.T:
        k_all, size, m = [], [], []
        for i in range(len(v)):
            same = np.flatnonzero(y == y[i])
            k = min(3, len(same) - 1)
            r = np.sort(np.abs(v[same] - v[i]))[k]
            m.append((np.abs(v - v[i]) < r).sum() if r > 0 else (v == v[i]).sum())
            k_all.append(k)
            size.append(len(same))
        out.append(max(0.0, psi(len(v)) + np.mean([psi(a) - psi(b) - psi(c) for a, b, c in zip(k_all, size, m)])))
    return out


def test_mutual_information_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    x = np.column_stack([y + rng.normal(0, 0.4, 300), rng.normal(size=300), np.where(rng.random(300) < 0.3, 0.5, y * rng.random(300))])
    df = frame(spark, x, ["a", "b", "c"], extra=[int(v) for v in y])
    want = brute_mi(x, y)
    assert want[0] > 0.3
    for rows in (10**6, 25):
        got = [r["score"] for r in mutual_information(df, ["a", "b", "c"], "label", rows_per_bucket=rows).orderBy("pos").collect()]
        assert np.allclose(got, want, atol=1e-9)


def test_nearest_imputation_equals_brute_force_with_hot_rows(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(260, 3)), 1)
    x[:90] = [0.5, -0.2, 1.0]
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3] = np.nan
    want = x.copy()
    for i in range(len(x)):
        for j in np.flatnonzero(np.isnan(x[i])):
            gap = x[i] - x
            seen = (~np.isnan(gap)).sum(1)
            dist = np.sqrt(3 / np.maximum(seen, 1) * np.nansum(gap**2, axis=1))
            near = sorted((dist[r], x[r, j]) for r in range(len(x)) if seen[r] and not np.isnan(x[r, j]))
            want[i, j] = np.mean([v for _, v in near[:5]]) if near else np.nanmean(x[:, j])
    df = frame(spark, x, ["a", "b", "c"])
    for block in (50_000, 7):
        got = np.array([r[1:] for r in knn_impute(df, df, ["a", "b", "c"], block_rows=block).orderBy("id").collect()], dtype=float)
        assert np.allclose(got, want, atol=1e-9)


def test_neighbours_with_gaps_visit_few_pairs(spark):
    """Gapped points in three dimensions, many blocks: few per cent of all pairs are looked at, and the result is that of all pairs."""
    rng = np.random.default_rng(8)
    n, k = 40_000, 5
    x = rng.normal(size=(n, 3))
    x[rng.random(x.shape) < 0.15] = np.nan
    df = frame(spark, x, ["a", "b", "c"])
    pairs = spark.sparkContext.accumulator(0)
    vec = F.array("a", "b", "c")
    donors = df.select(vec.alias("vec")).groupBy("vec").agg(F.count(F.lit(1)).alias("mult")).select(F.lit(0).cast("long").alias("grp"), "vec", "mult")
    asked = donors.where(F.exists("vec", lambda v: v.isNull())).select("grp", "vec")
    found = nearest(asked, donors, 3, k, True, 2000, 200, pairs).collect()
    rows = np.array([[np.nan if v is None else v for v in r.vec] for r in donors.collect()])
    gapped = rows[np.isnan(rows).any(axis=1)]
    assert 0 < pairs.value < 0.07 * len(gapped) * len(rows)
    got = {}
    for r in found:
        got.setdefault((tuple("x" if v is None else v for v in r.vec), r.slot), []).append((r.dist, r.hit[0]))
    for i in range(0, len(gapped), 200):
        gap = gapped[i] - rows
        seen = (~np.isnan(gap)).sum(1)
        dist = np.where(seen > 0, np.sqrt(3 / np.maximum(seen, 1) * np.nansum(gap**2, axis=1)), np.inf)
        for j in np.flatnonzero(np.isnan(gapped[i])):
            has = ~np.isnan(rows[:, j]) & np.isfinite(dist)
            want = sorted(zip(dist[has], rows[has, j]))[:k]
            mine = sorted(got.get((tuple("x" if np.isnan(v) else v for v in gapped[i]), j), []))
            assert np.allclose(mine, want, atol=1e-9) if want else not mine


def test_block_search_holds_little():
    """A full task of queries against a full block, in a small part of the memory of all candidates, also when all distances tie."""
    rng = np.random.default_rng(4)
    for donors, asked in [(rng.random((8192, 3)), rng.random((15_000, 3))), (np.unique(rng.integers(0, 25, (8192, 3)), axis=0).astype(float), rng.random((4000, 3)).round())]:
        asked[:, 1] = np.nan
        grids = [np.linspace(donors[:, j].min(), donors[:, j].max(), 1022) for j in range(3)]
        vectors = lambda m: pa.array([[None if v != v else v for v in r] for r in m.tolist()], pa.list_(pa.float64()))
        search = neighbours._searcher(3, 5, True, grids, None)
        queries = pa.table({"qid": np.arange(len(asked)), "vec": vectors(asked), "reach": np.full(len(asked), np.inf)})
        block = pa.table({"vec": vectors(donors), "mult": np.ones(len(donors), np.int64)})
        tracemalloc.start()
        found = search(queries, block).to_pydict()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 120 << 20
        got = {}
        for i, dist, hit in zip(found["qid"], found["dist"], found["hit"]):
            got.setdefault(i, []).append((round(dist, 9), hit[0]))
        for i in range(0, len(asked), 500):
            dist = np.sqrt(1.5 * ((donors[:, [0, 2]] - asked[i, [0, 2]]) ** 2).sum(1)).round(9)
            assert sorted(got[i]) == sorted(zip(dist, donors[:, 1]))[:5]


def test_block_searches_are_dealt_to_many_tasks(spark):
    """Few bytes, but much work: eight blocks are not left to one task."""
    pool = spark.range(64).select((F.col("id") % 8).alias("block"), F.array(F.col("id").cast("double")).alias("vec"), F.lit(1).cast("long").alias("mult"))
    asked = spark.range(16).select(F.col("id").alias("qid"), (F.col("id") % 2).alias("qblock"), F.array(F.col("id") + 0.5).alias("vec"))
    visits = spark.range(2).select(F.col("id").alias("qblock")).crossJoin(spark.range(8).select(F.col("id").alias("block")))
    found = neighbours._search(visits, asked, pool, None, 1, 2, False, [np.arange(64.0)], None)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 3 and sum(r["count"] for r in tasks) == 16 * 8 * 2


def test_oversampling_counts_and_segments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 2))
    y = ["many"] * 40 + ["few"] * 14 + ["rare"] * 6
    df = frame(spark, x, ["a", "b"], extra=y)
    made, _ = oversample(df, ["a", "b"], "label", ["id"])
    rows = made.collect()
    assert sum(r["label"] == "few" for r in rows) == 26 and sum(r["label"] == "rare" for r in rows) == 34
    for r in rows:
        own = x[[i for i in range(60) if y[i] == r["label"]]]
        p = np.array([r["a"], r["b"]])
        best = min(
            abs((q - s)[0] * (p - s)[1] - (q - s)[1] * (p - s)[0]) / (np.linalg.norm(q - s) + 1e-12) + max(0, (p - s) @ (p - q))
            for s in own for q in own if (s != q).any()
        )
        assert best < 1e-6
    again = sorted(oversample(df.repartition(5), ["a", "b"], "label", ["id"])[0].collect())
    assert again == sorted(rows)


def test_only_seeds_that_grow_are_searched(spark, monkeypatch):
    """predict_rows (F6): a class a little below the largest was searched whole, though few of its rows get a new one."""
    rng = np.random.default_rng(6)
    df = frame(spark, rng.normal(size=(150, 2)), ["a", "b"], extra=["many"] * 80 + ["near"] * 70)
    searched = []

    def counted(queries, donors, *args, **kwargs):
        searched.append((queries.count(), donors.count()))
        return neighbours.nearest(queries, donors, *args, **kwargs)

    monkeypatch.setattr(smote, "nearest", counted)
    made, _ = oversample(df, ["a", "b"], "label", ["id"])
    assert made.count() == 10 and searched == [(10, 70)]


def test_folds_of_a_recipe_run_side_by_side(spark, monkeypatch):
    """predict_rows (F6): one thread had all folds of the recipe that takes longest; a failing fold still fails its recipe."""
    folded = stratified_folds(frame(spark, np.arange(24.0)[:, None], ["a"], extra=["x", "y"] * 12), "label", ["id"])
    together = threading.Barrier(3, timeout=30)

    def scored(df, features, target, classes, recipe, fold, *args):
        together.wait()
        if recipe.name == "phalanx" and fold == 1:
            raise ValueError("fold 1")
        return 8, fold + 1

    monkeypatch.setattr(evaluate, "score_fold", scored)
    rows = score_recipes(folded, ["a"], "label", ["reconnaissance", "phalanx"], "logreg", ["id"], parallel=3).collect()
    found = [(r["recipe"], r["fold"], r["rows"], r["correct"], r["error"]) for r in rows]
    assert found == [("reconnaissance", k, 8, k + 1, "") for k in range(3)] + [("phalanx", k, 0, 0, "ValueError: fold 1") for k in range(3)]


def test_pca_and_chained_imputation(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(200, 2))
    x = np.column_stack([base[:, 0], base[:, 0] * 2 + 0.1 * base[:, 1], base[:, 1]])
    df = frame(spark, x, ["a", "b", "c"])
    p = fit_pca(df, ["a", "b", "c"])
    assert np.allclose(p.axes @ p.axes.T, np.eye(3), atol=1e-9)
    assert np.allclose(sorted(p.variances), sorted(np.linalg.eigvalsh(np.cov(x.T))), atol=1e-9)
    y = x.copy()
    y[:20, 1] = np.nan
    filled = fit_chained(frame(spark, y, ["a", "b", "c"]), ["a", "b", "c"])
    got = np.array([r["b"] for r in filled.apply(frame(spark, y, ["a", "b", "c"])).orderBy("id").limit(20).collect()])
    assert np.abs(got - x[:20, 1]).max() < 0.02


def test_chained_sums_equal_those_of_rows(spark):
    """Regressions from sums of patterns equal regressions over the filled rows; where the sums lie does not matter."""
    from tidemark.operators.chained import _evidence_ridge

    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) @ rng.normal(size=(4, 4)) + 50
    x[rng.random(x.shape) < 0.2] = np.nan
    names = ["a", "b", "c", "d"]
    df = frame(spark, x, names).repartition(5)
    model = fit_chained(df, names, rounds=3, tolerance=0.0)
    assert model.rounds == 3 and len(model.steps) == 12
    gaps, full = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    for j, coef, intercept in model.steps:
        seen, rest = ~gaps[:, j], np.delete(full, j, axis=1)
        mid, y = rest[seen].mean(axis=0), full[seen, j]
        z, t = rest[seen] - mid, y - y.mean()
        want = _evidence_ridge(z.T @ z, z.T @ t, float(t @ t), int(seen.sum()))
        assert np.allclose(coef, want, atol=1e-7) and abs(intercept - (y.mean() - mid @ want)) < 1e-6
        full[gaps[:, j], j] = rest[gaps[:, j]] @ want + (y.mean() - mid @ want)
    assert np.allclose(model.fill(x), full, atol=1e-6)
    apart = fit_chained(df, names, rounds=3, tolerance=0.0, most_sums=0)
    assert all(a[0] == b[0] and np.allclose(a[1], b[1], atol=1e-9) for a, b in zip(model.steps, apart.steps))


def test_chained_odd_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert fit_chained(empty, ["a", "b"]).steps == []
    hollow = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "a double, b double")
    model = fit_chained(hollow, ["a", "b"])
    assert {j for j, *_ in model.steps} <= {0} and model.apply(hollow).where("a is null or b is null").count() == 0


def test_registry_and_widths(spark):
    assert recipe_names(False) == list(RECIPES)[:6] and recipe_table(spark).count() == 8
    assert [RECIPES["scorched_earth"].output_width(d) for d in (3, 8, 40)] == [3, 5, 5]
    assert RECIPES["skirmisher"].output_width(40) == 10
    assert RECIPES["guerrilla"].steps(2) == ["impute", "smote", "scale"]


def test_enhance_counts_and_origin(spark):
    x = np.column_stack([np.arange(20.0), (7 * np.arange(20)) % 11])
    y = ["major"] * 15 + ["minor"] * 5
    out, m = enhance(frame(spark, x, ["a", "b"], extra=y), "guerrilla", "label", ["id"])
    r = m.first()
    assert out.columns == ["a", "b", "label", "_row_origin"]
    assert (r["output_rows"], r["synthetic_rows"], r["removed_rows"]) == (30, 10, 0) and r["steps"] == ["impute", "smote", "scale"]
    assert {tuple(v) for v in out.groupBy("label", "_row_origin").count().collect()} == {
        ("major", "original", 15), ("minor", "original", 5), ("minor", "synthetic", 10)
    }
    with pytest.raises(ValueError):
        enhance(out, "guerrilla", "label")
    with pytest.raises(ValueError):
        enhance(out.drop("_row_origin"), "nothing", "label")


def test_captured_scores_follow_the_index(spark):
    """Published rows: score, accuracy, stability, retention, simplicity, features before and after."""
    published = [
        (0.9162, 0.949, 0.9869, 0.699, 1.0), (0.8678, 0.9526, 0.9845, 0.87, 0.444), (0.7401, 0.7367, 0.9875, 0.72, 0.364),
        (0.9547, 0.896, 0.9853, 1.0, 1.0), (0.7517, 0.62, 0.9868, 0.785, 0.667), (0.9342, 0.875, 0.9912, 1.0, 0.909),
    ]
    for score, acc, stab, ret, simp in published:
        assert abs(0.40 * acc + 0.25 * stab + 0.20 * ret + 0.15 * simp - score) < 2.5e-4
    rows = [(0, "a", k, 10, c, 0.5, 5, 30, 5, "") for k, c in enumerate((8, 9, 10))]
    rows += [(1, "b", k, 0, 0, 1.0, 5, 30, 30, "boom") for k in range(3)]
    from tidemark.plans.evaluate import SCORE_SCHEMA

    good, bad = combine_scores(spark.createDataFrame(rows, SCORE_SCHEMA)).orderBy("idx").collect()
    simple, std = 1 / (1 + 0.05 * 25), math.sqrt(((0.1) ** 2 * 2) / 3)
    assert abs(good["sei"] - (0.4 * 0.9 + 0.25 * (1 - std) + 0.2 * 0.5 + 0.15 * simple)) < 1e-9
    assert bad["sei"] == 0.0 and bad["error"] == "boom"


def test_folds_are_balanced_and_noise_does_not_leak(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 12))
    y = [int(v) for v in rng.integers(0, 2, 120)]
    names = [f"f{i}" for i in range(12)]
    folded = stratified_folds(frame(spark, x, names, extra=y), "label", ["id"]).persist()
    sizes = folded.groupBy("label", "_fold").count().collect()
    for c in (0, 1):
        per = [r["count"] for r in sizes if r["label"] == c]
        assert len(per) == 3 and max(per) - min(per) <= 1
    row = combine_scores(score_recipes(folded, names, "label", ["skirmisher"], "logreg", ["id"])).first()
    assert row["error"] == "" and row["accuracy"] < 0.70


def test_history_and_choice(spark, tmp_path):
    store = str(tmp_path / "history")
    assert load_history(spark, store).count() == 0
    for reward in (0.8, 0.6):
        fresh = spark.createDataFrame([("sig:test", "phalanx", reward)], "signature string, recipe string, reward double")
        save_history(update_history(load_history(spark, store), fresh), store)
    row = load_history(spark, store).first()
    assert row["n"] == 2 and abs(row["mean"] - 0.7) < 1e-12
    top = recommend(load_history(spark, store), "sig:test").first()
    assert (top["recipe"], top["mean_reward"], top["n_runs"], top["confidence"]) == ("phalanx", 0.7, 2, 0.667)
    names = recipe_names()
    assert select_recipe(load_history(spark, store), "sig:test", names, epsilon=0.0) == ("phalanx", "exploit prior knowledge (2 runs)")
    assert select_recipe(empty_history(spark), "x", names, {"siege": 0.4}, 0.0) == ("siege", "exploit current-run SEI (cold terrain)")
    assert select_recipe(empty_history(spark), "x", names, None, 0.0) == ("phalanx", "fallback default")
    assert refine_round("a", {"a": 0.9503, "b": 0.9522}, 2) == (2, 0.02, "a", 0.9503, "b", 0.9522, False)
    assert refine_round("a", {"a": 0.5, "b": 0.6}, 1)[6]
    assert sample_quotas({"a": 50, "b": 30, "c": 20}, 33) == {"a": 16, "b": 10, "c": 7}


def test_terrain_and_checks(spark):
    x = np.column_stack([np.arange(20.0), 2 * np.arange(20.0) + 1, np.ones(20)])
    df = frame(spark, x, ["a", "b", "flat"], extra=["x"] * 15 + ["y"] * 5)
    t = characterize(df, ["a", "b", "flat"], "label")
    assert t.tags == ["high_dimensional", "imbalanced", "high_correlation"] and t.default_recipe == "skirmisher"
    assert t.minority_count == 5 and abs(t.mean_abs_correlation - 1.0) < 1e-9
    checks = {r["check"]: r["passed"] for r in validate_classification(df, "label", ids=["id"]).collect()}
    assert all(checks.values())
    odd = df.withColumn("a", F.when(F.col("id") == 0, F.lit(float("inf"))).otherwise(F.col("a"))).limit(9)
    failed = {r["check"] for r in validate_classification(odd, "b", ids=["id"]).collect() if not r["passed"]}
    assert {"finite_features", "row_count", "class_rows"} <= failed


def test_routing_and_prediction(spark):
    x = np.column_stack([np.arange(40.0), np.arange(40.0) % 5])
    df = frame(spark, x, ["a", "b"], extra=["low"] * 20 + ["high"] * 20)
    done = process(df, "label", ["id"], classifier="logreg", rounds=0, epsilon=0.0, include_extras=False, folds=2)
    assert done.route == "ranked" and done.ranking.scoreboard.count() == 6
    assert done.ranking.summary.first()["selection_reason"] == "exploit prior knowledge (1 runs)"
    hit = done.ranking.predict(df, ["id"]).join(df.select("id", "label"), "id").where("label = predicted").count()
    assert hit >= 34
    assert process(df.select("id", "a", F.col("id").cast("string").alias("name")), "name", ["id"]).route == "cleaned"


def test_large_ids_survive_imputation(spark):
    from tidemark.operators.chained import fit_chained

    rows = [(None if i == 3 else 9007199254740993 + i, float(i), 2.0 * i if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = fit_chained(df, ["a", "b"]).apply(df)
    assert {r["id"] for r in out.collect()} == {r[0] for r in rows}
    assert out.where("b is null").count() == 0 and out.columns == df.columns


def test_damaged_history_falls_back(spark, tmp_path):
    store = str(tmp_path / "h")
    one = spark.createDataFrame([("s", "phalanx", 1, 0.5)], "signature string, recipe string, n bigint, mean double")
    save_history(one, store)
    newest = save_history(one.withColumn("mean", F.lit(0.9)), store)
    for f in os.listdir(newest):
        if f.startswith("part-"):
            with open(os.path.join(newest, f), "wb") as out:
                out.write(b"no parquet")
            crc = os.path.join(newest, f".{f}.crc")
            with open(crc, "wb") as out:
                out.write(b"")
    assert load_history(spark, store).first()["mean"] == 0.5
    assert os.path.basename(save_history(one, store)).startswith("v00000003")


def test_ranking_with_any_classifier_and_labels_checked(spark):
    from pyspark.ml.classification import DecisionTreeClassifier

    from tidemark.plans.ranking import rank_recipes

    x = np.column_stack([np.arange(40.0), np.arange(40.0) % 5])
    df = frame(spark, x, ["a", "b"], extra=["low"] * 20 + ["high"] * 20)
    done = rank_recipes(df, "label", DecisionTreeClassifier(maxDepth=3), 0, 0.0, False, 2, ids=["id"])
    assert not done.error and done.predict(df, ["id"]).count() == 40
    with pytest.raises(ValueError, match="missing"):
        rank_recipes(df.withColumn("label", F.when(F.col("id") > 1, F.col("label"))), "label", ids=["id"])


def _parts(spark, folder):
    rows = [(i, i * 7 % 50 + 1, 900.0 + i * 31 % 97) for i in range(90)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").write.parquet(str(folder / "part.parquet"))
    return str(folder)


def _swept(monkeypatch):
    """The recipes of each sweep to come; the scores are made up, diplomat's are best."""
    swept = []

    def scores(df, features, target, names, *rest, **size):
        swept.append(names)
        rows = [(list(RECIPES).index(n), n, k, 10, 9 if n == "diplomat" else 5, 1.0, 90, 3, 3, "") for n in names for k in range(3)]
        return df.sparkSession.createDataFrame(rows, evaluate.SCORE_SCHEMA)

    monkeypatch.setattr(ranking, "score_recipes", scores)
    return swept


def test_predicted_rows_come_from_the_whole_ranking(spark, tmp_path, monkeypatch):
    """predict_rows (F3): siege, diplomat and the rounds of noise were left out."""
    swept = _swept(monkeypatch)
    out = catalogue.predict_rows(spark, _parts(spark, tmp_path))
    assert swept == [list(RECIPES)] * 4 and out.select("p_partkey").distinct().count() == out.count() == 90


def test_refinement_log_has_all_recipes_and_rounds(spark, tmp_path, monkeypatch):
    """refinement_log (F4): siege, diplomat and all rounds but one were left out."""
    swept = _swept(monkeypatch)
    log = catalogue.refinement_log(spark, _parts(spark, tmp_path)).orderBy("iteration").collect()
    assert swept == [list(RECIPES)] * 4
    assert [(r["iteration"], r["sigma"], r["current"], r["switched"]) for r in log] == [(i, i / 100, "diplomat", False) for i in (1, 2, 3)]


def test_two_writers_keep_both_updates(spark, tmp_path, monkeypatch):
    """The second writer commits between the first one's reading and its claim."""
    store = str(tmp_path / "h")
    rows = lambda reward: spark.createDataFrame([("s", "phalanx", reward)], "signature string, recipe string, reward double")
    commit_scores(rows(0.2), store)
    write, other = store_module._write, []

    def late(history, path, number):
        target = write(history, path, number)
        if not other:
            other.append(True)
            commit_scores(rows(0.4), store)
        return target

    monkeypatch.setattr(store_module, "_write", late)
    commit_scores(rows(0.9), store)
    row = load_history(spark, store).first()
    assert row["n"] == 3 and abs(row["mean"] - 0.5) < 1e-12
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: commit_scores(rows(0.5), store), range(4)))
    assert load_history(spark, store).first()["n"] == 7


def test_enhance_refuses_unfit_tables(spark):
    rows = [(i, float(i), None if i == 3 else i % 2) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, label int")
    with pytest.raises(ValueError, match="missing values"):
        enhance(df, "phalanx", "label", ["id"])
    with pytest.raises(ValueError, match="at least 2 rows"):
        enhance(df.where("label is not null").withColumn("label", F.when(F.col("id") == 5, 9).otherwise(F.col("label"))), "phalanx", "label", ["id"])
    with pytest.raises(ValueError, match="reserved"):
        enhance(df.withColumn("_row_origin", F.lit(1)), "phalanx", "label", ["id"])


def test_copies_are_found_by_digest(spark, monkeypatch):
    rows = [(i % 50, "x" if i % 50 < 10 else f"t{i}", 0.0 if i % 3 else -0.0, i) for i in range(600)] + [(None, None, None, 900), (None, None, None, 901)]
    df = spark.createDataFrame(rows, "a int, b string, c double, id long").repartition(4)
    for few in (10**6, -1):
        monkeypatch.setattr(repair, "FEW_DIGESTS", few)
        plain = lambda d: d.withColumn("c", F.col("c") + 0.0)  # noqa: E731 - grouping turns -0.0 into 0.0
        assert sorted(map(repr, plain(repair.without_copies(df.drop("id"))).collect())) == sorted(map(repr, plain(df.drop("id").dropDuplicates()).collect()))
        kept = repair.without_copies(df, ["id"])
        assert kept.columns == df.columns
        first = df.groupBy("a", "b", "c").agg(F.min("id").alias("id")).select("a", "b", "c", "id")
        assert sorted(map(repr, plain(kept).collect())) == sorted(map(repr, plain(first).collect()))


def test_scoring_ranks_the_rows_once(spark):
    """What makes the folds runs once, however many jobs read them."""
    x = np.random.default_rng(2).normal(size=(60, 2))
    df = frame(spark, x, ["a", "b"], extra=["u" if v > 0 else "v" for v in x[:, 0]])
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    folded = stratified_folds(df, "label", ["id"]).withColumn("a", counted("a"))
    rows = score_recipes(folded, ["a", "b"], "label", ["phalanx", "reconnaissance"], "logreg", ["id"]).collect()
    assert [r["error"] for r in rows] == [""] * 6 and seen.value == 60
