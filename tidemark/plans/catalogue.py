"""Registered queries: every operator run over whole given tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import coerce_numeric, digamma, parse_mixed_date, q, title_case
from ..operators.clean import clean, fill_missing, iso_dates
from ..operators.counts import modes, value_counts
from ..operators.mutual_info import mutual_information
from ..operators.neighbours import knn_impute
from ..operators.profile import compare_quality, fingerprint, profile
from ..operators.quantiles import exact_quantiles
from ..operators.repair import structural_repair, trim_and_null
from ..operators.roles import infer_roles
from ..operators.smote import oversample
from ..operators.standardise import standardise
from ..sources.csv import blank_to_null, preview, read_csv_multiline, repair_lines, type_columns
from ..sources.history import commit_scores, empty_history, load_history, update_history
from ..sources.sinks import write_csv, write_json, write_parquet
from ..session import scratch_dir
from .cleaning_plan import apply_plan, build_plan, export, fit_plan
from .evaluate import (
    add_noise, combine_scores, composite, retention, score_recipes, scoreboard, simplicity, stratified_folds,
    stratified_sample, FoldShare,
)
from .inputs import CSV_FILE_HEADS, CSV_FILE_LINES, CSV_LINES, CURRENCY_TEXT, planted, table
from .process import choose_route
from .ranking import rank_recipes, recommend, select_recipe
from .recipes import (
    RECIPES, apply_scale, enhance, fit_impute, fit_pca, fit_row_filter, fit_scale, fit_variance,
)
from .terrain import terrain_table
from .validation import encode_labels, numeric_features, validate_classification

Query = Callable[[SparkSession, str], DataFrame]
LINE_FEATURES = ["quantity", "price", "discount", "tax"]
LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
ACCOUNT_FEATURES = ["balance", "region_index", "visits", "score"]
PART_FEATURES = ["size", "price", "weight"]
CSV_FILE_ROWS = 250_000     # records of a CSV file that a query writes for itself, about
CSV_HEADER = ["order_key", "order_date", "status", "priority", "customer"]


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(
        *[F.round(q(f.name), digits).alias(f.name) if f.dataType.simpleString() == "double" else q(f.name) for f in df.schema]
    )


def joined(df: DataFrame) -> DataFrame:
    """Array columns as text, so that every cell is a scalar."""
    return df.select(
        *[F.array_join(q(f.name), "; ").alias(f.name) if f.dataType.simpleString().startswith("array") else q(f.name)
          for f in df.schema]
    )


# ---- profiling -------------------------------------------------------------

def _column_report(df: DataFrame) -> DataFrame:
    return rounded(joined(profile(df).columns.withColumnRenamed("column", "column_name").drop("dtype")))


def profile_dirty_orders(spark, d):
    return _column_report(planted(spark, d, "dirty_orders"))


def profile_events(spark, d):
    return _column_report(table(spark, d, "events"))


def profile_dataset(spark, d):
    return profile(planted(spark, d, "dirty_orders")).dataset.drop("fingerprint")


def fingerprint_check(spark, d):
    orders = table(spark, d, "orders")
    base, moved = fingerprint(orders), fingerprint(orders.repartition(5))
    other = fingerprint(orders.withColumn("o_custkey", F.col("o_custkey") + 1))
    return orders.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(moved == base).alias("same_content"), F.lit(other != base).alias("change_seen")
    )


def column_roles(spark, d):
    parts = [
        infer_roles(df).select(F.lit(name).alias("table_name"), F.col("column").alias("column_name"), "role")
        for name, df in [
            ("customer", table(spark, d, "customer")), ("part", table(spark, d, "part")),
            ("nation", table(spark, d, "nation")), ("documents", table(spark, d, "documents")),
            ("dirty_orders", planted(spark, d, "dirty_orders")),
        ]
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quantiles_lineitem(spark, d):
    df = planted(spark, d, "lines")
    qs = exact_quantiles(df, {f: q(f) for f in LINE_FEATURES}, [0.01, 0.25, 0.5, 0.75, 0.99])
    rows = [(f, *v) for f, v in qs.items()]
    return rounded(spark.createDataFrame(rows, "feature string, p01 double, q1 double, median double, q3 double, p99 double"))


def value_frequencies(spark, d):
    cols = ["status", "priority", "channel"]
    names = F.array(*[F.lit(c) for c in cols])
    counts = value_counts(planted(spark, d, "dirty_orders"), cols)
    return counts.select(names[F.col("pos")].alias("column_name"), F.col("text").alias("value"), "freq")


def quality_before_after(spark, d):
    df = planted(spark, d, "dirty_orders")
    return compare_quality(profile(df), profile(structural_repair(df)[0])).drop("fingerprint")


# ---- scalars ---------------------------------------------------------------


def parse_currency(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    text = spark.sql(CURRENCY_TEXT)
    return text.select("o_orderkey", coerce_numeric(F.col("amount")).alias("amount"))


def parse_dates(spark, d):
    c = planted(spark, d, "contacts").select("contact_id", parse_mixed_date(F.col("signup_date")).alias("signup"))
    return iso_dates(c)


def title_names(spark, d):
    return planted(spark, d, "contacts").select("contact_id", title_case(F.col("full_name")).alias("full_name"))


# ---- repair and cleaning ---------------------------------------------------

def repair_trim_sentinels(spark, d):
    return trim_and_null(planted(spark, d, "dirty_orders"))


def repair_rows(spark, d):
    return structural_repair(planted(spark, d, "dirty_orders"))[0]


def repair_drop_constants(spark, d):
    return structural_repair(planted(spark, d, "dirty_orders"), drop_constant_columns=True)[0]


def repair_log(spark, d):
    return structural_repair(planted(spark, d, "dirty_orders"), drop_constant_columns=True)[1]


def repair_again(spark, d):
    once, _ = structural_repair(planted(spark, d, "dirty_orders"))
    return structural_repair(once)[0]


def standard_fields(spark, d):
    tidy, _ = standardise(planted(spark, d, "contacts"))
    return iso_dates(rounded(tidy))


def standard_steps(spark, d):
    _, steps = standardise(planted(spark, d, "contacts"))
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(steps)], "position int, step string")


def fill_gaps(spark, d):
    filled, _, _ = fill_missing(planted(spark, d, "lines"))
    return rounded(filled)


def fill_modes(spark, d):
    base = trim_and_null(planted(spark, d, "dirty_orders"))
    top = modes(base, ["status", "placed", "paid", "priority"])
    return spark.createDataFrame(list(top.items()), "column_name string, mode string")


def clean_contacts(spark, d):
    return rounded(clean(planted(spark, d, "contacts")).table)


def clean_metrics(spark, d):
    return joined(clean(planted(spark, d, "contacts")).metrics)


# ---- cleaning plan ---------------------------------------------------------

def plan_decisions(spark, d):
    report = profile(planted(spark, d, "dirty_orders"))
    return build_plan(report, target="priority").to_frame(spark).withColumnRenamed("column", "column_name")


def plan_notes(spark, d):
    report = profile(planted(spark, d, "dirty_orders"))
    notes = build_plan(report, target="priority").notes
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(notes)], "position int, note string")


def _lines_plan(spark, d):
    df = planted(spark, d, "lines").drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return df, build_plan(profile(df), target="tax")


def plan_transform(spark, d):
    df, plan = _lines_plan(spark, d)
    return rounded(apply_plan(df, fit_plan(df, plan)))


def plan_rare_levels(spark, d):
    raw = table(spark, d, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 150 == 0, F.concat(F.lit("odd"), (F.floor(F.col("p_partkey") / 150) % 4).cast("string")))
        .otherwise(F.col("p_type")).alias("kind"),
    )
    train = raw.where("kind <> 'odd2'")   # one level stays unseen
    plan = build_plan(profile(train.select("kind")))
    fitted = fit_plan(train, plan)
    coded = apply_plan(raw, fitted, ["p_partkey"])
    return coded.toDF(*[c.lower().replace("#", "") for c in coded.columns])


def plan_export(spark, d):
    df, plan = _lines_plan(spark, d)
    return rounded(export(df, plan)[0])


# ---- characterisation ------------------------------------------------------

def _terrain(spark, df, features, name):
    t = terrain_table(df, features, "label")
    return rounded(joined(t.select(F.lit(name).alias("table_name"), "*")), 6)


def terrain(spark, d):
    """Three shapes of table: long with gaps, uneven classes, wide."""
    wide = planted(spark, d, "vectors")
    return (
        _terrain(spark, planted(spark, d, "lines"), LINE_FEATURES, "lines")
        .unionByName(_terrain(spark, planted(spark, d, "accounts"), ACCOUNT_FEATURES, "accounts"))
        .unionByName(_terrain(spark, wide, [c for c in wide.columns if c.startswith("e")], "vectors"))
    )


# ---- recipe stages ---------------------------------------------------------

def _lines_imputed(spark, d, kind):
    df = planted(spark, d, "lines")
    step, kept = fit_impute(df, LINE_FEATURES, kind)
    return step(df), kept


def impute_mean(spark, d):
    return rounded(_lines_imputed(spark, d, "mean")[0])


def impute_median(spark, d):
    return rounded(_lines_imputed(spark, d, "median")[0])


def impute_most_frequent(spark, d):
    return rounded(_lines_imputed(spark, d, "most_frequent")[0])


def impute_nearest(spark, d):
    df = planted(spark, d, "parts")
    return rounded(knn_impute(df, df, PART_FEATURES))


def impute_iterative(spark, d):
    df = planted(spark, d, "accounts")
    step, _ = fit_impute(df, ACCOUNT_FEATURES, "iterative")
    return rounded(step(df))


def impute_iterative_lines(spark, d):
    """Quantity learnt from price, over every line."""
    df = planted(spark, d, "lines").select(*LINE_IDS, "quantity", "price")
    step, _ = fit_impute(df, ["quantity", "price"], "iterative")
    return rounded(step(df))


def variance_features(spark, d):
    df = planted(spark, d, "lines").withColumn("flat", F.lit(3.0))
    step, kept = fit_impute(df, [*LINE_FEATURES, "flat"], "mean")
    return spark.createDataFrame([(f,) for f in fit_variance(step(df), kept)], "feature string")


def _filtered(spark, d, kind):
    df, kept = _lines_imputed(spark, d, "median")
    keep, _, _ = fit_row_filter(df, kept, "label", kind)
    return rounded(df if keep is None else df.where(keep))


def rows_iqr(spark, d):
    return _filtered(spark, d, "iqr")


def rows_zscore(spark, d):
    return _filtered(spark, d, "zscore")


def rows_guard(spark, d):
    """A filter that would lose a class keeps every row."""
    df = planted(spark, d, "parts").withColumn("spread", F.when(F.col("label") == "small", 1e6).otherwise(F.col("weight")))
    keep, n, kept = fit_row_filter(df, ["spread"], "label", "iqr")
    return df.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(kept).cast("bigint").alias("kept"), F.lit(keep is None).alias("guarded"))


def _scaled(spark, d, kind):
    df, kept = _lines_imputed(spark, d, "median")
    return rounded(apply_scale(df, fit_scale(df, kept, kind)))


def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


def scale_minmax(spark, d):
    return rounded(_scaled(spark, d, "minmax"), 6)


def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


def oversample_accounts(spark, d):
    df = planted(spark, d, "accounts")
    step, kept = fit_impute(df, ACCOUNT_FEATURES, "median")
    made, _ = oversample(step(df), kept, "label", ["c_custkey"])
    return rounded(made, 3)


def mutual_info_scores(spark, d):
    df = planted(spark, d, "vectors")
    return rounded(mutual_information(df, [c for c in df.columns if c.startswith("e")], "label").drop("pos"), 5)


def principal_axes(spark, d):
    df = planted(spark, d, "vectors")
    features = [c for c in df.columns if c.startswith("e")]
    p = fit_pca(df, features)
    return p.apply(df.select(*features)).agg(
        *[F.round(F.var_samp(c), 6).alias(f"var_{c}") for c in p.names],
        *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in p.names],
        F.round(F.covar_samp("pc_1", "pc_2"), 6).alias("cov_12"),
    )


def _enhance(name, table_name, ids):
    def run(spark, d):
        return rounded(enhance(planted(spark, d, table_name), name, "label", ids)[0])

    return run


def enhance_metrics(spark, d):
    out = None
    df = planted(spark, d, "accounts")
    for name in ("phalanx", "guerrilla", "reconnaissance", "heavy_cavalry"):
        m = joined(enhance(df, name, "label", ["c_custkey"])[1])
        out = m if out is None else out.unionByName(m)
    return out


# ---- evaluation ------------------------------------------------------------

def folds_lineitem(spark, d):
    df = stratified_folds(planted(spark, d, "lines"), "label", LINE_IDS)
    return df.select(*LINE_IDS, "label", F.col("_fold").alias("fold"))


def sample_accounts(spark, d):
    return stratified_sample(planted(spark, d, "accounts"), "label", 300, ["c_custkey"]).select("c_custkey", "label")


def retention_lines(spark, d):
    df, share = planted(spark, d, "lines"), FoldShare()
    rows = []
    for name in RECIPES:
        kept, n_after, n = retention(df, LINE_FEATURES, "label", RECIPES[name], share)
        rows.append((name, kept, n_after, n))
    return rounded(spark.createDataFrame(rows, "recipe string, retention double, n_after bigint, n bigint"))


def index_components(spark, d):
    """Composite index from per-class rates measured on the tables themselves."""
    rates = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("accuracy"),
        F.avg((F.col("l_linestatus") == "O").cast("double")).alias("retention"),
        (1 - F.stddev_pop("l_discount")).alias("stability"),
        F.max("l_linenumber").alias("d_after"),
    )
    simple = simplicity(F.col("d_after"), F.lit(11))
    return rounded(rates.select(
        "l_suppkey", simple.alias("simplicity"),
        composite(F.col("accuracy"), F.col("stability"), F.col("retention"), simple).alias("sei"),
    ), 6)


def _folded_parts(spark, d):
    return stratified_folds(planted(spark, d, "parts"), "label", ["p_partkey"])


def score_folds(spark, d):
    names = ["phalanx", "reconnaissance", "heavy_cavalry"]
    return score_recipes(_folded_parts(spark, d), PART_FEATURES, "label", names, "logreg", ["p_partkey"])


def recipe_scoreboard(spark, d):
    raw = score_recipes(_folded_parts(spark, d), PART_FEATURES, "label", list(RECIPES), "logreg", ["p_partkey"])
    return scoreboard(combine_scores(raw))


def forest_scoreboard(spark, d):
    raw = score_recipes(
        _folded_parts(spark, d), PART_FEATURES, "label", list(RECIPES), "rf", ["p_partkey"], trees=20, depth=8
    )
    return scoreboard(combine_scores(raw))


def scoreboard_counts(spark, d):
    """Scores and ranks from counts per recipe and fold, with one recipe that failed."""
    names = F.array(*[F.lit(n) for n in RECIPES])
    idx = (F.col("l_suppkey") % 8).cast("int")
    counts = table(spark, d, "lineitem").groupBy(idx.alias("idx"), (F.col("l_linenumber") % 3).cast("int").alias("fold")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("l_discount") >= 0.05).alias("correct"),
    )
    return scoreboard(combine_scores(counts.select(
        "idx", F.element_at(names, F.col("idx") + 1).alias("recipe"), "fold", "rows", "correct",
        (1 - F.col("idx") / 16).alias("retention"), F.lit(0).cast("bigint").alias("n_after"), F.lit(4).alias("d_before"),
        (F.col("idx") + 4).alias("d_after"), F.when(F.col("idx") == 6, "failed").otherwise("").alias("error"),
    )))


def noise_cells(spark, d):
    noisy = add_noise(planted(spark, d, "accounts"), ["visits", "score"], 0.01, ["c_custkey"], 42, 1)
    return rounded(noisy.select("c_custkey", "visits", "score"), 6)


def refinement_log(spark, d):
    return rank_recipes(planted(spark, d, "parts"), "label", "logreg", ids=["p_partkey"]).refinement


def rank_summary(spark, d):
    ranking = rank_recipes(
        planted(spark, d, "accounts"), "label", "logreg", rounds=0, epsilon=0.0, include_extras=False,
        ids=["c_custkey"], sample_rows=300,
    )
    return joined(ranking.summary)


def predict_rows(spark, d):
    df = planted(spark, d, "parts")
    return rank_recipes(df, "label", "logreg", ids=["p_partkey"]).predict(df, ["p_partkey"])


def _rewards(spark, d):
    """Rewards per (signature, recipe) measured on lineitem: one run per order line number."""
    names = F.array(*[F.lit(n) for n in RECIPES])
    return table(spark, d, "lineitem").groupBy("l_linenumber", (F.col("l_suppkey") % 8).alias("r")).agg(
        F.avg("l_discount").alias("reward")
    ).select(F.concat(F.lit("sig:"), F.col("l_linenumber") % 2).alias("signature"),
             names[F.col("r").cast("int")].alias("recipe"), "reward")


def history_update(spark, d):
    rewards = _rewards(spark, d)
    once = update_history(empty_history(spark), rewards)
    twice = update_history(once, rewards.where("recipe <> 'siege'"))
    return rounded(update_history(twice, rewards), 8)


def history_recommend(spark, d):
    return recommend(update_history(empty_history(spark), _rewards(spark, d)), "sig:1").drop("rank")


def history_select(spark, d):
    history = update_history(empty_history(spark), _rewards(spark, d))
    name, reason = select_recipe(history, "sig:0", list(RECIPES), epsilon=0.0)
    return spark.createDataFrame([("sig:0", name, reason)], "signature string, recipe string, reason string")


# ---- sources and validation ------------------------------------------------


def _csv_lines(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return repair_lines(spark.sql(CSV_LINES), CSV_HEADER)


def ragged_csv(spark, d):
    fixed = _csv_lines(spark, d).where(F.col("_fields").isNotNull())
    return fixed.select(
        "o_orderkey", *[blank_to_null(F.col("_fields")[i]).alias(n) for i, n in enumerate(CSV_HEADER)],
        F.col("_repaired").alias("repaired"),
    )


def ragged_csv_rejects(spark, d):
    return _csv_lines(spark, d).where(F.col("_fields").isNull()).select("o_orderkey", F.col("_width").alias("fields_found"))


def _new_folder(spark, label):
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _csv_folder(spark, d):
    """The orders as CSV files of three kinds: notes with line breaks and quotes, dates split by a comma, lines beyond repair, one kind with another order of columns.

    A kind is one file, or several of about ``CSV_FILE_ROWS`` records, so that no task writes a third of all orders.
    """
    table(spark, d, "orders").createOrReplaceTempView("orders")
    lines = spark.sql(CSV_FILE_LINES)
    files = math.ceil(lines.count() / (3 * CSV_FILE_ROWS)) or 1
    lines = lines.select("pid", F.pmod(F.xxhash64("o_orderkey"), F.lit(files)).cast("int").alias("file"), "o_orderkey", "line")
    heads = spark.createDataFrame(
        [(pid, file, -1, CSV_FILE_HEADS[pid]) for pid in range(3) for file in range(files)], "pid long, file int, o_orderkey long, line string"
    )
    path = _new_folder(spark, "csv-files")
    rows = lines.unionByName(heads).repartition(3 * files, "pid", "file").sortWithinPartitions("pid", "file", "o_orderkey")
    rows.select("pid", "file", "line").write.partitionBy("pid", "file").text(path)
    return path


def csv_files(spark, d):
    return read_csv_multiline(spark, _csv_folder(spark, d)).table.select("order_id", "note", "order_date", "priority")


def csv_file_rejects(spark, d):
    return read_csv_multiline(spark, _csv_folder(spark, d)).rejects.select("line", "fields_found", "fields_expected")


def sink_round_trip(spark, d):
    """The customers as they come back from each sink."""
    kept = table(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit('\n"said"')).alias("c_name"), "c_acctbal")
    path, schema = _new_folder(spark, "sinks"), kept.schema
    write_csv(kept, f"{path}/csv")
    write_json(kept, f"{path}/json")
    write_parquet(kept, f"{path}/parquet")
    back = {
        "csv": read_csv_multiline(spark, f"{path}/csv").table.drop("_row_id"),
        "json": spark.read.schema(schema).json(f"{path}/json"), "parquet": spark.read.parquet(f"{path}/parquet"),
    }
    out = None
    for name, df in back.items():
        part = df.select(F.lit(name).alias("sink"), "c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
        out = part if out is None else out.unionByName(part)
    return out


def history_store(spark, d):
    """The rewards of each signature committed one after the other, as the store has them in the end."""
    path, rewards = _new_folder(spark, "history"), _rewards(spark, d)
    for signature in ("sig:0", "sig:1"):
        commit_scores(rewards.where(F.col("signature") == signature), path)
    return rounded(load_history(spark, path), 8)


def typed_columns(spark, d):
    c = planted(spark, d, "dirty_orders").select("paid", "zip", F.col("o_orderkey").cast("string").alias("code"),
                                                 F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".5")).alias("amount"))
    typed = type_columns(c, ["paid", "zip", "code", "amount"])
    return typed.groupBy().agg(
        F.max(F.typeof("paid")).alias("paid_type"), F.max(F.typeof("zip")).alias("zip_type"),
        F.max(F.typeof("code")).alias("code_type"), F.max(F.typeof("amount")).alias("amount_type"),
        F.sum("code").alias("code_sum"), F.sum("amount").alias("amount_sum"),
    )


def preview_rows(spark, d):
    head, more = preview(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), 6, "o_orderkey")
    return head.withColumn("truncated", F.lit(more))


def validation_checks(spark, d):
    li = table(spark, d, "lineitem")
    variants = [
        ("fine", planted(spark, d, "lines"), "label", LINE_IDS),
        ("continuous", li.select("l_quantity", "l_extendedprice"), "l_extendedprice", None),
        ("gaps", planted(spark, d, "lines").select("price", "quantity"), "quantity", None),
        ("no_numbers", li.select("l_linestatus", "l_returnflag"), "l_returnflag", None),
        ("absent", li.select("l_quantity", "l_returnflag"), "nothing", None),
    ]
    out = None
    for name, df, target, ids in variants:
        c = validate_classification(df, target, 3, ids).select(F.lit(name).alias("variant"), "*")
        out = c if out is None else out.unionByName(c)
    return out.withColumnRenamed("check", "check_name")


def chosen_features(spark, d):
    """Numeric columns kept as features, all others dropped."""
    df = table(spark, d, "orders")
    return df.select(*[q(c) for c in numeric_features(df, "o_orderstatus")])


def encoded_labels(spark, d):
    return encode_labels(table(spark, d, "orders"), "o_orderpriority").groupBy("o_orderpriority", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


def routes(spark, d):
    rows = []
    for name, df, target, ids in [
        ("lines", planted(spark, d, "lines"), "label", LINE_IDS),
        ("contacts", planted(spark, d, "contacts"), "email", None),
        ("parts", planted(spark, d, "parts"), "label", ["p_partkey"]),
    ]:
        rows.append((name, choose_route(validate_classification(df, target, 3, ids))))
    return spark.createDataFrame(rows, "table_name string, route string")


def digamma_sizes(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(sizes.select("l_orderkey", digamma(F.col("n")).alias("digamma")), 6)


QUERIES: dict[str, Query] = {
    "profile_dirty_orders": profile_dirty_orders,
    "profile_events": profile_events,
    "profile_dataset": profile_dataset,
    "fingerprint_check": fingerprint_check,
    "column_roles": column_roles,
    "quantiles_lineitem": quantiles_lineitem,
    "value_frequencies": value_frequencies,
    "quality_before_after": quality_before_after,
    "parse_currency": parse_currency,
    "parse_dates": parse_dates,
    "title_names": title_names,
    "digamma_sizes": digamma_sizes,
    "repair_trim_sentinels": repair_trim_sentinels,
    "repair_rows": repair_rows,
    "repair_drop_constants": repair_drop_constants,
    "repair_log": repair_log,
    "repair_again": repair_again,
    "standard_fields": standard_fields,
    "standard_steps": standard_steps,
    "fill_gaps": fill_gaps,
    "fill_modes": fill_modes,
    "clean_contacts": clean_contacts,
    "clean_metrics": clean_metrics,
    "plan_decisions": plan_decisions,
    "plan_notes": plan_notes,
    "plan_transform": plan_transform,
    "plan_rare_levels": plan_rare_levels,
    "plan_export": plan_export,
    "terrain": terrain,
    "impute_mean": impute_mean,
    "impute_median": impute_median,
    "impute_most_frequent": impute_most_frequent,
    "impute_nearest": impute_nearest,
    "impute_iterative": impute_iterative,
    "impute_iterative_lines": impute_iterative_lines,
    "variance_features": variance_features,
    "rows_iqr": rows_iqr,
    "rows_zscore": rows_zscore,
    "rows_guard": rows_guard,
    "scale_standard": scale_standard,
    "scale_minmax": scale_minmax,
    "scale_robust": scale_robust,
    "oversample_accounts": oversample_accounts,
    "mutual_info_scores": mutual_info_scores,
    "principal_axes": principal_axes,
    "enhance_phalanx": _enhance("phalanx", "lines", LINE_IDS),
    "enhance_skirmisher": _enhance("skirmisher", "vectors", ["vec_id"]),
    "enhance_heavy_cavalry": _enhance("heavy_cavalry", "accounts", ["c_custkey"]),
    "enhance_guerrilla": _enhance("guerrilla", "accounts", ["c_custkey"]),
    "enhance_scorched_earth": _enhance("scorched_earth", "vectors", ["vec_id"]),
    "enhance_reconnaissance": _enhance("reconnaissance", "lines", LINE_IDS),
    "enhance_siege": _enhance("siege", "parts", ["p_partkey"]),
    "enhance_diplomat": _enhance("diplomat", "accounts", ["c_custkey"]),
    "enhance_metrics": enhance_metrics,
    "folds_lineitem": folds_lineitem,
    "sample_accounts": sample_accounts,
    "retention_lines": retention_lines,
    "index_components": index_components,
    "score_folds": score_folds,
    "scoreboard_counts": scoreboard_counts,
    "recipe_scoreboard": recipe_scoreboard,
    "forest_scoreboard": forest_scoreboard,
    "noise_cells": noise_cells,
    "refinement_log": refinement_log,
    "rank_summary": rank_summary,
    "predict_rows": predict_rows,
    "history_update": history_update,
    "history_recommend": history_recommend,
    "history_select": history_select,
    "ragged_csv": ragged_csv,
    "ragged_csv_rejects": ragged_csv_rejects,
    "csv_files": csv_files,
    "csv_file_rejects": csv_file_rejects,
    "sink_round_trip": sink_round_trip,
    "history_store": history_store,
    "typed_columns": typed_columns,
    "preview_rows": preview_rows,
    "validation_checks": validation_checks,
    "chosen_features": chosen_features,
    "encoded_labels": encoded_labels,
    "routes": routes,
}
