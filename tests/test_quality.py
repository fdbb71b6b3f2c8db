"""Roles, profile, repair, standard forms, cleaning, plan."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalars import coerce_numeric, parse_mixed_date, strip, title_case
from tidemark.operators import clean as cleaning
from tidemark.operators.clean import clean
from tidemark.operators.profile import profile
from tidemark.operators import repair
from tidemark.operators.repair import structural_repair, trim_and_null, without_copies
from tidemark.operators.roles import infer_roles
from tidemark.plans.cleaning_plan import apply_plan, build_plan, export, fit_plan
from tidemark.sources.csv import CsvError, normalise_header, preview, read_csv_multiline, read_csv_repaired
from tidemark.sources.sinks import write_csv, write_json, write_parquet


@pytest.fixture(scope="module")
def churn(spark):
    """640 rows with planted faults, plus 7 exact copies."""
    rng = random.Random(7)
    rows = []
    for i in range(640):
        rows.append((
            rng.randint(1, 71), 999.0 if i < 14 else round(rng.gauss(70, 15), 2),
            None if 90 <= i < 126 else round(rng.gauss(2000, 600), 2), f"0{rng.randint(1000, 9999)}",
            f"P{i % 9}" if i % 3 == 0 else str(1 + i % 8), rng.choice("MF"),
            rng.choice(["  Oslo", "Quito  ", " Perth "]), int(rng.random() < 0.18),
        ))
    rows += rows[300:307]
    return spark.createDataFrame(
        rows, "tenure_months int, monthly_charges double, total_charges double, zip string, plan_code string, "
        "gender string, city string, churn int"
    ).repartition(3).persist()


def test_profile_finds_planted_faults(churn):
    p = profile(churn)
    by = {r["column"]: r for r in p.column_rows}
    assert by["zip"]["role"] == "identifier"
    assert by["gender"]["role"] == by["plan_code"]["role"] == "categorical"
    assert by["total_charges"]["n_missing"] == 36
    assert by["monthly_charges"]["n_extreme"] >= 14
    assert p.dataset_row["n_duplicate_rows"] == 7
    assert p.dataset_row["uniqueness_pct"] == round(100 * (1 - 7 / 647), 3)
    assert p.columns.count() == 8 and p.dataset.count() == 1


def test_repair_keeps_extremes_and_is_idempotent(churn):
    once, log = structural_repair(churn)
    assert once.count() == 640
    assert once.where("monthly_charges = 999.0").count() == 14
    assert once.where(F.col("zip").rlike("^0")).count() == 640
    assert once.where(F.col("city").rlike(r"^\s|\s$")).count() == 0
    steps = [r["step"] for r in log.collect()]
    assert steps[:2] == ["trim_whitespace", "drop_duplicate_rows"]
    twice, _ = structural_repair(once)
    assert twice.dtypes == once.dtypes
    assert twice.exceptAll(once).count() == 0 and once.exceptAll(twice).count() == 0


def test_plan_and_leak_barrier(spark, churn):
    repaired, _ = structural_repair(churn)
    plan = build_plan(profile(repaired), target="churn")
    by = {d.column: d for d in plan.decisions}
    assert by["zip"].action == "drop" and "churn" not in by
    assert by["total_charges"].add_indicator
    train, test = repaired.where("tenure_months > 20"), repaired.where("tenure_months <= 20")
    fitted = fit_plan(train, plan)
    fill = dict((c, f) for c, f, _, _ in fitted.numeric)["total_charges"]
    mean, median = train.agg(F.avg("total_charges"), F.percentile("total_charges", F.lit(0.5))).first()
    assert abs(fill - (median if by["total_charges"].impute == "median" else mean)) < 1e-6
    coded = apply_plan(test, fitted)
    assert coded.count() == test.count()
    assert "missingindicator_total_charges" in coded.columns and "gender_F" in coded.columns
    assert fitted.to_frame(spark).where("part = 'level'").count() > 0
    out, warning = export(repaired, plan)
    assert out.where("total_charges is null").count() == 0 and warning
    assert "total_charges__was_missing" in out.columns and "zip" in out.columns


def test_small_role_inputs(spark):
    df = spark.range(500).select(
        F.col("id").alias("row"), (20 + F.col("id") % 7).alias("age"), F.concat(F.lit("v"), "id").alias("thing"),
        F.concat(F.lit("P"), F.col("id") % 3).alias("plan_code"), F.concat(F.lit("ORD-"), "id").alias("order_number"),
        F.lit(None).cast("string").alias("gone"), F.lit("x").alias("same"),
    )
    roles = {r["column"]: r["role"] for r in infer_roles(df).collect()}
    assert roles == {
        "row": "identifier", "age": "numeric", "thing": "identifier", "plan_code": "categorical",
        "order_number": "identifier", "gone": "empty", "same": "constant",
    }


def test_scalars(spark):
    text = ["$5", "($5)", "$(5)", "(-5)", "1,200.50", " 12 ", "1e3", ".5", "5.", "1d", "1_000", "0x1F", "", "(5", "abc"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in text], "c string").select(coerce_numeric(F.col("c"))).collect()]
    assert got == [5.0, -5.0, 5.0, 5.0, 1200.5, 12.0, 1000.0, 0.5, 5.0, None, None, None, None, None, None]
    dates = {
        "12-03-2026": "2026-03-12", "Mar-19-2026": "2026-03-19", "19 Mar 2026": "2026-03-19", "2026/13/04": "2026-04-13",
        "2026-03-12 10:20:30": "2026-03-12", "March 3, 2020": "2020-03-03", "1/2/99": "1999-02-01", "20260312": "2026-03-12",
        "31/12/2021 5:06 PM": "2021-12-31", "13/14/2026": None, "1200": None, "Mar-19": None, "10:30": None, "30-02-2020": None,
    }
    rows = spark.createDataFrame([(t,) for t in dates], "c string").select(
        "c", F.date_format(parse_mixed_date(F.col("c")), "yyyy-MM-dd").alias("d")
    )
    assert {r["c"]: r["d"] for r in rows.collect()} == dates
    assert spark.range(1).select(title_case(F.lit("o'neil mc-DONALD x2y"))).first()[0] == "O'Neil Mc-Donald X2Y"


def test_messy_business_csv(spark, tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text(
        "Order_ID,Customer_Name,Email,Age,Order_Date,Product_Category,Price_Paid,Country,\n"
        "A-1, ann lee,ANN@MAIL.ORG,41,05-02-2025,garden,300,usa,\n"
        "A-2,omar diaz,omar@diaz,forty,Apr-07,2025,Toys,$12.50,U.K.\n"
        "A-2,omar diaz,omar@diaz,forty,Apr-07,2025,Toys,$12.50,U.K.\n"
        "A-3,,kim@mail.org,200,06-02-2025,,N/A,United States,\n"
    )
    read = read_csv_repaired(spark, str(path))
    assert read.steps == ["repaired_2_malformed_rows"] and read.rejects.count() == 0
    head, more = preview(read.table, 3)
    assert head.count() == 3 and more
    done = clean(read.table, ["_row_id"], read.steps)
    rows = done.table.orderBy("_row_id").collect()
    assert [r["Customer_Name"] for r in rows] == ["Ann Lee", "Omar Diaz", "Ann Lee"]
    assert [r["Email"] for r in rows] == ["ann@mail.org", "ann@mail.org", "kim@mail.org"]
    assert [r["Age"] for r in rows] == [41.0, 41.0, 41.0]
    assert [r["Order_Date"] for r in rows] == ["2025-02-05", "2025-04-07", "2025-02-06"]
    assert [r["Product_Category"] for r in rows] == ["Garden", "Toys", "Garden"]
    assert [r["Price_Paid"] for r in rows] == [300.0, 12.5, 156.25]
    assert [r["Country"] for r in rows] == ["United States", "United Kingdom", "United States"]
    m = done.metrics.first()
    assert (m["input_rows"], m["output_rows"], m["output_columns"], m["missing_filled"]) == (4, 3, 13, 6)
    assert (m["duplicate_rows_removed"], m["completeness_before"], m["completeness_after"]) == (1, 93.75, 100.0)
    assert done.steps == [
        "repaired_2_malformed_rows", "trim_whitespace", "normalise_missing_sentinels", "drop_duplicate_rows",
        "cast_types", "standardized_customer_name", "validated_email", "bounded_age_0_120",
        "standardized_order_date", "standardized_product_category", "standardized_country",
    ]


def test_csv_header_and_rejects(spark, tmp_path):
    assert normalise_header([" a ", "", "b", "", ""]) == ["a", "Unnamed_2", "b"]
    for bad in (["", ""], ["a", "a"]):
        with pytest.raises(CsvError):
            normalise_header(bad)
    path = tmp_path / "bad.csv"
    path.write_text('a,b\n1,2\n"open,3\n4,5,6\n\n007,8\n')
    read = read_csv_repaired(spark, str(path))
    assert read.rejects.count() == 2
    assert read.table.orderBy("_row_id").select("a", "b").collect() == [("1", 2), (None, None), ("007", 8)]
    with pytest.raises(CsvError):
        read_csv_repaired(spark, str(path), fail_on_reject=True)


def test_multiline_and_sinks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note,when,\n1,"two\nlines",2024-01-02,\n2, ,,\n')
    read = read_csv_multiline(spark, str(path))
    rows = read.table.orderBy("_row_id").collect()
    assert [r["note"] for r in rows] == ["two\nlines", None] and [r["id"] for r in rows] == [1, 2]
    assert read.stats.first()["rejected_rows"] == 0
    df = read.table.drop("_row_id")
    write_csv(df, str(tmp_path / "c"))
    write_json(df, str(tmp_path / "j"))
    write_parquet(df, str(tmp_path / "p"))
    assert spark.read.csv(str(tmp_path / "c"), header=True, multiLine=True, quote='"', escape='"').count() == 2
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_files_that_order_their_columns_differently(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,_cost,_created_at\n1,2.5,2024-01-01\n")
    (tmp_path / "b.csv").write_text("_created_at,id,_cost\n2024-01-02,7,3.5\n")
    for reader in (read_csv_repaired, read_csv_multiline):
        rows = sorted(tuple(r) for r in reader(spark, str(tmp_path)).table.select("id", "_cost", "_created_at").collect())
        assert rows == [(1, 2.5, "2024-01-01"), (7, 3.5, "2024-01-02")]
    (tmp_path / "c.csv").write_text("id,other,_cost\n1,2,3\n")
    for reader in (read_csv_repaired, read_csv_multiline):
        with pytest.raises(CsvError):
            reader(spark, str(tmp_path))


def test_multiline_reports_every_row(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('id,date,n\n1,"a\nb",5\n3,2024-01-03,7,d,EXTRA,MORE\n4,Mar-19,2026,8\n5,x\n')
    read = read_csv_multiline(spark, str(path))
    assert [r["id"] for r in read.table.orderBy("_row_id").collect()] == [1, 4, 5]
    assert read.table.where("id = 4").first()["date"] == "Mar-19-2026"
    assert [r["fields_found"] for r in read.rejects.collect()] == [6]
    assert tuple(read.stats.first())[:3] == (4, 2, 1)


def test_nested_columns_are_refused(spark):
    with pytest.raises(ValueError):
        profile(spark.range(3).select(F.array("id").alias("a")))


def test_rare_and_unseen_levels(spark):
    rows = [(i, "common" if i % 100 else f"rare{i}") for i in range(500)]
    train = spark.createDataFrame(rows, "id long, kind string")
    plan = build_plan(profile(train.select("kind")))
    fitted = fit_plan(train, plan)
    assert fitted.rare.count() == 5
    fresh = spark.createDataFrame([(1, "common"), (2, "rare100"), (3, "never"), (4, None)], "id long, kind string")
    got = {r["id"]: (r["kind_common"], r["kind_infrequent"]) for r in apply_plan(fresh, fitted, ["id"]).collect()}
    assert got == {1: (1.0, 0.0), 2: (0.0, 1.0), 3: (0.0, 0.0), 4: (1.0, 0.0)}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_takes_every_unicode_space_without_a_pattern(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    rows = [(f"{a}x{a}y{a}{a}",) for a in spaces] + [("".join(spaces),), ("",), (None,), ("\u200bx\u180e",), (" \u00e9\u6f22 \U0001f600\n",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(strip(F.col("t"))).collect()]
    old = [r[0] for r in df.select(F.regexp_replace("t", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).collect()]
    assert got == old and got[0] == f"x{spaces[0]}y"
    assert "regexp_replace" not in _plan(df.select(strip(F.col("t"))))


def test_numbers_and_dates_of_plain_form_equal_the_general_rules(spark):
    cells = {
        "12": 12.0, "-0": -0.0, "+7.": 7.0, "007.50": 7.5, "1-2": None, "5 -3": None, "1e-5": 1e-5, "1e -5": 1e-5, "12\n": 12.0,
        "F": None, "i n f": float("inf"), "INFINITY": float("inf"), "$-4": -4.0, "($5)": -5.0, "$(5)": 5.0, ".5": 0.5, "1.2.3": None,
    }
    df = spark.createDataFrame([(c,) for c in cells], "t string")
    assert [r[0] for r in df.select(coerce_numeric(F.col("t"))).collect()] == list(cells.values())
    days = {
        "2024-02-30": None, "2024-13-05": "2024-05-13", "2024/02/29": "2024-02-29", "31.12.1999": "1999-12-31", "02-28-2023": "2023-02-28",
        "05 06 2020": "2020-06-05", "0000-01-01": "0000-01-01", "13-13-2020": None, " 2024-01-02": "2024-01-02", "2024-01-02\n": "2024-01-02",
    }
    df = spark.createDataFrame([(c,) for c in days], "t string")
    assert [r[0] for r in df.select(parse_mixed_date(F.col("t")).cast("date").cast("string")).collect()] == list(days.values())


def test_rows_without_copies_are_made_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(repair, "materialise", lambda df, label, real=repair.materialise: written.append(label) or real(df, label))
    df = spark.createDataFrame([(" a", 1), ("a", 1), ("b", 2), (None, 2)], "t string, n int")
    kept = without_copies(trim_and_null(df))
    assert sorted(map(tuple, kept.collect()), key=str) == [("a", 1), ("b", 2), (None, 2)]
    assert written == ["marked", "copied"] and "trim" not in _plan(kept)


def test_clean_fills_from_standard_forms_that_are_made_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(cleaning, "fill_missing", lambda df, apart, real=cleaning.fill_missing: plans.append(_plan(df)) or real(df, apart))
    rows = [(i, f"ann o'neil{i % 7}", "Jan-5-2024" if i % 3 else "1700-02-03", None if i == 4 else f"{i}.5") for i in range(30)]
    done = clean(spark.createDataFrame(rows, "k int, full_name string, signup_date string, unit_price string"))
    assert "regexp" not in plans[0] and "rlike" not in plans[0].lower()
    got = {r["signup_date"] for r in done.table.collect()}
    assert got == {"2024-01-05", "1700-02-03"} and done.table.where("full_name like 'Ann O\\'Neil%'").count() == 30
