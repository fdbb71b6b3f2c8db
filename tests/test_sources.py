"""Quoted CSV read by many tasks, against Python's reader and Spark's."""

import csv
import io
import random

import pytest

from tidemark.plans import catalogue
from tidemark.sources import csv as source
from tidemark.sources.csv import CsvError, ends_inside, quoted_records, read_csv_multiline


def random_csv(seed, rows):
    r = random.Random(seed)
    cells = ["plain", 'say "hi"', "two\nlines", "", " ", 'end"', '"', '""', "a,b", ",\n,", '\n"\n', "x" * 60, 'it\'s 5"', "\n\n", "é漢"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "first", "second"])
    data = [[str(i), r.choice(cells), r.choice(cells) * r.choice([1, 1, 1, 9])] for i in range(rows)]
    writer.writerows(data)
    return out.getvalue(), data


def test_line_ends():
    for line, outside, inside in [
        ("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""', True, False), ('"a"",b', True, False), ('x,"', True, False),
        ('","', False, True), ('a",b', False, False), ('a",b,"c', True, True), ('""', False, True), ('"""', True, False), ('"a"b"c,d', False, False), ("", False, True),
    ]:
        assert (ends_inside(line, False), ends_inside(line, True)) == (outside, inside), line
    assert not ends_inside('"' + '""' * 200_000 + '"' + ",x" * 200_000, False)  # no deep recursion


@pytest.mark.parametrize("size", [150, 4000])
def test_quoted_records_by_splits_of_any_size(spark, tmp_path, size):
    for name, seed, rows in (("a.csv", 1, 200), ("b.csv", 2, 1), ("c.csv", 3, 60)):
        (tmp_path / name).write_text(random_csv(seed, rows)[0])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = quoted_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name in ("a.csv", "b.csv", "c.csv"):
        own = sorted((r for r in records if r["_file"].endswith(name)), key=lambda r: (r["_start"], r["_row_id"]))
        text = (tmp_path / name).read_text()
        assert [next(csv.reader(io.StringIO(r["line"], newline=""))) for r in own] == list(csv.reader(io.StringIO(text, newline="")))
        assert "\n".join(r["line"] for r in own) + "\n" == text
    if size == 150:
        assert len({(r["_file"], r["_start"]) for r in records}) > 20


def test_many_tasks_equal_sparks_reader(spark, tmp_path):
    text, data = random_csv(7, 800)
    (tmp_path / "one.csv").write_text(text.replace("\n", "\r\n"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        read = read_csv_multiline(spark, str(tmp_path / "one.csv"), keep_padded=False)
        got = {r["id"]: (r["first"], r["second"]) for r in read.table.collect()}
        assert source._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 5 and read.stats.first()["rejected_rows"] == 0
        want = spark.read.csv(str(tmp_path / "one.csv"), header=True, multiLine=True, quote='"', escape='"', emptyValue="")
        want = {int(r["id"]): tuple(v if (v or "").strip() else None for v in (r["first"], r["second"])) for r in want.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cell = lambda v: v if v.strip() else None
    rows = list(csv.reader(io.StringIO(text.replace("\n", "\r\n"), newline="")))[1:]
    assert got == {int(r[0]): tuple(map(cell, r[1:])) for r in rows} and len(got) == len(data)
    # Spark's reader turns line ends inside quotes into line feeds.
    assert {k: tuple(v and v.replace("\r\n", "\n") for v in r) for k, r in got.items()} == want


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "open.csv").write_text('a,b\n1,2\n3,"4\n' + "5,6\n" * 100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        read = read_csv_multiline(spark, str(tmp_path))
        assert [(r["a"], r["b"]) for r in read.table.collect()] == [(1, 2)]
        assert [len(r["line"].split("\n")) for r in read.rejects.collect()] == [101]
        monkeypatch.setattr(source, "LONGEST_RECORD", 100)
        with pytest.raises(CsvError, match="never closed"):
            read_csv_multiline(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_splits_that_begin_inside_quotes_beyond_the_broadcast(spark, tmp_path, monkeypatch):
    text, _ = random_csv(11, 60)
    (tmp_path / "x.csv").write_text(text)
    monkeypatch.setattr(source, "FEW_SPLITS", -1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "90")
    try:
        own = sorted(quoted_records(spark, str(tmp_path)).collect(), key=lambda r: (r["_start"], r["_row_id"]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "\n".join(r["line"] for r in own) + "\n" == text


def test_csv_queries_over_many_files(spark, tmp_path, monkeypatch):
    """csv_files and csv_file_rejects write files of bounded size, with the same rows; repairs run once for counts, types and results."""
    orders = spark.range(1, 1500).selectExpr(
        "id o_orderkey", "id % 90 o_custkey", "'O' o_orderstatus", "concat(id % 5, '-P') o_orderpriority"
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    found = []
    for rows in (10_000, 100):
        monkeypatch.setattr(catalogue, "CSV_FILE_ROWS", rows)
        files = spark.read.text(catalogue._csv_folder(spark, str(tmp_path))).select("_metadata.file_path").distinct().count()
        assert files == 3 * -(-1499 // (3 * rows))
        found.append([sorted(map(tuple, q(spark, str(tmp_path)).collect()), key=str) for q in (catalogue.csv_files, catalogue.csv_file_rejects)])
    assert found[0] == found[1] and len(found[0][0]) + len(found[0][1]) == 1499 and found[0][1]
