"""Tolerant CSV reading: ragged rows are repaired or reported, never dropped silently."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import words
from ..functions.scalars import let, parse_mixed_date, q, strict_number, strip
from ..session import materialise

STATS_SCHEMA = "rows_read bigint, repaired_rows bigint, rejected_rows bigint, steps array<string>"

# One field: quoted with doubled quotes inside, or bare text up to the comma.
_FIELD = r'("[^"]*+(?:""[^"]*+)*+"|[^,"][^,]*+|),'


# The same for one line of a record: fields up to their commas, and a quoted field that ends.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'
_WHOLE_FIELDS = re.compile(rf'(?:(?:{_QUOTED}(?:[^",][^,]*+)?+|[^",][^,]*+|),)*+')
_QUOTED_FIELD = re.compile(_QUOTED)
_INSIDE = re.compile(r'[^"]*+(?:""[^"]*+)*+')

#: Splits that begin inside quotes, up to which they are broadcast.
FEW_SPLITS = 1_000_000
#: Files up to which their headers are broadcast.
FEW_FILES = 100_000
#: A record longer than this (characters) means a quote that is never closed.
LONGEST_RECORD = 1 << 28


class CsvError(ValueError):
    """The file cannot be read as CSV."""


@dataclass
class CsvRead:
    """``table`` typed and repaired, ``rejects`` the rows no repair fits, ``stats`` one row."""

    table: DataFrame
    rejects: DataFrame
    stats: DataFrame
    steps: list[str]


def normalise_header(fields: list[str]) -> list[str]:
    """Strip names, drop trailing empty ones, name inner empty ones by position."""
    names = [f.strip() for f in fields]
    while names and not names[-1]:
        names.pop()
    if not names:
        raise CsvError("CSV header is empty")
    names = [n or f"Unnamed_{i + 1}" for i, n in enumerate(names)]
    if len(set(names)) < len(names):
        raise CsvError("CSV header holds the same column name twice")
    return names


def split_fields(line: Column) -> Column:
    """Fields of one CSV line; NULL when the quoting is broken."""
    text = F.concat(line, F.lit(","))
    tokens = F.regexp_extract_all(text, F.lit(_FIELD), 1)
    whole = F.concat(F.array_join(tokens, ","), F.lit(",")) == text
    fields = F.transform(
        tokens,
        lambda t: F.when(
            t.startswith('"'), F.replace(t.substr(F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))
        ).otherwise(t),
    )
    # A blank line has no fields at all, as opposed to one empty field.
    return F.when(line == "", F.array().cast("array<string>")).when(whole, fields)


def trim_overflow(fields: Column, width: int) -> Column:
    """Drop blank fields beyond the header width from the right."""
    used = F.coalesce(
        F.array_max(
            F.transform(fields, lambda v, i: F.when(v.rlike(r"(?U)[^\s]"), i + 1).otherwise(F.lit(0)))
        ),
        F.lit(0),
    )
    return F.when(F.size(fields) > width, F.slice(fields, F.lit(1), F.greatest(used, F.lit(width)))).otherwise(fields)


def join_split_date(fields: Column, header: list[str]) -> Column:
    """Rejoin a date that its own comma split into extra fields; NULL when none fits."""
    width = len(header)
    over = F.size(fields) - width
    out = F.when(over <= 0, fields)
    for i, name in enumerate(header):
        if not any(t in name.lower() for t in words.DATE_TOKENS):
            continue
        piece = F.replace(
            strip(F.array_join(F.slice(fields, F.lit(i + 1), F.greatest(over + 1, F.lit(0))), ",")), F.lit(","), F.lit("-")
        )
        rest = F.slice(fields, over + i + 2, F.greatest(F.size(fields), F.lit(0)))
        spliced = F.concat(F.slice(fields, 1, i), F.array(piece), rest) if i else F.concat(F.array(piece), rest)
        out = out.when((over + i + 1 <= F.size(fields)) & parse_mixed_date(piece).isNotNull(), spliced)
    return out


def repair_lines(lines: DataFrame, header: list[str], line: str = "line") -> DataFrame:
    """Add ``_fields`` (NULL when beyond repair), ``_width`` and ``_repaired`` to a table of CSV lines.

    The steps are bound one inside the other: as separate columns, a filter on the
    result would be pushed below them and repeat every step many times over.
    """
    width = len(header)

    def outcome(raw: Column, joined: Column) -> Column:
        short = F.size(joined) < width
        padded = F.when(
            short, F.concat(joined, F.array_repeat(F.lit(""), F.lit(width) - F.size(joined)))
        ).otherwise(joined)
        return F.struct(
            padded.alias("_fields"),
            F.size(raw).alias("_width"),
            (joined.isNotNull() & ((F.size(raw) > width) | short)).alias("_repaired"),
        )

    result = let(
        split_fields(q(line)),
        lambda cut: let(
            trim_overflow(cut, width),
            lambda raw: let(join_split_date(raw, header), lambda joined: outcome(raw, joined)),
        ),
    )
    return lines.withColumn("_r", result).select(*[q(c) for c in lines.columns], "_r._fields", "_r._width", "_r._repaired")


def blank_to_null(c: Column) -> Column:
    return F.when(~c.rlike(r"(?U)^\s*$"), c)


def type_columns(df: DataFrame, columns: list[str], keep_padded: bool = True) -> DataFrame:
    """All-or-nothing numeric typing: bigint or double where every non-blank cell parses.

    Zero-padded columns stay text (``keep_padded=False`` types them as well).
    """
    aggs = []
    for i, c in enumerate(columns):
        v = q(c)
        aggs += [
            F.count(v).alias(f"n{i}"),
            F.count_if(v.isNotNull() & strict_number(v).isNull()).alias(f"bad{i}"),
            F.count_if(strip(v).rlike(r"^[+-]?[0-9]+$") & strip(v).try_cast("bigint").isNotNull()).alias(f"whole{i}"),
            F.count_if(strip(v).rlike(words.PADDED_NUMBER)).alias(f"pad{i}"),
        ]
    row = df.agg(*aggs).first().asDict()
    out = []
    for name in df.columns:
        if name not in columns:
            out.append(q(name))
            continue
        i = columns.index(name)
        number = row[f"n{i}"] and not row[f"bad{i}"] and not (keep_padded and row[f"pad{i}"])
        if not number:
            out.append(q(name))
        elif row[f"whole{i}"] == row[f"n{i}"]:
            out.append(strip(q(name)).try_cast("bigint").alias(name))
        else:
            out.append(strict_number(q(name)).alias(name))
    return df.select(*out)


def _headers(spark: SparkSession, first: DataFrame) -> tuple[DataFrame, list[str]]:
    """(_file, _header) of every file with its names in its order, and the names of the first file.

    ``first`` has each file's first record (_file, line), its header. Files may order their columns differently; other names
    are refused.
    """
    different = first.groupBy(F.regexp_replace("line", "^\ufeff", "").alias("line")).agg(F.min("_file").alias("_file")).orderBy("_file").collect()
    if not different:
        raise CsvError("CSV must contain a header and data rows")
    texts = spark.createDataFrame([(r["line"],) for r in different], "line string")
    parsed = {r["line"]: r["f"] for r in texts.select("line", split_fields(F.col("line")).alias("f")).collect()}
    if any(f is None for f in parsed.values()):
        raise CsvError("CSV header has broken quotes")
    headers = {text: normalise_header(fields) for text, fields in parsed.items()}
    names = headers[different[0]["line"]]
    for text, own in headers.items():
        if sorted(own) != sorted(names):
            raise CsvError(f"files differ in their columns: {text[:200]!r} does not name {names}")
    # One row for each different header text, however many files there are.
    orders = spark.createDataFrame([(t, own) for t, own in headers.items()], "line string, _header array<string>")
    files = first.withColumn("line", F.regexp_replace("line", "^\ufeff", "")).join(F.broadcast(orders), "line").select("_file", "_header")
    return files, names


def _result(fixed: DataFrame, header: list[str], keep_padded: bool, fail_on_reject: bool) -> CsvRead:
    """Table, rejects and counts of repaired rows (_file, _row_id, line, _header, _fields, _width, _repaired)."""
    spark = fixed.sparkSession
    counts = fixed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_repaired").alias("repaired"), F.count_if(F.col("_fields").isNull()).alias("rejected"),
    ).first()
    if counts["n"] == 0:
        raise CsvError("CSV must contain a header and data rows")
    rejects = fixed.where(F.col("_fields").isNull()).select(
        "_file", "_row_id", "line", F.col("_width").alias("fields_found"), F.lit(len(header)).alias("fields_expected")
    )
    if fail_on_reject and counts["rejected"]:
        bad = rejects.orderBy("_row_id").first()
        raise CsvError(
            f"{counts['rejected']} rows beyond repair; first: {bad['fields_found']} fields, expected {len(header)}"
        )
    cells = fixed.where(F.col("_fields").isNotNull()).select(
        "_row_id",
        *[blank_to_null(F.element_at("_fields", F.array_position("_header", F.lit(n)).cast("int"))).alias(n) for n in header],
    )
    steps = [f"repaired_{counts['repaired']}_malformed_rows"] if counts["repaired"] else []
    stats = spark.createDataFrame([(counts["n"], counts["repaired"], counts["rejected"], steps)], STATS_SCHEMA)
    return CsvRead(type_columns(cells, header, keep_padded), rejects, stats, steps)


def _repaired(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Repaired rows, by each order of columns there is (a file's own names say where a split date may be)."""
    found = files.select("_header").distinct().collect()
    parts = []
    for r in found:
        own = rows.where(F.col("_header") == F.array(*map(F.lit, r["_header"]))) if len(found) > 1 else rows
        parts.append(repair_lines(own, r["_header"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """line, _file, _start (where the split begins in its file) and _row_id, lines of a split in order."""
    return spark.read.text(path, **options).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row_id"),
    )


def _read(spark: SparkSession, records: DataFrame, keep_padded: bool, fail_on_reject: bool) -> CsvRead:
    """The result for records (line, _file, _start, _row_id) of files whose first record is their header."""
    heads = records.where(F.col("_start") == 0).groupBy("_file").agg(F.min("_row_id").alias("_head"), F.min_by("line", "_row_id").alias("line"))
    heads = materialise(heads, "csv-heads")
    files, header = _headers(spark, heads.select("_file", "line"))
    told = files.join(heads.select("_file", "_head"), "_file")
    told = F.broadcast(told) if heads.count() <= FEW_FILES else told
    body = records.join(told, "_file").where(F.col("_row_id") != F.col("_head"))
    # Counts, types, table and rejects all read the repaired rows.
    fixed = materialise(_repaired(body.select("_file", "_row_id", "line", "_header"), files), "csv-repaired")
    return _result(fixed, header, keep_padded, fail_on_reject)


def read_csv_repaired(
    spark: SparkSession, path: str, keep_padded: bool = True, fail_on_reject: bool = False
) -> CsvRead:
    """Read a CSV file, or a folder of CSV files with one header each, line by line.

    Lines are split by column expressions, so any file size spreads over tasks and short, blank and overlong rows are counted
    exactly. Columns go by the names in each file's first line. Here a line is a record: both halves of one with a quoted line break
    are reported as rejects, and ``read_csv_multiline`` reads such files.
    """
    lines = _lines(spark, path)
    return _read(spark, lines, keep_padded, fail_on_reject)


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is still open at the end of a line that begins inside one, or at the start of a record.

    A quote opens a field only where the field begins; a doubled one inside is a quote; what follows the closing one up to the
    comma belongs to the field.
    """
    at = 0
    if inside:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        at = line.find(",", at + 1) + 1
        if not at:
            return False
    at = _WHOLE_FIELDS.match(line, at).end()
    return line.startswith('"', at) and _QUOTED_FIELD.match(line, at) is None


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Pieces of batches that lie in one split each, and whether a split begins there."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column("_file").to_pylist(), batch.column("_start").to_pylist()))
        lo = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[lo]:
                yield keys[lo] != last, batch.slice(lo, i - lo)
                last, lo = keys[lo], i


def _first_text(line: str, start: int) -> str:
    return line.removeprefix("\ufeff") if start == 0 else line


def _split_ends(lines: DataFrame) -> DataFrame:
    """_file, _start, from_record, from_inside: for each split, whether it ends inside quotes if it begins at a record's start, or inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (False, True)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, *state)], names=["_file", "_start", "from_record", "from_inside"])

        for begins, piece in _by_split(batches):
            if begins:
                if now is not None:
                    yield row()
                now, state = (piece.column("_file")[0].as_py(), piece.column("_start")[0].as_py()), (False, True)
            for i, line in enumerate(piece.column("line").to_pylist()):
                if '"' in line:
                    line = _first_text(line, now[1]) if begins and i == 0 else line
                    ends = {inside: ends_inside(line, inside) for inside in {*state}}
                    state = ends[state[0]], ends[state[1]]
        if now is not None:
            yield row()

    return lines.select("_file", "_start", "line").mapInArrow(run, "_file string, _start long, from_record boolean, from_inside boolean")


def _open_splits(ends: DataFrame) -> DataFrame:
    """_file, _start of the splits that begin inside quotes: the ends of all earlier splits of the file, one applied after the other.

    A split either ends alike whatever came before, or keeps the state, or turns it over. So a split's state is that after the last
    split of the first sort, turned as often as splits of the last sort follow. The window holds one row a split.
    """
    fixed = F.col("from_record") == F.col("from_inside")
    turns = F.col("from_record") & ~F.col("from_inside")
    so_far = Window.partitionBy("_file").orderBy("_start")
    counted = ends.withColumn("_turns", F.sum(turns.cast("long")).over(so_far))
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(fixed, F.struct("from_record", "_turns")), ignorenulls=True).over(before)
    seen = counted.withColumn("_known", known).withColumn("_before", F.coalesce(F.lag("_turns").over(so_far), F.lit(0)))
    turned = (F.col("_before") - F.coalesce(F.col("_known._turns"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("_known.from_record"), F.lit(False)) != turned
    return seen.where(inside).select("_file", "_start", F.lit(True).alias("_inside"))


_PIECES = "_file string, _start long, _row_id long, line string, begins boolean, ends boolean"


def _pieces(lines: DataFrame, open_splits: DataFrame) -> DataFrame:
    """Records, and the pieces of those that reach over the end of a split (``begins`` or ``ends`` is false), in the order of lines."""
    few = open_splits.count() <= FEW_SPLITS
    told = lines.join(F.broadcast(open_splits) if few else open_splits, ["_file", "_start"], "left")
    if not few:  # the join has dealt the lines anew
        told = told.sortWithinPartitions("_file", "_start", "_row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        held: list[str] = []  # lines of the record that is open
        head, begun, inside = None, True, False

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for begins, piece in _by_split(batches):
            rows: list[tuple] = []
            if begins:
                if held:
                    rows.append((*head, "\n".join(held), begun, False))
                held, inside = [], bool(piece.column("_inside")[0].as_py())
                begun = not inside
            file, start = piece.column("_file")[0].as_py(), piece.column("_start")[0].as_py()
            for i, (line, row_id) in enumerate(zip(piece.column("line").to_pylist(), piece.column("_row_id").to_pylist())):
                line = _first_text(line, start) if begins and i == 0 else line
                if not held:
                    head = (file, start, row_id)
                held.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    rows.append((*head, "\n".join(held).removesuffix("\r"), begun, True))
                    held, begun = [], True
            if rows:
                yield table(rows)
        if held:
            yield table([(*head, "\n".join(held), begun, False)])

    return told.select("_file", "_start", "_row_id", "line", "_inside").mapInArrow(run, _PIECES)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """line, _file, _start, _row_id: the records of CSV files whose quoted fields may hold line breaks, read in parallel.

    A first pass tells for each split of a file whether it ends inside quotes, for both states in which it may begin; these
    maps, composed over the splits of a file, give the state in which each begins. A second pass cuts each split into
    records, and only the pieces at the edges of splits are brought together. Both passes are tasks over splits without a shuffle of lines;
    a task holds one record. Compressed files are one split each.
    """
    lines = _lines(spark, path, lineSep="\n")
    ends = materialise(_split_ends(lines), "csv-splits")
    pieces = materialise(_pieces(lines, _open_splits(ends)), "csv-pieces")
    whole = pieces.where(F.col("begins") & F.col("ends")).select("line", "_file", "_start", "_row_id")
    in_file = Window.partitionBy("_file").orderBy("_start", "_row_id")  # at most two rows a split
    edges = pieces.where(~(F.col("begins") & F.col("ends"))).withColumn("_record", F.sum(F.col("begins").cast("long")).over(in_file))
    sizes = edges.groupBy("_file", "_record").agg(F.sum(F.length("line")).alias("n")).where(F.col("n") > LONGEST_RECORD).limit(1).collect()
    if sizes:
        raise CsvError(f"a quote is never closed: {sizes[0]['_file']} has a record of {sizes[0]['n']} characters")
    parts = F.array_sort(F.collect_list(F.struct("_start", "_row_id", "line")))
    joined = edges.groupBy("_file", "_record").agg(parts.alias("_parts")).select(
        F.regexp_replace(F.array_join("_parts.line", "\n"), r"\r\z", "").alias("line"), "_file",
        F.col("_parts")[0]["_start"].alias("_start"), F.col("_parts")[0]["_row_id"].alias("_row_id"),
    )
    return materialise(whole.unionByName(joined), "csv-records")


def read_csv_multiline(
    spark: SparkSession, path: str, keep_padded: bool = True, fail_on_reject: bool = False
) -> CsvRead:
    """As ``read_csv_repaired``, for files with line breaks inside quotes; one file is read by many tasks.

    All records go through the same repairs; those beyond repair are rejects (a quote that is never closed makes one of all that follows, up
    to ``LONGEST_RECORD`` characters). Blank lines between records are skipped. Lines end in a line feed, with or without a carriage return before it.
    """
    records = quoted_records(spark, path)
    return _read(spark, records.where(F.col("line") != ""), keep_padded, fail_on_reject)


def preview(df: DataFrame, rows: int = 6, order: str = "_row_id") -> tuple[DataFrame, bool]:
    """First rows in reading order and whether there are more: a bounded top-k, no full sort."""
    head = df.orderBy(q(order)).limit(rows)
    return head, df.limit(rows + 1).count() > rows
