"""Document fingerprints: the smallest hashes of a text's word shingles, with DataFrame functions only.

A fingerprint is a bottom-k sketch: the ``k`` least distinct hashes of all shingles, joined by commas. Sketches of
parts merge into the sketch of the whole, and two of them estimate resemblance, containment and distinct counts.
A hash is the first 16 hex digits of a shingle's MD5, so SQL of any engine gives the same fingerprints.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written

#: Hashes in a fingerprint: resemblance is off by about sqrt(j * (1 - j) / SIZE).
SIZE = 128
#: Words in a shingle.
WORDS = 5
#: Most buckets that order the documents: bounds the cut points in the plan and the bucket heads that are broadcast.
MOST_BUCKETS = 65_536
_BUCKETS_A_PARTITION = 4
_DIGITS = 16
_SALTS = 64


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all runs of ``words`` words, in text order; of the whole sequence where it is shorter; none without a word."""
    blanks = "\t\n\x0b\x0c\r"
    found = F.filter(F.split(F.translate(text, blanks, " " * len(blanks)), " "), lambda w: w != "")
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
    hashed = lambda w: F.transform(
        starts(w), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, _DIGITS)
    )
    # The words are bound once: a lambda over a list of one.
    bound = F.element_at(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, hashed(w))), 1)
    return F.coalesce(bound, F.array().cast("array<string>"))


def fingerprint(text: Column, k: int = SIZE, words: int = WORDS) -> Column:
    """The fingerprint of a text; an empty string for a text without a word (null included)."""
    least = F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), words))), 1, k)
    return F.array_join(least, ",")


def hashes(sketch: Column) -> Column:
    return F.filter(F.split(sketch, ","), lambda h: h != "")


def merged(a: Column, b: Column, k: int = SIZE) -> Column:
    """The fingerprint of two texts' shingles taken together."""
    return F.array_join(F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, k), ",")


def resemblance(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated Jaccard similarity of two texts' shingle sets (exact up to ``k`` shingles in both): 1 for equal fingerprints."""
    low = F.slice(F.sort_array(F.array_union(hashes(a), hashes(b))), 1, k)
    common = F.size(F.array_intersect(low, F.array_intersect(hashes(a), hashes(b))))
    return F.when(a == b, F.lit(1.0)).otherwise(common / F.size(low))


def distinct_shingles(sketch: Column, k: int = SIZE) -> Column:
    """Estimated number of distinct shingles, exact below ``k``."""
    own = hashes(sketch)
    last = F.conv(F.substring(F.element_at(own, k), 1, 13), 16, 10).cast("double")
    return F.when(F.size(own) < k, F.size(own).cast("double")).otherwise(F.lit(float(k - 1)) / ((last + 1.0) / F.lit(2.0**52)))


def containment(a: Column, b: Column, k: int = SIZE) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1; 1 for a first text without shingles."""
    near, n_a, n_b = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(n_a == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), near * (n_a + n_b) / ((near + 1.0) * n_a)))


def merge_parts(parts: DataFrame, by: str, sketch: str = "fingerprint", k: int = SIZE) -> DataFrame:
    """``by`` and the merged fingerprint of all its rows; null keys form one part, null fingerprints count as empty.

    Hashes are cut to the ``k`` least of each salted share of a part before they meet, so a part with a third of
    all rows is no task's whole work.
    """
    rows = parts.select(F.col(by).alias("__part"), hashes(F.coalesce(F.col(sketch), F.lit(""))).alias("__hashes"))
    single = rows.select("__part", F.explode("__hashes").alias("__hash"))
    salt = F.pmod(F.xxhash64("__hash"), F.lit(_SALTS))
    shares = single.withColumn("__salt", salt).distinct()
    first = Window.partitionBy("__part", "__salt").orderBy("__hash")
    few = shares.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k)
    best = few.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy("__hash"))).where(F.col("__rank") <= k)
    joined = best.groupBy("__part").agg(F.array_join(F.sort_array(F.collect_list("__hash")), ",").alias("__sketch"))
    whole = rows.select("__part").distinct().withColumnRenamed("__part", "__key")
    return whole.join(joined, F.col("__key").eqNullSafe(F.col("__part")), "left").select(
        F.col("__key").alias(by), F.coalesce("__sketch", F.lit("")).alias(sketch)
    )


def _buckets(rows: DataFrame) -> Column:
    """Ascending bucket of each row (doc_id, tie): from quantiles of doc_id, hot ids cut further by ``tie``.

    The bucket is the number of cut points below doc_id. An id that takes up several cut points is dealt to all their
    buckets by ``tie``, which is spread evenly; ids without a value come first and have buckets by their share.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(MOST_BUCKETS, _BUCKETS_A_PARTITION * partitions)
    shares = [i / n for i in range(1, n)]
    seen = rows.agg(
        F.percentile_approx("doc_id", shares, 10 * n).alias("cuts"), F.count("*").alias("rows"), F.count("doc_id").alias("ids")
    ).first()
    cuts = F.from_json(F.lit(json.dumps(seen["cuts"] or [])), "array<bigint>")  # folded to one constant
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])

    def below(hit) -> Column:
        at = lambda place, step: F.get(cuts, place + step - 1)
        return F.aggregate(steps, F.lit(0), lambda place, step: F.when(hit(at(place, step)), place + step).otherwise(place))

    doc_id = F.col("doc_id")
    low, high = below(lambda cut: cut < doc_id), below(lambda cut: cut <= doc_id)
    missing = max(1, round(n * (seen["rows"] - seen["ids"]) / max(1, seen["rows"])))
    even = F.conv(F.substring("tie", 1, 13), 16, 10).cast("double") / F.lit(2.0**52)
    dealt = lambda first, count: (first + F.floor(even * count)).cast("int")
    return F.when(doc_id.isNull(), dealt(F.lit(-missing), F.lit(missing))).otherwise(dealt(low, high - low + 1))


def with_next(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: the next document is the one of next smaller doc_id.

    After the last document comes the first. Equal ids follow by descending MD5 of their texts, ids without a value
    come last, null texts are empty. Texts move once: documents are dealt to ordered buckets, and each bucket
    gets the head of the next one as an extra row, so no window spans the table. Rows equal in id and text stay together.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.md5(text).alias("tie"))
    placed = rows.withColumn("bucket", _buckets(rows))
    heads = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("head"))
    down = Window.orderBy(F.col("bucket").desc())  # one row a bucket
    everything = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("bucket").over(down), F.last("bucket").over(everything))
    heads = written(heads.withColumn("into", before).select(F.col("bucket").alias("__bucket"), "head", "into"), "bucket-heads")
    same = (F.col("bucket") == F.col("__bucket")) & F.struct("doc_id", "tie").eqNullSafe(F.col("head"))
    first_texts = placed.join(F.broadcast(heads), same).dropDuplicates(["bucket"])  # at most MOST_BUCKETS rows
    extra = first_texts.select("doc_id", "text", "tie", F.col("into").alias("bucket"), F.lit(True).alias("is_extra"))
    all_rows = placed.withColumn("is_extra", F.lit(False)).unionByName(extra)
    order = Window.partitionBy("bucket").orderBy("is_extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc())
    sketched = all_rows.withColumn("fingerprint", fingerprint(F.col("text"), k))
    return (
        sketched.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_fingerprint", F.lead("fingerprint").over(order))
        .where(~F.col("is_extra"))
        .select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    )


def compare_edits(docs: DataFrame, k: int = SIZE) -> DataFrame:
    """The fingerprint of each document beside that of its edited text and of the next document.

    In the edited text, the last half of the code points (rounded down) gives way to as many first ones of the next
    document, or all of it. A text without a word has an empty fingerprint, which is like another empty one (1)
    and unlike all others (0). An empty table gives no rows; columns of other names do not matter.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    edited = F.concat(kept, F.substring("next_text", F.lit(1), half))
    texts = with_next(docs, k).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited_text", edited)
    both = texts.withColumn("edited_fingerprint", fingerprint(F.col("edited_text"), k))
    own = F.col("fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint",
        resemblance(own, F.col("edited_fingerprint"), k).alias("near_edited"),
        resemblance(own, F.col("next_fingerprint"), k).alias("near_next"),
        F.round(distinct_shingles(own, k)).cast("long").alias("n_distinct"),
    )


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents
), o AS (
  SELECT *, coalesce(
    lead(text) OVER (ORDER BY doc_id DESC NULLS LAST, md5(text) DESC),
    first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, md5(text) DESC)) AS next_text
  FROM d
), e AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 2) || substr(next_text, 1, n_chars // 2) AS edited FROM o
), w AS (
  SELECT *,
    regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w0,
    regexp_extract_all(edited, '[^\\x20\\x09-\\x0D]+') AS w1,
    regexp_extract_all(next_text, '[^\\x20\\x09-\\x0D]+') AS w2
  FROM e
), s AS (
  SELECT *,
    CASE WHEN len(w0) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(
      range(1, greatest(len(w0) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w0[i:i + 4], ' ')), 1, 16))))[1:128] END AS a,
    CASE WHEN len(w1) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(
      range(1, greatest(len(w1) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w1[i:i + 4], ' ')), 1, 16))))[1:128] END AS b,
    CASE WHEN len(w2) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(
      range(1, greatest(len(w2) - 4, 1) + 1), lambda i: substr(md5(array_to_string(w2[i:i + 4], ' ')), 1, 16))))[1:128] END AS c
  FROM w
), u AS (
  SELECT *, list_sort(list_distinct(a || b))[1:128] AS ab, list_sort(list_distinct(a || c))[1:128] AS ac FROM s
)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a, ',') AS fingerprint, array_to_string(b, ',') AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0::DOUBLE ELSE len(list_intersect(ab, list_intersect(a, b)))::DOUBLE / len(ab) END AS near_edited,
  CASE WHEN a = c THEN 1.0::DOUBLE ELSE len(list_intersect(ac, list_intersect(a, c)))::DOUBLE / len(ac) END AS near_next,
  CASE WHEN len(a) < 128 THEN len(a)::BIGINT
    ELSE round(127.0::DOUBLE / ((('0x' || substr(a[128], 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370496.0::DOUBLE))::BIGINT END AS n_distinct
FROM u
"""
