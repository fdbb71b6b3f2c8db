"""Licence scan: whole texts and single lines, normalised, digested and joined with digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .joins import attach

#: Spellings that count as one (found as plain text in lower case, in this order).
EQUIVALENTS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("copyright owner", "copyright holder"),
    ("non-commercial", "noncommercial"), ("merchantibility", "merchantability"), ("per cent", "percent"), ("http://", "https://"),
]
#: A line that only names who holds rights: it says nothing about which licence it is.
RIGHTS_LINE = r"(?i)(^|\n)[ \t]*((copyright[ \t]+)?(\(c\)|©)|copyright[ \t]+[0-9<\[]|all[ \t]+rights[ \t]+reserved)[^\n]*"
#: What every text of ``KNOWN`` has after normalising; a line without it cannot match one of them.
KEYWORD = "licen"

#: Names and texts of known licences and notices.
KNOWN = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}


def normalised(text: Column) -> Column:
    """Lower case, one spelling, no lines of rights, words of letters and digits with one space between them."""
    text = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), RIGHTS_LINE, "\n"))
    for old, new in EQUIVALENTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """digest and licence of known texts; of texts with one digest the first name by order counts."""
    rows = spark.createDataFrame(list(known.items()), "licence string, text string")
    return rows.groupBy(digest(F.col("text")).alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame, keyword: str = "") -> DataFrame:
    """doc_id, digest, licence (of the whole text, else null) and notices (names of known texts that fill a line, in order, joined by commas).

    A null text counts as empty and an empty one matches nothing; texts are digested whole. Only lines that hold
    ``keyword`` are digested: name one only if no known text lacks it (``KEYWORD`` for ``KNOWN``). Repeated rows each give a row; rows of one
    doc_id share their notices, and rows of none get no notices. Other columns are ignored. Known digests are broadcast while they are few.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = attach(docs.select("doc_id", digest(F.col("text")).alias("digest")), known, "digest")
    lines = docs.where(F.lower("text").contains(keyword)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.where(F.lower("line").contains(keyword)).select("doc_id", digest(F.col("line")).alias("digest"))
    hits = attach(lines, known, "digest").where("licence is not null")
    notices = hits.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    found = notices.withColumnRenamed("doc_id", "__doc")
    joined = whole.join(found, F.col("doc_id") == F.col("__doc"), "left").drop("__doc")
    return joined.select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_digest(text: str) -> str:
    sql = f"lower(regexp_replace(coalesce({text}, ''), {_sql_text(RIGHTS_LINE)}, chr(10), 'g'))"
    for old, new in EQUIVALENTS:
        sql = f"replace({sql}, {_sql_text(old)}, {_sql_text(new)})"
    return f"sha256(trim(regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"


ORACLE = f"""
WITH known AS (
  SELECT {_sql_digest("t")} AS digest, min(n) AS licence
  FROM (VALUES {", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in KNOWN.items())}) AS k(n, t) GROUP BY 1
), lines AS (
  SELECT doc_id, {_sql_digest("line")} AS digest
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE lower(line) LIKE '%licen%'
), notices AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN known USING (digest) GROUP BY doc_id
)
SELECT d.doc_id, d.digest, known.licence, coalesce(notices, '') AS notices
FROM (SELECT doc_id, {_sql_digest("text")} AS digest FROM documents) d
LEFT JOIN known ON d.digest = known.digest LEFT JOIN notices ON d.doc_id = notices.doc_id
"""
