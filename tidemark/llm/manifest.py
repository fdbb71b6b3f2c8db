"""Merkle manifest of a dataset with a witness for every row, built by appending.

Leaves are appended to aligned blocks. A block keeps its open subtrees as a stack; when two of equal height meet, each
is the other's sibling, so the witnesses of all leaves below them grow by one step. The root of a block is a further
append to a list of blocks, and so on until one root is left; a leaf's witness is its own block's, followed by the block's.

A witness is text: for each level ``L`` or ``R`` (the side on which the sibling stands) and the sibling's digest,
or ``-`` where the node is alone in its run.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .joins import attach
from .scratch import written

#: A block holds 2 ** BLOCK_HEIGHT leaves; a list of n leaves takes log(n) / BLOCK_HEIGHT rounds.
BLOCK_HEIGHT = 12


def joined_hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class OpenSubtrees:
    """The open subtrees of one growing list, each with its height, digest and range of leaves, and the leaves' witnesses so far."""

    def __init__(self):
        self.stack: list[tuple[int, str, int, int]] = []
        self.witnesses: list[list[str]] = []

    def _meet(self, left: tuple[int, str, int, int], right: tuple[int, str, int, int]) -> tuple[int, str, int, int]:
        for leaf in range(left[2], left[3]):
            self.witnesses[leaf].append("R" + right[1])
        for leaf in range(right[2], right[3]):
            self.witnesses[leaf].append("L" + left[1])
        return left[0] + 1, joined_hash(left[1], right[1]), left[2], right[3]

    def append(self, digest: str) -> None:
        place = len(self.witnesses)
        self.witnesses.append([])
        self.stack.append((0, digest, place, place + 1))
        while len(self.stack) > 1 and self.stack[-2][0] == self.stack[-1][0]:
            right = self.stack.pop()
            self.stack.append(self._meet(self.stack.pop(), right))

    def close(self, height: int) -> str:
        """The root at ``height``: the last subtree goes up alone until it meets a sibling."""
        while len(self.stack) > 1 or self.stack[-1][0] < height:
            level, digest, lo, hi = self.stack.pop()
            if self.stack and self.stack[-1][0] == level:
                self.stack.append(self._meet(self.stack.pop(), (level, digest, lo, hi)))
                continue
            for leaf in range(lo, hi):
                self.witnesses[leaf].append("-")
            self.stack.append((level + 1, joined_hash(digest), lo, hi))
        return self.stack[0][1]


def _grow_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """list, place, witness within the block; the block's root and list length stand with its first row."""

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        tree = OpenSubtrees()
        for digest in frame["digest"]:
            tree.append(digest)
        root = tree.close(min(height, (int(frame["n"].iloc[0]) - 1).bit_length()))
        out = frame[["list", "place", "n"]].copy()
        out["witness"] = ["".join(w) for w in tree.witnesses]
        out["root"] = [root] + [None] * (len(out) - 1)
        return out

    size = 1 << height
    blocks = nodes.groupBy("list", F.floor(F.col("place") / F.lit(size)).alias("block"))
    return blocks.applyInPandas(grow, "list string, place long, n long, witness string, root string")


def witnesses(nodes: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """list, place, witness, root of every node: ``nodes`` has list, place (from 0, without gaps), n (the list's length) and digest.

    A round turns each block of 2 ** height nodes into one, so its tasks are bounded however long a list is.
    """
    levels = [written(_grow_blocks(nodes, height), "manifest-blocks")]
    longest = nodes.agg(F.max("n")).first()[0] or 0
    size = 1 << height
    while longest > size:
        up = levels[-1].where(F.col("root").isNotNull()).select(
            "list", F.floor(F.col("place") / F.lit(size)).alias("place"), F.ceil(F.col("n") / F.lit(size)).alias("n"), F.col("root").alias("digest")
        )
        levels.append(written(_grow_blocks(up, height), "manifest-blocks"))
        longest = -(-longest // size)
    top = levels[-1]
    roots = top.where(F.col("root").isNotNull()).select(F.col("list").alias("__list"), F.col("root").alias("__root"))
    done = top.drop("root", "n").join(roots, F.col("list").eqNullSafe(F.col("__list"))).select("list", "place", "witness", F.col("__root").alias("root"))
    for level in reversed(levels[:-1]):
        upper = done.select(F.col("list").alias("__list"), F.col("place").alias("__block"), F.col("witness").alias("__more"), "root")
        same = F.col("list").eqNullSafe(F.col("__list")) & (F.floor(F.col("place") / F.lit(size)) == F.col("__block"))
        done = level.drop("root", "n").join(upper, same).select("list", "place", F.concat("witness", "__more").alias("witness"), "root")
    return done


def ranked(rows: DataFrame, list_col: str, *order: str) -> DataFrame:
    """``rows`` with place (from 0) and n: its rank in, and the length of, its list; nulls first, equal rows in any order.

    Rows are range-partitioned and sorted as a whole, so a list with a third of all rows is spread over many tasks;
    only the number of rows of each list in each partition is summed up.
    """
    keyed = written(rows.withColumn("__salt", F.monotonically_increasing_id()), "manifest-rows")
    by = [F.col(c).asc_nulls_first() for c in (list_col, *order, "__salt")]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    dealt = written(dealt.drop("__salt").withColumn("__share", F.struct(F.col(list_col), F.shiftright("__at", 33).alias("part"))), "manifest-order")
    shares = dealt.groupBy("__share").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    whole = Window.partitionBy(f"__share.{list_col}")  # one row a partition
    before = whole.orderBy("__share.part").rowsBetween(Window.unboundedPreceding, -1)
    shares = shares.select(
        "__share", "__first",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(whole).alias("n"),
    )
    placed = attach(dealt, written(shares, "manifest-shares"), "__share")
    place = F.col("__at") - F.col("__first") + F.col("__before")
    return placed.withColumn("place", place).drop("__at", "__share", "__first", "__before")


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as byte count, colon and text, or ``-`` for null."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def siblings(witness: Column) -> Column:
    """The siblings' digests of a witness, end to end."""
    return F.translate(witness, "LR-", "")


def folded(digest: Column, witness: Column) -> Column:
    """The root that a digest and a witness lead to."""
    step = lambda h, t: F.sha2(
        F.when(F.substring(t, 1, 1) == "L", F.concat(F.substring(t, 2, 64), h)).when(F.substring(t, 1, 1) == "R", F.concat(h, F.substring(t, 2, 64))).otherwise(h), 256
    )
    return F.aggregate(F.regexp_extract_all(witness, F.lit("(-|[LR][0-9a-f]{64})")), digest, step)


def manifest(docs: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """doc_id, lang, place, leaf, tampered, subroot, root, witness of every document.

    Leaves of a language ascend by doc_id (null first, rows of one id by their leaf); languages ascend by their bytes, null
    first. ``tampered`` is the leaf with 1 added to n_chars, where 7 divides the CRC-32 of doc_id and both have values,
    else the leaf. Repeated rows are leaves of their own; an empty table gives no rows; other columns are left out.
    """
    cols = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    hit = F.coalesce(F.crc32(cols["doc_id"].cast("string")) % 7 == 0, F.lit(False)) & cols["n_chars"].isNotNull()
    more = (cols["n_chars"].cast("decimal(20,0)") + F.lit(1)).cast("decimal(20,0)")
    leaf = leaf_digest(*cols.values())
    tampered = F.when(hit, leaf_digest(*(cols | {"n_chars": more}).values()))
    leaves = docs.select(cols["doc_id"].cast("long").alias("doc_id"), cols["lang"].cast("string").alias("lang"), leaf.alias("leaf"), tampered.alias("changed"))
    placed = ranked(leaves, "lang", "doc_id", "leaf")
    grown = written(
        witnesses(placed.select(F.col("lang").alias("list"), "place", "n", F.col("leaf").alias("digest")), height)
        .withColumnsRenamed({"list": "__lang", "place": "__place", "root": "subroot"}), "manifest-witnesses",
    )
    subroots = grown.where(F.col("__place") == 0).select(F.col("__lang").alias("lang"), "subroot")
    named = written(ranked(subroots.withColumn("all", F.lit("")), "all", "lang"), "manifest-subroots")
    tops = witnesses(named.select(F.col("all").alias("list"), "place", "n", F.col("subroot").alias("digest")), height)
    tops = named.select("lang", "place").join(tops.select("place", F.col("witness").alias("__top"), "root"), "place").drop("place")
    same = F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("place") == F.col("__place"))
    rows = placed.join(grown, same).drop("__lang", "__place")
    return attach(rows, written(tops, "manifest-tops"), "lang").select(
        "doc_id", "lang", "place", "leaf", F.coalesce("changed", "leaf").alias("tampered"), "subroot", "root",
        F.concat("witness", "__top").alias("witness"),
    )


def verified(docs: DataFrame, height: int = BLOCK_HEIGHT) -> DataFrame:
    """Each document's leaf, digest of its proof, the root that its (tampered) row leads to, and whether that is the manifest's."""
    found = manifest(docs, height).withColumn("folded_root", folded(F.col("tampered"), F.col("witness")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("witness")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLE = """
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), d AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents
), c AS (
  SELECT d.*, n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor(list_reduce(
    list_transform(range(1, length(coalesce(id, '')) + 1), lambda i: ascii(id[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS hit
  FROM d, steps
), p AS (
  SELECT *,
    coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM c
), v AS (
  SELECT doc_id, lang, hit,
    sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || strlen((n_chars::HUGEINT + 1)::VARCHAR) || ':' || (n_chars::HUGEINT + 1) || tail) END AS changed
  FROM p
), ranks AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM v
), tree(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY place) FROM ranks GROUP BY lang
  UNION ALL
  SELECT lang, level + 1,
    list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM tree WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS lang_place
  FROM tree WHERE len(nodes) = 1
), top(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY lang_place) FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
  FROM top WHERE len(nodes) > 1
), per_lang AS (
  SELECT lang, list(nodes ORDER BY level) AS trees FROM tree GROUP BY lang
), one AS (
  SELECT (SELECT list(nodes ORDER BY level) FROM top) AS tops, (SELECT max(nodes[1]) FROM top WHERE len(nodes) = 1) AS root
), w AS (
  SELECT r.*, s.subroot, one.root,
    list_transform(range(len(trees) - 1), lambda l: CASE WHEN (place >> l) & 1 = 1 THEN 'L' || trees[l + 1][place >> l]
      ELSE coalesce('R' || trees[l + 1][(place >> l) + 2], '-') END)
    || list_transform(range(len(tops) - 1), lambda l: CASE WHEN (lang_place >> l) & 1 = 1 THEN 'L' || tops[l + 1][lang_place >> l]
      ELSE coalesce('R' || tops[l + 1][(lang_place >> l) + 2], '-') END) AS steps
  FROM ranks r, one, per_lang t, subroots s
  WHERE r.lang IS NOT DISTINCT FROM t.lang AND r.lang IS NOT DISTINCT FROM s.lang
), f AS (
  SELECT *, list_reduce(steps, lambda h, x: sha256(
    CASE x[1] WHEN 'L' THEN x[2:] || h WHEN 'R' THEN h || x[2:] ELSE h END), coalesce(changed, leaf)) AS folded_root
  FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(translate(array_to_string(steps, ''), 'LR-', '')) AS proof_sha256,
  folded_root, folded_root = root AS verified
FROM f
"""
