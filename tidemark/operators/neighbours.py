"""Exact k nearest neighbours without a cross join, also for vectors with gaps.

Donor points are collapsed to distinct vectors with a count and parted by which features they have, so that within a part every
distance to a query is taken over the same features. Each part is sorted along a space-filling curve and cut into blocks; a block has
a tight bounding box, and a tree of boxes stands above the blocks, level by level, as tables. Queries are blocked
alike. In each round a block of queries visits its nearest blocks of donors not seen yet, which gives or shrinks the bound
of its k-th distances; the rounds end when no box within the bound is left. Inside a block, distances are a numpy
calculation over Arrow batches. Nothing is sampled away: sketches and curve affect speed, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import q
from ..session import materialise
from .quantiles import sketches

BLOCK_ROWS = 8192        # donor vectors in a block
QUERY_ROWS = 512         # query vectors in a block
PART_ROWS = 20_000       # query vectors that one task searches a block for
FANOUT = 32              # boxes below a box
RUN_ROWS = 32            # donor vectors of a run inside a block
FIRST_RUNS = 4           # nearest runs that a query looks at first
FIRST_VISITS = 2         # blocks that a block of queries visits in the first round; later rounds visit four times as many each
SEARCH_TASKS = 4         # tasks for each core that the visits of a round are dealt to
_CELLS = 500_000         # distance cells held at once inside a task
_HELD = 500_000          # candidates held at once inside a task
_LEVELS = 1024           # steps of a feature along the curve


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """Vectors as rows, gaps as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _curve(m: np.ndarray, grids: list[np.ndarray | None]) -> np.ndarray:
    """Place of each vector along a Z-shaped curve: the leading bits of its features' ranks, dealt in turn."""
    used = [j for j, g in enumerate(grids) if g is not None][:60]
    code = np.zeros(len(m), np.int64)
    bits = min(10, 60 // max(1, len(used)))
    ranks = {j: np.where(np.isnan(m[:, j]), 0, np.clip(np.searchsorted(grids[j], np.nan_to_num(m[:, j])), 0, _LEVELS - 1)).astype(np.int64) for j in used}
    for b in range(bits):
        for j in used:
            code = (code << 1) | ((ranks[j] >> (9 - b)) & 1)
    return code


def _pattern(vec: str) -> Column:
    """Which features a vector has, as text of 0 and 1."""
    return F.array_join(F.transform(vec, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")


def _blocked(points: DataFrame, grids: list[np.ndarray | None], rows: int, block: str) -> DataFrame:
    """``points`` (grp, vec, ...) with pattern, curve and a number of their block: at most ``rows`` neighbours along the curve of one part."""
    d, kept = len(grids), points.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", curve long"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _curve(_matrix(batch.column("vec"), d), grids) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "curve"])

    coded = materialise(points.mapInArrow(add, schema).withColumn("pattern", _pattern("vec")), "curve")
    keys = ["grp", "pattern", "curve"]
    dealt = coded.repartitionByRange(*keys, F.xxhash64("vec")).sortWithinPartitions(*keys)
    placed = materialise(dealt.withColumn("at", F.monotonically_increasing_id()), "dealt")
    part = F.shiftright("at", 33)
    first = placed.groupBy("grp", "pattern", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # Blocks are numbered over all runs (a run: one part in one partition).
    order = Window.orderBy("part", "grp", "pattern")  # one row a run
    count = F.ceil(F.col("n") / F.lit(rows))
    runs = first.withColumn("before", F.sum(count).over(order) - count)
    same = (F.col("grp") == F.col("_g")) & (F.col("pattern") == F.col("_p")) & (part == F.col("part"))
    joined = placed.join(runs.select(F.col("grp").alias("_g"), F.col("pattern").alias("_p"), "part", "first", "before"), same)
    number = F.col("before") + F.floor((F.col("at") - F.col("first")) / F.lit(rows))
    return joined.select(*kept, "pattern", number.cast("long").alias(block))


def _boxes(blocked: DataFrame, d: int, block: str) -> DataFrame:
    """block, grp, pattern, lo and hi (arrays, null where the part lacks the feature), size."""
    aggs = [F.first("grp").alias("grp"), F.first("pattern").alias("pattern"), F.count(F.lit(1)).alias("size")]
    lo = [F.min(F.col("vec")[j]).alias(f"lo{j}") for j in range(d)]
    hi = [F.max(F.col("vec")[j]).alias(f"hi{j}") for j in range(d)]
    found = blocked.groupBy(block).agg(*aggs, *lo, *hi)
    return found.select(block, "grp", "pattern", "size", F.array(*[f"lo{j}" for j in range(d)]).alias("lo"), F.array(*[f"hi{j}" for j in range(d)]).alias("hi"))


def _tree(boxes: DataFrame, d: int) -> list[DataFrame]:
    """Levels of boxes from the blocks up to one for each part: node, parent, grp, pattern, lo, hi."""
    in_part = Window.partitionBy("grp", "pattern").orderBy("block")  # one row a block
    level = materialise(boxes.withColumn("node", (F.row_number().over(in_part) - 1).cast("long")), "boxes")
    levels = []
    most = level.agg(F.max("node")).first()[0] or 0
    while True:
        levels.append(level.withColumn("parent", F.floor(F.col("node") / F.lit(FANOUT))))
        if most < 1:
            return levels
        up = levels[-1].groupBy("grp", "pattern", "parent").agg(
            *[F.min(F.col("lo")[j]).alias(f"lo{j}") for j in range(d)], *[F.max(F.col("hi")[j]).alias(f"hi{j}") for j in range(d)]
        )
        level = materialise(up.select(
            "grp", "pattern", F.col("parent").alias("node"),
            F.array(*[f"lo{j}" for j in range(d)]).alias("lo"), F.array(*[f"hi{j}" for j in range(d)]).alias("hi"),
        ), "boxes")
        most //= FANOUT


def _least_distance(d: int) -> Column:
    """Least distance between a box of queries (qlo, qhi) and one of donors (lo, hi), over the features both have."""
    gaps = [
        F.greatest(F.col("lo")[j] - F.col("qhi")[j], F.col("qlo")[j] - F.col("hi")[j], F.lit(0.0)) for j in range(d)
    ]
    both = [F.col("lo")[j].isNotNull() & F.col("qlo")[j].isNotNull() for j in range(d)]
    total = sum((F.when(b, g * g).otherwise(0.0) for b, g in zip(both, gaps)), F.lit(0.0))
    shared = sum((b.cast("int") for b in both), F.lit(0))
    return F.when(shared > 0, F.sqrt(F.lit(float(d)) / F.greatest(shared, F.lit(1)) * total))


def _useful(d: int, fill_gaps: bool) -> Column:
    """Whether a part can tell queries of a pattern anything: they share a feature and, to fill gaps, it has one that they lack."""
    both = F.lit(False)
    more = F.lit(not fill_gaps)
    for j in range(d):
        ours, theirs = F.substring("qpattern", j + 1, 1), F.substring("pattern", j + 1, 1)
        both = both | ((ours == "1") & (theirs == "1"))
        more = more | ((ours == "0") & (theirs == "1"))
    return both & more


def _descend(blocks: DataFrame, levels: list[DataFrame], d: int, fill_gaps: bool, beam: int | None) -> DataFrame:
    """(qblock, block, far) that a query block may have to visit, ``far`` being the least distance of the boxes.

    ``blocks`` has qblock, qpattern, grp, qlo, qhi and bound. At each level only boxes within the bound stay and, with ``beam``, only so
    many of the nearest.
    """
    carried = ["qblock", "qpattern", "grp", "qlo", "qhi", "bound"]
    here = blocks.select(*carried, F.lit(None).cast("string").alias("of"), F.lit(0).cast("long").alias("up"))
    nearest = Window.partitionBy("qblock").orderBy("far", "node", "pattern")
    for i, level in enumerate(reversed(levels)):
        below = level.withColumnRenamed("grp", "_g")
        on = (F.col("grp") == F.col("_g")) & (F.col("parent") == F.col("up"))
        joined = here.join(below, on if i == 0 else on & (F.col("pattern") == F.col("of")))
        if i == 0:
            joined = joined.where(_useful(d, fill_gaps))
        # A hair of slack keeps rounding from hiding a block that ties.
        here = joined.withColumn("far", _least_distance(d)).where(F.col("far") <= F.col("bound") * (1 + 1e-9))
        if beam:
            here = here.withColumn("_nth", F.row_number().over(nearest)).where(F.col("_nth") <= beam).drop("_nth")
        if i < len(levels) - 1:
            here = here.select(*carried, F.col("pattern").alias("of"), F.col("node").alias("up"))
    return here.select("qblock", "block", "far")


def _least(row: np.ndarray, dist: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least (dist, tie) of each row, in that order."""
    order = np.lexsort((tie, dist, row))
    row = row[order]
    return order[np.arange(len(row)) - np.searchsorted(row, row) < k]


_FOUND = "qid long, slot int, dist double, hit array<double>, mult long"


def _box_distance(a: np.ndarray, low: np.ndarray, high: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Least distance of each point to each box over the shared features."""
    total = np.zeros((len(a), len(low)))
    for j in shared:
        total += np.maximum(np.maximum(low[None, :, j] - a[:, j, None], a[:, j, None] - high[None, :, j]), 0.0) ** 2
    return np.sqrt(a.shape[1] / len(shared) * total)


def _searcher(d: int, k: int, fill_gaps: bool, grids: list[np.ndarray | None], visited):
    """Search of one block for the queries that visit it (cogrouped).

    The block is cut into short runs with boxes of their own. A query looks at its nearest runs, which bound its k-th distance here,
    and then at the runs within that bound and the one it came with; the bound shrinks with each run, and what lies beyond it is dropped, so that
    a task holds little more than the k nearest of the queries of a step.
    """

    def pieces(queries: pa.Table, donors: pa.Table) -> Iterator[tuple]:
        b = _matrix(donors.column("vec"), d)
        order = np.argsort(_curve(b, grids), kind="stable")
        b, mult = b[order], donors.column("mult").to_numpy()[order]
        cuts = np.arange(0, len(b), RUN_ROWS)
        low, high = np.minimum.reduceat(b, cuts, axis=0), np.maximum.reduceat(b, cuts, axis=0)
        has = ~np.isnan(b[0])
        whole = np.empty(len(b))
        whole[np.lexsort(b.T[::-1])] = np.arange(len(b))
        everyone = _matrix(queries.column("vec"), d)
        place = _curve(everyone, grids)
        patterns, pattern = np.unique(~np.isnan(everyone), axis=0, return_inverse=True)
        for p, seen in enumerate(patterns):
            shared = np.flatnonzero(seen & has)
            slots = np.flatnonzero(~seen & has) if fill_gaps else [0]
            if not len(shared) or not len(slots):
                continue
            own = np.flatnonzero(pattern.ravel() == p)
            own = own[np.argsort(place[own], kind="stable")]  # queries of a step lie together and see few runs
            step = max(1, _CELLS // max(RUN_ROWS, len(cuts)))
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                yield from one(everyone[rows], rows, queries, b, mult, cuts, low, high, whole, shared, slots)

    def one(a, rows, queries, b, mult, cuts, low, high, whole, shared, slots) -> Iterator[tuple]:
        ids, reach = queries.column("qid").to_numpy()[rows], queries.column("reach").to_numpy()[rows] * (1 + 1e-9)
        far = _box_distance(a, low, high, shared)
        live = far.min(axis=1) <= reach
        seen = np.zeros(far.shape, bool)
        nearest = np.full((len(a), k), np.inf)  # the k least distances so far; only what lies within the last can count
        found: list[tuple] = []
        held = [0, 0]  # candidates now, and after the last time that they were cut to the k nearest

        def tie(slot: int, c: np.ndarray) -> np.ndarray:
            return b[c, slot] if fill_gaps else whole[c]

        def within(rows: np.ndarray) -> np.ndarray:
            return np.minimum(reach[rows], nearest[rows].max(axis=1) * (1 + 1e-9))

        def kept() -> tuple:
            r, c, dist, count = (np.concatenate(x) for x in zip(*found))
            some = dist <= within(r)
            return r[some], c[some], dist[some], count[some]

        def look(rows: np.ndarray, run: int) -> None:
            seen[rows, run] = True
            part = slice(cuts[run], cuts[run] + RUN_ROWS)
            total = np.zeros((len(rows), len(b[part])))
            for j in shared:
                total += (a[rows, j, None] - b[None, part, j]) ** 2
            if visited is not None:
                visited.add(total.size)
            dist, same = np.sqrt(d / len(shared) * total), None
            if not fill_gaps:
                same = np.ones(dist.shape, bool)
                for j in range(d):
                    same &= a[rows, j, None] == b[None, part, j]
                dist[same & (mult[part] == 1)] = np.inf
            nearest[rows] = np.partition(np.concatenate([nearest[rows], dist], axis=1), k - 1, axis=1)[:, :k]
            r, c = np.nonzero((dist <= within(rows)[:, None]) & (dist < np.inf))
            found.append((rows[r], c + cuts[run], dist[r, c], mult[part][c] - (0 if same is None else same[r, c])))
            held[0] += len(r)
            if held[0] > 2 * held[1] + _HELD:
                r, c, dist, count = kept()
                best = np.unique(np.concatenate([_least(r, dist, tie(slot, c), k) for slot in slots]))
                found[:] = [(r[best], c[best], dist[best], count[best])]
                held[:] = [len(best)] * 2

        first = np.argsort(far, axis=1, kind="stable")[:, :FIRST_RUNS]
        for nth in range(first.shape[1]):
            for run in np.unique(first[live, nth]):
                more = np.flatnonzero(live & (first[:, nth] == run))
                more = more[far[more, run] <= within(more)]
                if len(more):
                    look(more, run)
        bound = within(np.arange(len(a)))
        for run in np.flatnonzero(((far <= bound[:, None]) & live[:, None] & ~seen).any(axis=0)):
            more = np.flatnonzero((far[:, run] <= bound) & live & ~seen[:, run])
            more = more[far[more, run] <= within(more)]
            if len(more):
                look(more, run)
        if found:
            r, c, dist, count = kept()
            for slot in slots:
                best = _least(r, dist, tie(slot, c), k)
                hits = b[c[best]][:, [slot]] if fill_gaps else b[c[best]]
                yield ids[r[best]], np.full(len(best), slot, np.int32), dist[best], hits, count[best]

    def search(queries: pa.Table, donors: pa.Table) -> pa.Table:
        parts = list(pieces(queries, donors)) if len(queries) and len(donors) else []
        empty = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros((0, 1 if fill_gaps else d)), np.zeros(0, np.int64)
        ids, slots, dist, hits, count = (np.concatenate(x) for x in zip(empty, *parts))
        ends = np.arange(len(hits) + 1, dtype=np.int32) * hits.shape[1]
        return pa.Table.from_arrays(
            [pa.array(ids), pa.array(slots), pa.array(dist), pa.ListArray.from_arrays(pa.array(ends), pa.array(hits.ravel())), pa.array(count.astype(np.int64))],
            names=["qid", "slot", "dist", "hit", "mult"],
        )

    return search


def _search(visits: DataFrame, queries: DataFrame, pool: DataFrame, reach: DataFrame | None, d: int, k: int, fill_gaps: bool, grids, visited) -> DataFrame:
    """What the visits find. A block that many queries visit is dealt to several tasks by query.

    The number of tasks is given: their work follows distances, not bytes, and by bytes Spark would leave it to one task.
    """
    tasks = SEARCH_TASKS * visits.sparkSession.sparkContext.defaultParallelism
    asked = visits.join(queries.select("qid", "qblock", "vec"), "qblock")
    asked = asked.join(reach, "qid") if reach is not None else asked.withColumn("reach", F.lit(float("inf")))
    load = visits.join(queries.groupBy("qblock").agg(F.count(F.lit(1)).alias("n")), "qblock").groupBy("block").agg(
        F.greatest(F.ceil(F.sum("n") / F.lit(PART_ROWS)), F.lit(1)).cast("int").alias("parts")
    )
    dealt = asked.join(load, "block").withColumn("part", F.pmod(F.col("qid"), F.col("parts")).cast("int"))
    copies = pool.join(load, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["block", "part"]
    return (
        dealt.select(*keys, "qid", "vec", "reach").repartition(tasks, *keys).groupBy(*keys)
        .cogroup(copies.select(*keys, "vec", "mult").repartition(tasks, *keys).groupBy(*keys))
        .applyInArrow(_searcher(d, k, fill_gaps, grids, visited), _FOUND)
    )


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    d: int,
    k: int,
    fill_gaps: bool,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    visited=None,
) -> DataFrame:
    """(grp, vec, slot, dist, hit, mult, take): the k nearest by (dist, hit) of each query and slot, exact.

    ``queries``: (grp, vec), distinct. ``donors``: (grp, vec, mult), distinct. With
    ``fill_gaps`` each missing cell of a query is a slot and donors are the vectors
    that have it; otherwise the slot is 0 and one copy of the query is not its own
    neighbour. Distances are over the features both have, scaled up by their share; without a common one there is none.
    ``take`` says how many copies of a hit count. ``visited``, an accumulator, counts the distances taken.
    """
    donors = materialise(donors.select("grp", "vec", "mult"), "donors")
    seen = sketches(donors, {str(j): F.col("vec")[j] for j in range(d)})
    grids = [seen[str(j)].grid[1:-1] if seen[str(j)] is not None else None for j in range(d)]
    pool = materialise(_blocked(donors, grids, block_rows, "block"), "pool")
    levels = _tree(_boxes(pool, d, "block"), d)
    asked = _blocked(queries.select(F.col("grp").alias("grp"), F.col("vec").alias("vec")), grids, query_rows, "qblock")
    asked = materialise(asked.withColumn("qid", F.monotonically_increasing_id()), "queries")
    boxes = materialise(_boxes(asked, d, "qblock").select(
        "qblock", "grp", F.col("pattern").alias("qpattern"), F.col("lo").alias("qlo"), F.col("hi").alias("qhi"), "size"
    ), "query-boxes")

    blocks = levels[0].count()
    per_query = F.length(F.regexp_replace("pattern", "1", "")) if fill_gaps else F.lit(1)
    best: DataFrame | None = None
    done: DataFrame | None = None
    reach: DataFrame | None = None
    beam = FIRST_VISITS
    while True:
        if reach is None:
            todo = _descend(boxes.withColumn("bound", F.lit(float("inf"))), levels, d, fill_gaps, beam)
        else:
            bound = asked.join(reach, "qid").groupBy("qblock").agg(F.max("reach").alias("bound"))
            within = _descend(boxes.join(bound, "qblock"), levels, d, fill_gaps, None)
            left = within.join(done, ["qblock", "block"], "left_anti")
            nth = F.row_number().over(Window.partitionBy("qblock").orderBy("far", "block"))
            todo = left.withColumn("_nth", nth).where(F.col("_nth") <= beam)
        todo = materialise(todo.select("qblock", "block"), "visits")
        if best is not None and todo.isEmpty():
            break
        found = _search(todo, asked, pool, reach, d, k, fill_gaps, grids, visited)
        best = materialise(top_k(found if best is None else best.select(*found.columns).unionByName(found), k, ["qid", "slot"]), "near")
        if blocks <= beam:
            break  # the first round has seen all there is
        done = todo if done is None else done.unionByName(todo)
        filled = best.groupBy("qid", "slot").agg(F.sum("take").alias("got"), F.max("dist").alias("far"))
        filled = filled.where(F.col("got") >= k).groupBy("qid").agg(F.count(F.lit(1)).alias("slots"), F.max("far").alias("far"))
        full = F.col("slots") >= per_query
        reach = materialise(asked.join(filled, "qid", "left").select(
            "qid", F.when(full, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach")
        ), "reach")
        beam *= 4
    return best.join(asked.select("qid", "grp", "vec"), "qid").drop("qid")


def top_k(found: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """The k best candidates by ``keys``; ``take`` says how many copies count."""
    w = Window.partitionBy(*keys).orderBy("dist", "hit")
    before = F.coalesce(F.sum("mult").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        found.withColumn("_before", before)
        .where(F.col("_before") < k)
        .withColumn("take", F.least(F.col("mult"), F.lit(k) - F.col("_before")))
        .drop("_before")
    )


def knn_impute(
    df: DataFrame, train: DataFrame, features: list[str], k: int = 5, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Fill missing features with the mean of the k nearest training rows that have them.

    Only incomplete rows are searched and joined; complete rows pass through without
    a shuffle. Equal distances prefer the smaller donor value.
    """
    d = len(features)
    vec = F.array(*[q(f).cast("double") for f in features])
    means = train.agg(*[F.avg(q(f)) for f in features]).first()
    donors = train.select(vec.alias("vec")).groupBy("vec").agg(F.count(F.lit(1)).alias("mult"))
    donors = donors.select(F.lit(0).cast("bigint").alias("grp"), "vec", "mult")
    any_gap = F.exists("_vec", lambda x: x.isNull())
    marked = df.withColumn("_vec", vec)
    asked = marked.where(any_gap).select(F.lit(0).cast("bigint").alias("grp"), F.col("_vec").alias("vec")).distinct()
    picked = nearest(asked, donors, d, k, True, block_rows)
    cells = picked.groupBy("vec", "slot").agg(
        (F.sum(F.col("hit")[0] * F.col("take")) / F.sum("take")).alias("value")
    )
    per_row = cells.groupBy("vec").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("_fills"))
    holes = marked.where(any_gap).join(per_row, F.col("_vec") == F.col("vec"), "left")
    names = [c for c in df.columns if c not in features]
    fixed = holes.select(
        *[q(c) for c in names],
        *[
            F.coalesce(q(f).cast("double"), F.element_at("_fills", F.lit(j)), F.lit(means[j])).alias(f)
            for j, f in enumerate(features)
        ],
    )
    whole = marked.where(~any_gap).select(*[q(c) for c in names], *[q(f).cast("double").alias(f) for f in features])
    return whole.unionByName(fixed).select(*[q(c) for c in df.columns])
