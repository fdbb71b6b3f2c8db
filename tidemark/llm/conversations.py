"""Repair of conversations by the cheapest edits: a survivor-coalescence Viterbi search over each conversation's rows.

A repaired conversation is empty, or has pairs of user and assistant behind at most one system row. Each row is kept,
given another role or deleted, and empty rows may be inserted. After each row, the search knows the best
edits that lead to each state of that form. The survivors hang in a tree of edits with reference counts; what all
of them share is emitted, and no text stays in memory, because each branch carries the digest of its repaired text.

Every sequence of edits has one meaning (the state decides the role of a changed or inserted row), and edits of equal
cost, rows and state are never the beginning of one another. So ties are decided by the first edit in which two survivors
differ, wherever that stands, which is the comparison of their complete unresolved suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .words import slices

KEEP, REROLE, DELETE, INSERT = b"K", b"R", b"D", b"I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

#: States of the repaired part: nothing yet, or the initial of its last role.
NOTHING, SYSTEM, USER, ASSISTANT = "", "s", "u", "a"
_NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The one role that may be inserted, or given to a row, in each state.
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {"su", "ua", "au"}
#: What it costs at most, from one state, to do as well as any future of another; a survivor dearer than that is hopeless.
_DETOUR = {
    (NOTHING, SYSTEM): 0, (NOTHING, ASSISTANT): 0, (NOTHING, USER): 5,
    (SYSTEM, NOTHING): 10, (SYSTEM, ASSISTANT): 10, (SYSTEM, USER): 5,
    (USER, NOTHING): 7, (USER, SYSTEM): 5, (USER, ASSISTANT): 5,
    (ASSISTANT, NOTHING): 2, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 5,
}

SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class _Branch:
    """A run of edits below its parent, with the digest of all repaired text up to its end."""

    __slots__ = ("parent", "edits", "digest", "empty", "children", "alive")

    def __init__(self, parent: _Branch | None, edits: bytes, digest, empty: bool):
        self.parent, self.edits, self.digest, self.empty = parent, bytearray(edits), digest, empty
        self.children: list[_Branch] = []
        self.alive = False  # a survivor ends here

    def path(self) -> list[_Branch]:
        nodes, node = [], self
        while node is not None:
            nodes.append(node)
            node = node.parent
        return nodes[::-1]


def _first_difference(a: _Branch, edit_a: bytes, b: _Branch, edit_b: bytes) -> bool:
    """Whether the edits to ``a`` and ``edit_a`` precede those to ``b`` and ``edit_b``: decided just below their common ancestor."""
    up, down = a.path(), b.path()
    i = 0
    while i < len(up) and i < len(down) and up[i] is down[i]:
        i += 1
    first = up[i].edits[:1] if i < len(up) else edit_a
    second = down[i].edits[:1] if i < len(down) else edit_b
    return bytes(first) < bytes(second)


class Repair:
    """The search over one conversation, row by row."""

    def __init__(self):
        self.root = _Branch(None, b"", hashlib.sha256(), True)
        self.root.alive = True
        self.best: dict[str, tuple[int, _Branch]] = {NOTHING: (0, self.root)}
        self._fresh: list[_Branch] = []  # grown for the present row

    def _grow(self, branch: _Branch, edit: bytes, line: str | None) -> _Branch:
        digest, empty = branch.digest, branch.empty
        if line is not None:
            digest = digest.copy()
            digest.update((line if empty else "\n" + line).encode())
            empty = False
        child = _Branch(branch, edit, digest, empty)
        branch.children.append(child)
        return child

    def _settle(self, best: dict[str, tuple[int, _Branch]]) -> None:
        """Keep the new survivors and release what none of them needs; runs without a fork become one."""
        old = [b for _, b in self.best.values()]
        for branch in old:
            branch.alive = False
        for _, branch in best.values():
            branch.alive = True
        self.best = best
        for branch in [*old, *self._fresh]:
            while branch.parent is not None and not branch.alive and not branch.children:
                parent, branch.parent = branch.parent, None
                parent.children.remove(branch)
                branch = parent
        self._fresh = []
        moved: dict[int, _Branch] = {}
        todo = [self.root]
        while todo:
            branch = todo.pop()
            while not branch.alive and len(branch.children) == 1:
                child = branch.children[0]
                branch.edits += child.edits
                branch.digest, branch.empty, branch.alive, branch.children = child.digest, child.empty, child.alive, child.children
                for grandchild in branch.children:
                    grandchild.parent = branch
                moved[id(child)] = branch
            todo += branch.children
        if moved:
            self.best = {s: (cost, moved.get(id(b), b)) for s, (cost, b) in self.best.items()}

    def _inserted(self) -> dict[str, tuple[int, _Branch]]:
        """The survivors, and what insertions make of them."""
        best = dict(self.best)
        todo = list(best)
        while todo:
            state = todo.pop(0)
            cost, branch = best[state]
            to = _NEXT[state]
            known = best.get(to)
            if known and (known[0] < cost + INSERT_COST or (known[0] == cost + INSERT_COST and not _first_difference(branch, INSERT, known[1], b""))):
                continue
            child = self._grow(branch, INSERT, f"{_NAMES[to]}:")
            self._fresh.append(child)
            best[to] = (cost + INSERT_COST, child)
            todo.append(to)
        return best

    def row(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        self._fresh = []
        best = self._inserted()
        more = TRUNCATED_COST if truncated else 0
        choice: dict[str, tuple[int, _Branch, bytes, str | None]] = {}
        for state, (cost, branch) in best.items():
            options = [(state, cost + DELETE_COST, DELETE, None)]
            if not must_go:
                to = _NEXT[state]
                options.append((to, cost + REROLE_COST + more, REROLE, f"{_NAMES[to]}:{text}"))
                initial = role[:1]
                if initial and (initial == to or (state == NOTHING and initial == SYSTEM)):
                    options.append((initial, cost + more, KEEP, f"{role}:{text}"))
            for to, total, edit, line in options:
                known = choice.get(to)
                if known is None or total < known[0] or (total == known[0] and _first_difference(branch, edit, known[1], known[2])):
                    choice[to] = (total, branch, edit, line)
        hopeful = {
            s: c for s, c in choice.items()
            if all(c[0] <= choice[o][0] + _DETOUR[o, s] for o in choice if o != s)
        }
        grown = {}
        for state, (cost, branch, edit, line) in hopeful.items():
            child = self._grow(branch, edit, line)
            self._fresh.append(child)
            grown[state] = (cost, child)
        self._settle(grown)

    def end(self) -> tuple[int, str, str]:
        """Cost, edits and digest of the best repair."""
        self._fresh = []
        best = self._inserted()
        ends = [best[s] for s in (NOTHING, ASSISTANT) if s in best]
        least = ends[0]
        for other in ends[1:]:
            if other[0] < least[0] or (other[0] == least[0] and _first_difference(other[1], b"", least[1], b"")):
                least = other
        edits = b"".join(bytes(b.edits) for b in least[1].path())
        return least[0], edits.decode(), least[1].digest.hexdigest()


class _Conversation:
    """Faults of one conversation, counted row by row in order, and its repair."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.initial: str | None = None
        self.before: tuple | None = None
        self.repair = Repair()

    def row(self, turn: int | None, role: str, text: str, blank: bool, later: bool, cut: bool) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        again = not blank and (later or self.before == (turn, role, text))
        self.before = (turn, role, text)
        truncated = cut and not blank and not again
        self.blank += blank
        self.duplicate += again
        self.truncated += truncated
        self.repair.row(role, text, blank or again, truncated)

    def summary(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit, digest = self.repair.end()
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and whether the row is left: rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it is marked, so that its conversation is known), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats it,
    4 gives it the role user. A null is one space, in the checksum as well; conv_id and turn themselves stay null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("__fate"),
    )
    text = F.when(F.col("__fate") == 1, "").when(F.col("__fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("__fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("__fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("__fate") != 0).alias("left"), F.explode(times).alias("__time"),
    ).drop("__time")


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order, with what can be told of a row by itself or by counting.

    Faults are found before rows are dealt by conversation: blank and cut-off texts by functions, repeated ones by the first
    turn of each (conversation, role, digest) that occurs more than once.
    """
    end = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    key = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = rows.select(
        "conv_id", "turn", "role", F.when(F.col("left"), F.col("text")).alias("text"), "left",
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"), key.alias("key"),
    )
    seen = marked.where(F.col("left") & ~F.col("blank")).groupBy("conv_id", "key").agg(
        F.count("*").alias("__n"), F.min(F.struct("turn")).alias("__first")
    )
    seen = seen.where(F.col("__n") > 1).select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "__first")
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key"))
    later = F.col("__first").isNotNull() & ~F.struct("turn").eqNullSafe(F.col("__first"))
    told = marked.join(seen, same, "left").select("conv_id", "turn", "role", "text", "left", "blank", "cut", later.alias("later"))
    return told.repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"
    )


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, edits and digest of the repaired text of every conversation.

    ``rows`` has conv_id, turn, role, text and left (false: the row only tells that its conversation exists). Rows go by turn,
    nulls first, and within a turn by role and text; a null conv_id is a conversation; a row of an empty role has no initial and cannot be kept. A conversation without rows has zeros, no edits
    and the digest of an empty text. A conversation passes through one task as a stream, since its digest is a chain over all its
    text; the task holds a few bytes for each edit that is not yet certain, and no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        names = [part.split()[0] for part in SUMMARY.split(", ")]
        types = [pa.string() if part.endswith("string") else pa.int64() for part in SUMMARY.split(", ")]

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)

        for batch in slices(batches, "text"):
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "left", "blank", "later", "cut")]
            for conv_id, turn, role, text, left, blank, later, cut in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.summary())
                    now = _Conversation(conv_id)
                if left:
                    now.row(turn, role, text, blank, later, cut)
            if done:
                yield out(done)
        if now is not None:
            yield out([now.summary()])

    return _in_order(rows).mapInArrow(run, SUMMARY)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, place (from 1), edit, role and text of every kept, changed or inserted row.

    The edits of ``repair`` are read back along the rows, each conversation as a stream.
    """
    edits = repair(rows).select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    known = rows.where("left").select("conv_id", "turn", "role", "text", F.lit(1).alias("kind"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("kind"), F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = edits.unionByName(known).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, todo, at, place, state = None, "", 0, 0, NOTHING
        names, types = ["conv_id", "place", "edit", "role", "text"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        for batch in slices(batches, "text"):
            out: list[tuple] = []

            def insert() -> None:
                nonlocal at, place, state
                while at < len(todo) and todo[at] == "I":
                    state, at, place = _NEXT[state], at + 1, place + 1
                    out.append((conv_id, place, "I", _NAMES[state], ""))

            for conv, role, text, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "kind"))):
                if kind == 0:
                    conv_id, todo, at, place, state = conv, text, 0, 0, NOTHING
                    insert()
                    continue
                edit, at = todo[at], at + 1
                if edit != "D":
                    if edit == "R":
                        role = _NAMES[_NEXT[state]]
                    state, place = role[:1], place + 1
                    out.append((conv, place, edit, role, text))
                insert()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return dealt.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def _oracle() -> str:
    """The same search over whole strings: for each state the least (cost, edits, text), row after row."""
    add = lambda s, cost, edit, line: (
        f"CASE WHEN {s} IS NOT NULL THEN {{'c': ({s}).c + {cost}, 'a': ({s}).a || '{edit}', "
        f"'t': ({s}).t || CASE WHEN ({s}).t = '' THEN '' ELSE chr(10) END || {line}}} END"
    )
    gone = lambda s: f"CASE WHEN {s} IS NOT NULL THEN {{'c': ({s}).c + 2, 'a': ({s}).a || 'D', 't': ({s}).t}} END"
    least = lambda *options: f"list_min(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))"
    empty = lambda s, role: add(s, 5, "I", f"'{role}:'")
    kept = lambda s, role: f"CASE WHEN NOT gone AND role[1] = '{role}' THEN {add(s, '5 * cut::INT', 'K', chr(39) * 2 + ' || role || ' + chr(39) + ':' + chr(39) + ' || text')} END"
    named = lambda s, role: f"CASE WHEN NOT gone THEN {add(s, '1 + 5 * cut::INT', 'R', chr(39) + role + ':' + chr(39) + ' || text')} END"
    return f"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), fated AS (
  SELECT raw.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS fate FROM raw, steps
), damaged AS (
  SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fated
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), told AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    i > 1 AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), '')[1] || role[1] NOT IN ('su', 'ua', 'au') AS odd FROM numbered
), rows_told AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM told
), dp AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS s,
    NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS a FROM conversations
  UNION ALL
  SELECT conv_id, i, {gone('n')}, {least(gone('s'), kept('n', 's'))},
    {least(gone('u'), named('n', 'user'), named('s', 'user'), named('a', 'user'), kept('n', 'u'), kept('s', 'u'), kept('a', 'u'))},
    {least(gone('a'), named('u', 'assistant'), kept('u', 'a'))}
  FROM (
    SELECT conv_id, i, role, text, gone, cut, n, s, u, {least('a', empty('u', 'assistant'))} AS a FROM (
      SELECT dp.conv_id, r.i, r.role, r.text, r.gone, r.cut, n, s, a,
        {least('u', empty('n', 'user'), empty('s', 'user'), empty('a', 'user'))} AS u
      FROM dp JOIN rows_told r ON dp.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = dp.i + 1
    )
  )
), ended AS (
  SELECT conv_id, {least('n', 'a', empty('u', 'assistant'))} AS best FROM (
    SELECT conv_id, i, n, a, {least('u', empty('n', 'user'), empty('s', 'user'), empty('a', 'user'))} AS u FROM dp
  ) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated, count(*) FILTER (odd) AS illegal FROM rows_told GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, (best).c::BIGINT AS cost, (best).a AS audit,
  sha256((best).t) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _oracle()
