"""Fingerprints, conversation repair and manifest against brute force."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from tidemark.llm import conversations, fingerprints, manifest

BLANK = "\t\n\x0b\x0c\r "


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def sketch(text):
    return sorted({hashlib.md5(g.encode()).hexdigest()[:16] for g in grams(text)})[:128]


def likeness(a, b):
    if a == b:
        return 1.0
    low = sorted({*a, *b})[:128]
    return len({*low} & {*a} & {*b}) / len(low)


def test_fingerprints(spark, odd_docs, no_docs):
    want = []
    docs = [(r.doc_id, r.text or "") for r in odd_docs.collect()]
    key = lambda d: (d[0] is not None, d[0] or 0, hashlib.md5(d[1].encode()).hexdigest())
    docs.sort(key=key, reverse=True)
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(sketch, (text, edited, after))
        want.append((doc_id, len(text), edited, ",".join(a), ",".join(b), likeness(a, b), likeness(a, c), len(a)))
    got = [tuple(r) for r in fingerprints.compare_edits(odd_docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert fingerprints.compare_edits(no_docs).count() == 0


def test_hot_ids_are_dealt_in_order(spark):
    rows = [(7 if i % 3 else i, f"text {i} of many words in a row {i % 50}") for i in range(600)] + [(None, f"none {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    placed = docs.selectExpr("doc_id", "text", "md5(text) AS tie")
    placed = placed.withColumn("bucket", fingerprints._buckets(placed)).collect()
    assert len({r.bucket for r in placed if r.doc_id == 7}) > 4
    order = sorted(placed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie))
    assert [r.bucket for r in order] == sorted(r.bucket for r in placed)
    after = {r.text: r.next_text for r in fingerprints.with_next(docs).collect()}
    down = [r.text for r in reversed(order)]
    assert after == dict(zip(down, down[1:] + down[:1]))


def test_merged_fingerprints_and_estimates(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = [(i % 3 if i else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "part int, text string")
    df = df.withColumn("fingerprint", fingerprints.fingerprint(df["text"]))
    got = {r.part: r.fingerprint for r in fingerprints.merge_parts(df, "part").collect()}
    for part in (None, 0, 1, 2):
        whole = set().union(*(grams(t) for p, t in rows if p == part))
        assert got[part] == ",".join(sorted({hashlib.md5(g.encode()).hexdigest()[:16] for g in whole})[:128])
    half = " ".join(texts[0].split()[:150])
    pair = spark.createDataFrame([(texts[0], half)], "a string, b string").select(
        fingerprints.fingerprint(F.col("a")).alias("a"), fingerprints.fingerprint(F.col("b")).alias("b")
    )
    row = pair.select(
        fingerprints.containment(pair["b"], pair["a"]).alias("within"), fingerprints.containment(pair["a"], pair["b"]).alias("half"),
        fingerprints.distinct_shingles(pair["a"]).alias("n"), fingerprints.merged(pair["a"], pair["b"]).alias("both"), "a",
    ).first()
    assert row.within > 0.8 and abs(row.half - 0.5) < 0.15 and abs(row.n - 296) < 80 and row.both == row.a


def all_repairs(rows):
    """Least (cost, edits, lines) of a small conversation by trying all edits; rows: role, text, must_go, truncated."""
    names = {"u": "user", "a": "assistant"}
    best = None

    def go(i, state, cost, edits, lines, inserted):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch("s?(ua)*u?", state):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", state):
            best = min(filter(None, (best, (cost, edits, lines))))
        if inserted < 3:
            for r in "ua":
                go(i, state + r, cost + 5, edits + "I", [*lines, f"{names[r]}:"], inserted + 1)
        if i < len(rows):
            role, text, must_go, cut = rows[i]
            go(i + 1, state, cost + 2, edits + "D", lines, 0)
            if not must_go:
                if role:  # a row without a role has no initial to keep
                    go(i + 1, state + role[:1], cost + 5 * cut, edits + "K", [*lines, f"{role}:{text}"], 0)
                for r in "ua":
                    go(i + 1, state + r, cost + 1 + 5 * cut, edits + "R", [*lines, f"{names[r]}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best


def check_repair(rows):
    found = conversations.Repair()
    for i, row in enumerate(rows):
        found.row(*row)
    cost, edits, lines = all_repairs(rows)
    assert found.end() == (cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()), rows


def test_search_equals_trying_all_edits():
    for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=3):
        check_repair([(r, f"t{i}.", False, False) for i, r in enumerate(roles)])
    rng = random.Random(3)
    for _ in range(150):
        n = rng.randrange(6)
        check_repair([(rng.choice(["system", "user", "assistant", "user", "assistant", "", " "]), f"t{i}", rng.random() < 0.15, rng.random() < 0.2) for i in range(n)])


def test_long_tie_keeps_no_text():
    """All rows need a new role, so two survivors never share an ancestor: the least edits are found, and memory stays at the edits."""
    for n in (2000, 2001):
        found = conversations.Repair()
        for i in range(n):
            found.row("tool", "x" * 100, False, False)
            assert sum(1 for _ in _branches(found.root)) <= 8
        cost, edits, _ = found.end()
        assert (cost, edits) == ((n, "R" * n) if n % 2 == 0 else (n + 1, "D" + "R" * (n - 1)))


def _branches(branch):
    yield branch
    for child in branch.children:
        yield from _branches(child)


ODD_TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Hi"), (1, 2, "assistant", "Hi"), (1, 9, "user", "Hello?"),
    (2, None, "user", "No turn."), (2, None, "user", "No turn."), (2, 4, None, None), (2, 5, "assistant", "So.\n\n "),
    (None, 1, "user", "Lost."), (None, 2, "assistant", "Found!"), (None, None, None, ""), (3, None, "assistant", ""),
] + [(10 + i // 7, i % 7, ["user", "assistant"][i % 2], ["One.", "Two", "", "One.", " \t"][i % 5]) for i in range(200)] + [(50, 3, "user", "y " * 50_000)]


def brute_repair(table):
    """The contract, row by row in plain Python."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = (" " if role is None else role), (" " if text is None else text)
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            role = "user" if fate == 4 else role
            rows += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, todo, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in rows:
            fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.strip(BLANK)[-1] not in ".!?" else None
            if fault:
                counts[fault] += 1
            seen.add((role, text))
            todo.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = {r[0] for r in rows if r[0] is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, edits, lines = all_repairs(todo)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines
    return out


def test_conversations(spark):
    table = spark.createDataFrame(ODD_TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    rows = conversations.damaged(table.withColumn("left", table["turn"]).withColumn("edits", table["turn"]))
    want = brute_repair(ODD_TURNS)
    got = [tuple(r) for r in conversations.repair(rows).collect()]
    assert sorted(map(repr, got)) == sorted(repr(w) for w, _ in want.values())
    lines = {}
    for r in sorted(conversations.repaired_rows(rows).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {k: v for k, (_, v) in want.items() if v}
    none = conversations.damaged(table.where("false"))
    assert conversations.repair(none).count() == conversations.repaired_rows(none).count() == 0


def h(*digests):
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def plain_tree(nodes):
    """Root, and the siblings of each node with their sides, level by level."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            mate = p ^ 1
            steps[i].append(("-", "") if mate >= len(nodes) else ("R" if mate > p else "L", nodes[mate]))
            at[i] = p // 2
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], steps


def plain_manifest(docs):
    def leaf(row, more=0):
        values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    langs = {}
    for row in docs:
        langs.setdefault(row.lang, []).append((row.doc_id is not None, row.doc_id or 0, leaf(row), row))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: r[:3])
        trees[lang] = plain_tree([r[2] for r in langs[lang]])
    root, tops = plain_tree([trees[lang][0] for lang in order])
    for lang, top in zip(order, tops):
        for (_, _, own, row), steps in zip(langs[lang], trees[lang][1]):
            hit = row.doc_id is not None and row.n_chars is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0
            now, path = leaf(row, int(hit)), steps + top
            for side, mate in path:
                now = h(mate, now) if side == "L" else h(now, mate) if side == "R" else h(now)
            yield row.doc_id, own, trees[lang][0], root, h(*(m for _, m in path)), now, now == root


def test_manifest(spark, odd_docs, no_docs):
    many = odd_docs.unionByName(spark.range(100).selectExpr(
        "id * 3 AS doc_id", "concat('é', id) AS text", "if(id < 60, 'en', if(id < 61, 'zz', null)) AS lang", "'s' AS source",
        "if(id % 9 = 0, null, id) AS n_chars", "1 AS size", "2 AS Score"))
    for docs, heights in ((odd_docs, [12]), (many.withColumn("leaf", many["size"]).withColumn("PLACE", many["size"]).repartition(4), [2, 3])):
        want = sorted(repr(r) for r in plain_manifest(docs.collect()))
        for height in heights:
            assert sorted(repr(tuple(r)) for r in manifest.verified(docs, height).collect()) == want
    assert manifest.verified(no_docs).count() == 0


def test_appended_leaves_extend_older_witnesses():
    for n in range(1, 40):
        tree = manifest.OpenSubtrees()
        leaves = [h(str(i)) for i in range(n)]
        for leaf in leaves:
            tree.append(leaf)
        root, steps = plain_tree(leaves)
        assert tree.close((n - 1).bit_length()) == root
        assert [["".join(x) for x in s] for s in steps] == tree.witnesses
