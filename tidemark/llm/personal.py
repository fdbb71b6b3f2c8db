"""Personal data: base patterns, and bootstrapped patterns that find what the base ones miss.

What the base patterns match are the seed entities. Seeds and other number- or mail-like mentions are instances; they
hang on patterns: the shape of the mention, and the words around it. Spark scores this graph in
rounds: a pattern is as sure as the mean of its instances (with one doubtful instance added), an instance that is no seed is as sure as its patterns together. Mentions
of instances that end up sure enough, pass the check of their kind and touch no base match are added.

Wide mentions (a number without +, a card in other groups, a mail or address written otherwise) stand for no
shape: only learned contexts, one or two words on the left or on the right, can make them sure. A context counts if seeds fill
enough of all places of its words, counted over all texts, so that a common word tells nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .joins import attach
from .scratch import written
from .words import slices, split_words, text_array, word_keys

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring, how sure an instance must be, and the seeds a pattern of words must have seen.
ROUNDS, SURE, LEAST_SEEDS = 3, 0.9, 3
#: Share of all places of a context's words that seeds must fill; phrases up to which they are sent to all tasks to be counted.
LEAST_SHARE, MOST_PHRASES = 0.05, 1 << 18
#: Places of the sketch that tells which phrases of a text are worth counting when there are more.
SKETCH_BITS = 22
#: Characters on either side in which the words of a context lie.
WINDOW = 80

# The base patterns, in a form that never looks twice at a long run of characters.
_DOMAIN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_LOCAL = r"[A-Za-z0-9._%+-]"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Mentions that may be identifiers, whatever stands next to them.
_LOOSE_CARD = r"(?<![0-9A-Za-z.@_+-])(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z@_-]|\.[0-9])"
_LOOSE_PHONE = r"(?<![0-9A-Za-z@_+])\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9A-Za-z@_-]|\.[0-9])"
# Wide mentions: whether they are identifiers is left to their context. No long run is looked at twice.
_OPEN, _CLOSE = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_WIDE_EMAIL = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:{_OPEN}(?:at|@){_CLOSE}|\x20at\x20(?=[A-Za-z0-9-]++(?:\x20dot\x20|{_OPEN}(?:dot|\.){_CLOSE})))"
    rf"[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20|{_OPEN}(?:dot|\.){_CLOSE})[A-Za-z0-9-]++)++"
)
_WIDE_IP = rf"(?<![0-9])[0-9]{{1,3}}+(?:(?:\x20?[-_,:/]\x20?|\x20\.\x20?|\.\x20|\x20dot\x20|{_OPEN}(?:dot|\.){_CLOSE})[0-9]{{1,3}}+){{3}}(?![0-9])"
_WIDE_CARD = r"(?<![0-9A-Za-z])(?<![0-9][\x20./_-])[0-9](?:[\x20./_-]{0,3}[0-9]){15,18}+(?![\x20./_-]?[0-9]|[A-Za-z])"
_WIDE_PHONE = r"(?<![0-9A-Za-z@_+.-])(?<![0-9][\x20()./-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){7,14}+(?![\x20()./-]{0,2}[0-9]|[A-Za-z@_])"
_WIDE = [(k, re.compile(p, re.I)) for k, p in enumerate((_WIDE_EMAIL, _WIDE_IP, _WIDE_CARD, _WIDE_PHONE))]
#: A text without this holds no mention.
_SOME = r"(?i)[0-9@]|\x20at\x20|[\[({<]\x20?at\x20?[\])}>]"

Span = tuple[int, int, int]


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def valid(kind: int, text: str) -> bool:
    """The check of a kind on a match."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    if kind == 2:
        return 16 <= len(d := _digits(text)) <= 19 and luhn(d)
    if kind == 3:
        return 8 <= len(_digits(text)) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether the domain is whole, around each @ that no earlier match holds."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and re.match(_LOCAL, text[start - 1]):
            start -= 1
        if start < at and (m := re.compile(_DOMAIN).match(text, at + 1)):
            yield start, m.end(), True
            done = m.end()
        elif start < at and (m := re.compile(r"[A-Za-z0-9-]+").match(text, at + 1)):
            yield start, m.end(), False
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the base patterns, in order of kind and start."""
    spans = [(0, a, b) for a, b, whole in _emails(text) if whole] if "@" in text else []
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        spans += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if valid(kind, m[0])]
    return spans


def _shape(kind: int, text: str) -> str:
    text = re.sub("[A-Za-z]+", "a", text)
    return re.sub("[0-9]", "9", text) if kind > 1 else re.sub("[a0-9]+", "x", text)


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    """The words before and after, digits as 9."""
    plain = lambda w: re.sub("[0-9]", "9", w).lower()
    left, right = text[max(0, start - 40) : start].split(), text[end : end + 40].split()
    return plain(left[-1]) if left else "", plain(right[0]) if right else ""


def _plain(word: str) -> str:
    """Lower case, digits as 9, without marks at either end."""
    return re.sub(r"^[\W_]+|[\W_]+$", "", re.sub("[0-9]", "9", word).lower())


def _contexts(text: str, start: int, end: int) -> list[str]:
    """Side and phrase (one and two words) on the left and on the right. Words that the window cuts do not count."""
    lo, hi = max(0, start - WINDOW), end + WINDOW
    left, right = text[lo:start], text[end:hi]
    left = left.partition(" ")[2] if lo and not text[lo - 1].isspace() else left
    right = right.rpartition(" ")[0] if hi < len(text) and not text[hi].isspace() else right
    left, right = [w for w in map(_plain, left.split()) if w][-2:], [w for w in map(_plain, right.split()) if w][:2]
    return [f"{side}\x02{phrase}" for side, words, one in (("l", left, left[-1:]), ("r", right, right[:1])) for phrase in
            dict.fromkeys(" ".join(w) for w in (one, words) if w)]


def _wide(text: str, taken: list[Span]) -> Iterator[Span]:
    """Wide mentions that pass their check and touch none of ``taken``."""
    taken = sorted((a, b) for _, a, b in taken)
    for kind, pattern in _WIDE:
        at = 0
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][1] <= m.start():
                at += 1
            plain = ".".join(re.findall("[0-9]+", m[0])) if kind == 1 else m[0]
            if not (at < len(taken) and taken[at][0] < m.end()) and valid(kind, plain):
                yield kind, m.start(), m.end()


def mentions(text: str, base: list[Span]) -> list[tuple[int, int, int, str, str, str, str, bool, bool, list[str]]]:
    """kind, start, end, value, shape, left word, right word, whether it is a seed, whether it is wide, and its contexts."""
    loose = [(0, a, b) for a, b, whole in _emails(text) if not whole] if "@" in text else []
    for kind, pattern in ((2, _LOOSE_CARD), (3, _LOOSE_PHONE)):
        loose += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text)]
    free, taken, at = [], sorted((a, b) for _, a, b in base), 0
    for kind, a, b in sorted(loose, key=lambda s: s[1:]):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if not (at < len(taken) and taken[at][0] < b) and valid(kind, text[a:b]):
            free.append((kind, a, b))
    return [
        (kind, a, b, text[a:b].lower(), _shape(kind, text[a:b]), *_around(text, a, b), seed, wide, _contexts(text, a, b))
        for spans, seed, wide in ((base, True, False), (free, False, False), (_wide(text, base + free), False, True)) for kind, a, b in spans
    ]


_MENTION = T.ArrayType(T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("value", T.StringType()), T.StructField("shape", T.StringType()), T.StructField("left", T.StringType()),
    T.StructField("right", T.StringType()), T.StructField("seed", T.BooleanType()),
    T.StructField("wide", T.BooleanType()), T.StructField("contexts", T.ArrayType(T.StringType())),
]))


def with_mentions(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text) and the mentions of every whole text, a null one as empty. No shuffle."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")
    )
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType()), T.StructField("mentions", _MENTION)])
    names = [f.name for f in _MENTION.elementType.fields]
    arrow = pa.list_(pa.struct(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.bool_(), pa.list_(pa.string())]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = text_array(batch.column("text"))
            some = pc.match_substring_regex(texts, _SOME).to_pylist()
            found = []
            for i, may in enumerate(some):
                text = texts[i].as_py() if may else ""
                found.append([dict(zip(names, m)) for m in mentions(text, base_spans(text))] if may else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, arrow)], names=["doc_id", "text_key", "mentions"])

    return keyed.mapInArrow(run, schema)


def _plain_words(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Plain forms, the form of each word that is not blank in it, and the row of each."""
    code, ends, distinct = split_words(text_array(batch.column("text")))
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.replace_substring_regex(distinct, "[0-9]", "9")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    some = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)[code]
    return plain, code[some], np.repeat(np.arange(batch.num_rows), np.diff(ends))[some]


def phrase_places(docs: DataFrame, phrases: list[str]) -> DataFrame:
    """phrase and places: how often each of the phrases (one or two words) stands in all texts."""
    words = sorted({w for p in phrases for w in p.split(" ")})
    number = {w: i for i, w in enumerate(words)}
    # A phrase's code: its word, or both words as a number in base n + 1 above all single ones.
    n = len(words)
    coded = sorted((number[a] if not b else (number[a] + 1) * (n + 1) + number[b], p) for p in phrases for a, _, b in [p.partition(" ")])
    shared = docs.sparkSession.sparkContext.broadcast((pa.array(words, pa.large_string()), np.array([c for c, _ in coded], np.int64)))
    names = [p for _, p in coded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value
        total = np.zeros(len(codes), np.int64)
        for batch in slices(batches, "text", 2 << 20):
            plain, code, owner = _plain_words(batch)
            at = pc.fill_null(pc.index_in(plain, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            pair = (at[:-1] + 1) * (n + 1) + at[1:]
            seen = np.concatenate([at[at >= 0], pair[(at[:-1] >= 0) & (at[1:] >= 0) & (owner[:-1] == owner[1:])]])
            place = np.minimum(np.searchsorted(codes, seen), len(codes) - 1)
            total += np.bincount(place[codes[place] == seen], minlength=len(codes))
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["code", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("places"))
    named = docs.sparkSession.createDataFrame(list(enumerate(names)), "code long, phrase string")
    return named.join(counted, "code", "left").select("phrase", F.coalesce("places", F.lit(0)).alias("places"))


def _sketch_place(first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """Place in the sketch of a phrase of words with these keys."""
    key = first if second is None else (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(1))
    return ((key * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)


def many_phrase_places(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """As ``phrase_places``, for a table of any number of phrases: those of the texts that a sketch of the table may hold are counted by a
    shuffle. The sketch has a fixed size and only spares phrases that are not asked for."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p.partition(" ")[::2] for p in batch.column("phrase").to_pylist()]
            first, second = (word_keys(pa.array([p[i] for p in pairs], pa.large_string())) for i in (0, 1))
            double = np.array([bool(b) for _, b in pairs], bool)
            place = np.where(double, _sketch_place(first, second), _sketch_place(first, None))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(place))], names=["place"])

    marked = np.zeros(1 << SKETCH_BITS, bool)
    marked[phrases.select("phrase").mapInArrow(mark, "place int").distinct().toArrow().column("place").to_numpy()] = True
    shared = docs.sparkSession.sparkContext.broadcast(marked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            plain, code, owner = _plain_words(batch)
            keys, n = word_keys(plain), len(plain)
            single, times = np.unique(code[shared.value[_sketch_place(keys, None)][code]], return_counts=True)
            a, b = code[:-1], code[1:]
            kept = (owner[:-1] == owner[1:]) & shared.value[_sketch_place(keys[a], keys[b])]
            double, twice = np.unique(a[kept] * n + b[kept], return_counts=True)
            both = pc.binary_join_element_wise(plain.take(pa.array(double // max(n, 1))), plain.take(pa.array(double % max(n, 1))), pa.scalar(" ", pa.large_string()))
            found = pa.concat_arrays([plain.take(pa.array(single)), both]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([found, pa.array(np.concatenate([times, twice]).astype(np.int64))], names=["phrase", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "phrase string, n long").groupBy("phrase").agg(F.sum("n").alias("places"))
    return phrases.select("phrase").join(counted, "phrase", "left").select("phrase", F.coalesce("places", F.lit(0)).alias("places"))


def _telling(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """The context patterns whose words mostly mean the kind: seeds fill at least ``LEAST_SHARE`` of the phrase's places."""
    contexts = written(
        edges.where("phrase is not null").groupBy("pattern", "phrase").agg(
            F.sum(F.col("here").cast("long")).alias("seeds"), F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("filled")
        ).where(F.col("seeds") >= LEAST_SEEDS), "contexts",
    )
    phrases = written(contexts.select("phrase").distinct(), "phrases")
    n = phrases.count()
    if not n:
        return contexts.select("pattern").where("false")
    if n <= MOST_PHRASES:
        places = phrase_places(docs, [r["phrase"] for r in phrases.collect()])
    else:
        places = many_phrase_places(docs, phrases)
    places = written(places, "places")
    return contexts.join(places, "phrase").where(F.col("filled") >= LEAST_SHARE * F.col("places")).select("pattern")


def sure_instances(found: DataFrame, docs: DataFrame) -> DataFrame:
    """kind_value of the instances that are sure in the end: seeds (which may also stand where no base pattern sees them) and others."""
    m = found.select(F.explode("mentions").alias("m")).select("m.*")
    instance = F.concat_ws(":", "kind", "value")
    pattern = lambda side, phrase, *parts: F.struct(side.alias("side"), phrase.alias("phrase"), F.concat_ws("\x01", "kind", *parts).alias("pattern"))
    none = F.lit(None).cast("string")
    strict = F.array(
        pattern(F.lit("shape"), none, "shape"), pattern(F.lit("both"), none, "left", "right", F.lit("words")),
    )
    around = F.transform("contexts", lambda c: pattern(F.substring(c, 1, 1), F.substring_index(c, "\x02", -1), c, F.lit("context")))
    edges = m.select(
        instance.alias("instance"), "seed", F.explode(F.when(F.col("wide"), around).otherwise(F.concat(strict, around))).alias("p")
    ).select("instance", "seed", "p.*")
    # A value found as a seed once is one wherever it stands.
    edges = edges.groupBy("instance", "pattern", "side", "phrase").agg(F.max("seed").alias("here"), F.count("*").alias("n"))
    edges = written(edges, "graph")
    telling = written(_telling(edges, docs), "telling").withColumn("tells", F.lit(True))
    edges = attach(edges, telling, "pattern").where("phrase is null or tells").drop("tells")
    edges = written(edges, "graph-telling")
    seeds = edges.groupBy("instance").agg(F.max("here").alias("seed"))
    edges = written(edges.join(seeds, "instance").select("instance", "pattern", "side", "seed"), "graph-seeds")
    scores = seeds.select("instance", F.col("seed").cast("double").alias("sure"))
    for _ in range(ROUNDS):
        known = written(edges.join(written(scores, "instances"), "instance"), "graph-scores")
        patterns = known.groupBy("pattern").agg(
            (F.sum("sure") / (F.count("*") + 1)).alias("trust"), F.sum(F.col("seed").cast("long")).alias("seeds")
        ).where(F.col("seeds") >= LEAST_SEEDS).select("pattern", "trust")
        trusted = attach(edges.where("not seed"), written(patterns, "patterns"), "pattern").where("trust is not null")
        # One and two words of a side tell the same thing: the better of them counts.
        side = F.when(F.col("side").isin("l", "r"), F.col("side")).otherwise(F.col("pattern"))
        trusted = trusted.groupBy("instance", side.alias("side")).agg(F.max("trust").alias("trust"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-6)))))
        open_scores = trusted.groupBy("instance").agg((1 - doubt).alias("sure"))
        scores = seeds.where("seed").select("instance", F.lit(1.0).alias("sure")).union(
            seeds.where("not seed").select("instance").join(open_scores, "instance", "left").select("instance", F.coalesce("sure", F.lit(0.0)))
        )
    return written(scores.where(F.col("sure") >= SURE).select(F.col("instance").alias("kind_value")), "sure")


def _joined(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ","
    )


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and spans (arrays of kind, start, end) of every document.

    Null texts count as empty and have none. Rows of one doc_id and text give equal rows each. Positions are code points, ends
    exclusive; both arrays go by kind, then start. An added span never touches a base one.
    """
    found = written(with_mentions(docs), "mentions")
    added = found.select("doc_id", "text_key", F.explode(F.filter("mentions", lambda m: ~m["seed"])).alias("m"))
    added = added.withColumn("kind_value", F.concat_ws(":", "m.kind", "m.value")).join(sure_instances(found, docs), "kind_value")
    added = added.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("m.kind", "m.start", "m.end")).alias("added"))
    added = written(added, "added").toDF("__doc", "__key", "added")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key"))
    base = F.transform(F.filter("mentions", lambda m: m["seed"]), lambda m: F.struct(m["kind"], m["start"], m["end"]))
    joined = found.select("doc_id", "text_key", base.alias("base")).join(added, same, "left")
    both = F.array_sort(F.concat("base", F.coalesce("added", F.expr("array()").cast(joined.schema["base"].dataType))))
    return joined.select("doc_id", "text_key", "base", both.alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The registered form: counts and digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with ``<EMAIL>`` and the like in place of all spans, and n_chars (if there) counted anew; documents without spans stay untouched.

    Where spans overlap, the one that starts first (the longer of two) is replaced and the rest of the others too. Only documents
    with spans pass through Python; a null text has none and stays null.
    """
    marks = [f"<{k.upper()}>" for k in KINDS]
    spans = written(find(docs).where(F.size("spans") > 0).select("doc_id", "text_key", "spans").distinct(), "to-redact")
    spans = spans.toDF("__doc", "__key", "__spans")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__key"))

    @F.udf("string", useArrow=True)
    def replaced(text: str, spans: list) -> str:
        out, done = [], 0
        for kind, start, end in sorted(((s["kind"], s["start"], s["end"]) for s in spans), key=lambda s: (s[1], -s[2])):
            if start >= done:
                out += [text[done:start], marks[kind]]
            done = max(done, end)
        return "".join([*out, text[done:]])

    spans = F.broadcast(spans) if spans.count() <= 10_000 else spans
    hit = docs.join(spans, same).withColumn("__text", replaced("text", "__spans"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(F.length("__text").cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`{c.replace('`', '``')}`"))
    return docs.join(spans, same, "left_anti").unionByName(hit.select(*columns))
