import hashlib
import random
import re

import pytest

from tidemark.llm import jaccard, licences, mixing, personal, quality, toxicity, urls

BLANK = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(BLANK, text or "")


def components_by_force(rows, percent=80):
    sets = []
    for _, text in rows:
        w = words((text or "").translate(LOWER))
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(find(i), []).append(doc)
    return [
        (doc, len(s), min([d for d in least[find(i)] if d is not None], default=None))
        for i, ((doc, _), s) in enumerate(zip(rows, sets))
    ]


def near_copies(seed, families=6, copies=25):
    r, rows = random.Random(seed), []
    common = [f"line{i}" for i in range(30)]
    for f in range(families):
        base = [f"w{f}x{r.randint(0, 10**6)}" for _ in range(r.choice([6, 12, 40, 90, 160]))]
        for _ in range(copies):
            own = [w if r.random() > r.choice([0, 0.01, 0.03, 0.08]) else f"e{r.randint(0, 10**6)}" for w in base]
            if r.random() < 0.3:
                own += common
            rows.append((len(rows), " ".join(own)))
    return rows + [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "short text"), (len(rows) + 3, "Short Text"), (0, rows[0][1])]


@pytest.mark.parametrize("frequent", [2, 16])
def test_joined_shingles_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 10)
    monkeypatch.setattr(jaccard, "LIST_ROW", 7)
    rows = near_copies(frequent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, jaccard.link_components(docs).collect()))
    assert got == sorted(components_by_force(rows))
    kept = jaccard.keep_first(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, n, c in got if n} | {d for d, n, _ in got if not n})


def test_copies_of_a_text_count_and_sign_once(spark, monkeypatch):
    """op9_shingle_join (F2): repeated texts made all their tokens frequent, and each copy signed with combinations of them."""
    seen = []

    class Spied(jaccard.Sketch):
        def __init__(self, counted, groups):
            super().__init__(counted, groups)
            seen.append(self.most)

    monkeypatch.setattr(jaccard, "Sketch", Spied)
    texts = [" ".join(f"w{k}x{i}" for i in range(12 + k)) for k in range(8)]
    rows = [(100 * k + c, t) for k, t in enumerate(texts) for c in range(20)]
    rows += [(None, texts[0]), (1, texts[1]), (101, texts[1]), (9000, texts[7] + " more"), (9001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in jaccard.link_components(docs).where("doc_id is not null").collect()}
    owner = {k: min(i for i, t in rows if t == texts[k] and i is not None) for k in range(8)}
    want = {(i, owner[texts.index(t)]) for i, t in rows if t in texts and i is not None}
    assert got == want | {(9000, 700), (9001, 9001)}
    assert seen == [2]  # no token lies in FREQUENT sets


def test_a_hot_list_dealt_to_several_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 16)
    monkeypatch.setattr(jaccard, "MOST_GROUPS", 64)
    rows = near_copies(9, families=2, copies=30)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.link_components(docs).collect())) == sorted(components_by_force(rows))


def growing_family(seed, lengths, copies):
    """Variants of one text, cut to each of the lengths (in words)."""
    r = random.Random(seed)
    base = [f"w{i}x{r.randint(0, 10**6)}" for i in range(max(lengths))]
    texts = []
    for n, times in zip(lengths, copies):
        for k in range(times):
            own = base[:n]
            if times > 1:
                own[k % n if k < n else 0] += f"e{k}"
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("lengths, copies", [((74, 88, 100), (1, 8, 40)), ((70, 82, 98, 117, 137), (1, 8, 30, 8, 1))])
def test_lone_shortest_and_longest_member_of_a_family(spark, lengths, copies):
    rows = list(enumerate(t for seed in range(6) for t in growing_family(seed, lengths, copies)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(components_by_force(rows))
    assert len({c for *_, c in want}) < len(rows) / 2
    assert sorted(map(tuple, jaccard.link_components(docs).collect())) == want


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    key = lambda r: (r[0] is None, r)
    got = sorted(map(tuple, jaccard.link_components(odd_docs).collect()), key=key)
    assert got == sorted(components_by_force(rows), key=key)
    assert jaccard.link_components(no_docs).count() == 0
    kept = jaccard.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    lasting = {r.component_id for r in jaccard.link_components(odd_docs).collect() if r.n_shingles}
    texts = [r.text for r in kept.collect()]
    assert len([t for t in texts if t and t.split()]) == len(lasting) and None in texts and "" in texts


def test_slices_of_few_words():
    """Slices of 0 to 6 words in all, for every operator that works on slices."""
    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from tidemark.llm import sentence_pieces, token_files

    coder = sentence_pieces.PieceCoder(public_tokenizers.path("piece_bpe_32k.model"))
    words = "a b c d e f".split()
    for n in range(7):
        for texts in ([" ".join(words[:n])], ["", " ".join(words[:n])], [*words[:n]], [" ".join(words[:n]), "  \n"]):
            column = pa.array(texts, pa.large_string())
            tokens, ends = jaccard.token_sets(column)
            assert np.diff(ends).tolist() == [len(t.split()) and max(len(t.split()) - 4, 1) for t in texts]
            ids, starts = coder.encode_texts(column)
            assert coder.pieces.decode(ids, starts).to_pylist() == texts
            assert len(token_files.encode_texts(column, public_tokenizers.path("word_bpe_49k.json"), 2)[1]) == len(texts) + 1


def test_length_bands():
    bounds = jaccard.band_bounds(80)
    for n in range(1, 3000):
        a, b = ((bounds <= m).sum() for m in (n, n * 5 // 4))
        assert b - a <= 1


def counts_by_force(text):
    text = text or ""
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for x in windows:
        seen[x] = seen.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd_docs, sf):
    docs = odd_docs.select("doc_id", "lang", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"))
    for r in quality.with_counts(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_force(r.text)


def test_binomial_tail():
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 100, 0.2), (40, 1000, 0.05)):
        exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)
    assert quality.binomial_tail(5, 5, 0.1) == 1.0


def test_cutoffs_hold_their_risk(spark, odd_docs, no_docs, no_labels):
    r = random.Random(4)
    plain = lambda: " ".join(f"word{r.randint(0, 10**6)}" for _ in range(80))
    junk = lambda: " ".join(f"w{r.randint(0, 10**6)}***" for _ in range(80))
    rows = [(i, plain() if i % 5 else junk(), "en" if i % 50 else "xx") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(kept[i] for i in kept if i % 5)
    assert not any(kept[i] for i in kept if i % 5 == 0 and i % 50)
    assert all(kept[i] for i in kept if i % 50 == 0)  # too few labels there to prove a cutoff
    assert quality.judge(odd_docs, no_labels).where("kept = base_failed").count() == 0
    assert quality.keep_good(no_docs, no_labels).count() == 0
    good = quality.keep_good(odd_docs, no_labels)
    assert good.columns == odd_docs.columns
    judged = {repr((r.doc_id, r.n_words)): r.kept for r in quality.judge(odd_docs, no_labels).collect()}
    assert sorted(map(repr, good.collect())) == sorted(repr(r) for r in odd_docs.collect() if judged[repr((r.doc_id, len((r.text or "").split())))])


def test_mix(spark, odd_docs, no_docs):
    rows = [(i, "w " * (1 + i % 40), ["a", "b", "c", None, "e"][0 if i % 3 else i % 5]) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.with_copies(docs)
    by_source = taken.groupBy("source").agg({"source_size": "max", "target": "max"}).collect()
    total = sum(r["max(source_size)"] for r in by_source)
    assert sum(r["max(target)"] for r in by_source) == pytest.approx(1.5 * total)
    assert all(r["max(target)"] <= 2 * r["max(source_size)"] for r in by_source)
    got = {r.source: r.t for r in taken.selectExpr("source", "size * copies t").groupBy("source").agg({"t": "sum"}).withColumnRenamed("sum(t)", "t").collect()}
    for r in by_source:
        assert got[r.source] == pytest.approx(r["max(target)"], rel=0.12)
    again = taken.select("doc_id", "copies").collect()
    assert sorted(again) == sorted(mixing.with_copies(docs.repartition(7)).select("doc_id", "copies").collect())
    assert mixing.mix(docs).count() == sum(r.copies for r in again)
    assert mixing.mix(odd_docs).columns == odd_docs.columns and mixing.mix(no_docs).count() == 0
    assert mixing.with_copies(odd_docs).count() == odd_docs.count()


def test_base_spans():
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    r = random.Random(5)
    bits = ["a", "@", ".", "-", "1", "22", "256", "4539578763621486", " ", "+1", "(555)", "b.c", "@x.y", "\n", "é", "0.0.0.0", "+49 30 1234567"]
    for _ in range(4000):
        text = "".join(r.choices(bits, k=r.randint(1, 30)))
        want = [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if personal.valid(k, m[0])]
        assert personal.base_spans(text) == want, text


def test_long_runs_take_no_square_time():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000):
        personal.mentions(text, personal.base_spans(text))


def test_bootstrapped_cards_and_redaction(spark, odd_docs, no_docs):
    rows = [(i, f"my card 4539578763621486 is fine {i}" if i < 40 else "call +1 (555) 555-1234 4539578763621486 now") for i in range(45)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = personal.digests(personal.find(docs)).where("doc_id = 44").first()
    assert found.n_card == 0 and "card:23:39" in found.spans
    assert found.base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert masked[0] == "my card <CARD> is fine 0" and "4539" not in masked[44]
    assert personal.find(odd_docs).count() == odd_docs.count() and personal.redact(no_docs).count() == 0
    masked = personal.redact(odd_docs)
    assert masked.columns == odd_docs.columns
    assert sorted(map(repr, masked.collect())) == sorted(map(repr, odd_docs.collect()))  # nothing to mask
    some = odd_docs.limit(0).unionByName(spark.createDataFrame(
        [(1, None, "en", "s", 0, 1, 2), (2, "write to a.b@c.org or +1 (212) 555-0100 now", None, None, None, 1, 2), (None, "ip 10.0.0.1", "en", "s", 11, 1, 2)] * 2, odd_docs.schema))
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in personal.redact(some).collect() if r.text) == sorted(
        [(2, "write to <EMAIL> or <PHONE> now", 31), (0, "ip <IP>", 7)] * 2)
    assert personal.redact(some).where("text is null and n_chars = 0").count() == 2


def test_learned_contexts_find_other_forms(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abdeiklmnorstu", k=7))
    rows = []
    for i in range(60):
        rows.append(f"{word()} {word()} please call +49 30 {1000000 + 7919 * i} {word()} the {word()}")
        rows.append(f"{word()} the +44 20 {2000000 + 7919 * i} {word()} " + f"the {word()} " * 40)
        rows.append(f"{word()} write to {word()}@{word()}.org {word()}")
        card = next(c for c in map(str, range(4539578700000000 + 1000 * i, 1 << 60)) if personal.luhn(c))
        rows.append(f"{word()} paid by {card} {word()}")
        rows.append(f"{word()} server address 10.1.{i}.7 {word()}")
    odd = {
        f"{word()} call 030 1234 5678 {word()}": "phone:13:26", f"{word()} the 030 1234 5678 9 {word()}": None,
        f"{word()} write to {word()} (at) mail (dot) org {word()}": "email:17:44",
        f"{word()} paid by 55555.55555.554444 {word()}": "card:16:34",
        f"{word()} server address 10-1-2-250 {word()}": "ip:23:33", f"{word()} {word()} 10-1-3-250 {word()}": None,
    }
    docs = spark.createDataFrame(list(enumerate([*odd, *rows])), "doc_id long, text string")
    got = {x.doc_id: x for x in personal.digests(personal.find(docs)).where(f"doc_id < {len(odd)}").collect()}
    for i, (text, want) in enumerate(odd.items()):
        assert got[i].spans == (want or ""), text
        assert got[i].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_phrases_beyond_the_broadcast_count_alike(spark, monkeypatch, odd_docs):
    """Contexts tell as much when there are more of them than are broadcast (op7_personal_data, pipeline)."""
    rows = [(i, f"please dial +1 555 01{i:02d} 23{i:02d} now, it is a note") for i in range(12)]
    rows += [(100 + i, f"please dial 1 555 07{i:02d} 23{i:02d} now, it is a note") for i in range(5)] + [(200, None), (201, " \n "), (202, "3 cats")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((r.doc_id, r.spans) for r in personal.digests(personal.find(docs)).collect())
    assert any(spans for i, spans in want if i >= 100)
    monkeypatch.setattr(personal, "MOST_PHRASES", 0)
    assert sorted((r.doc_id, r.spans) for r in personal.digests(personal.find(docs)).collect()) == want
    for table in (docs, odd_docs):
        phrases = ["please", "dial", "please dial", "it is", "cats", "9 cats", "the quick", "long long", "long", "absent word", "café"]
        few = personal.phrase_places(table, phrases)
        many = personal.many_phrase_places(table, spark.createDataFrame([(p,) for p in phrases], "phrase string"))
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_wide_mentions_take_no_square_time():
    for bit in ("a", "1", "a at ", "1-", "1 ", "(at)", "a dot ", "1.(", "a.", "1/2 "):
        text = bit * (300_000 // len(bit))
        assert len(personal.mentions(text, personal.base_spans(text))) < len(text)


def test_toxicity_on_held_out_rows(spark, odd_docs, no_docs, no_labels):
    r = random.Random(6)
    stem = ["lowei", "grump", "zorch"]
    rows, labels = [], []
    for i in range(900):
        own = ["".join(r.choices("aeioubdfgklmnprst", k=r.randint(2, 8))) for _ in range(40)]
        bad = i % 6 == 0
        if bad:
            own[r.randint(0, 39)] = r.choice(stem) + "".join(r.choices("aeiou", k=2))
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = toxicity.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(x.predicted, int(x.doc_id % 6 == 0)) for x in judged if x.held_out]
    assert len(held) > 200 and sum(p == y for p, y in held) / len(held) > 0.97
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    whole, bounded = toxicity.fit(docs, table), toxicity.fit(docs, table, most_training=60, few_labels=0)
    assert (whole.grams == bounded.grams).all()  # n-grams are chosen from all labelled rows, whatever the fit's bound and the join
    alone = toxicity.judge(odd_docs, no_labels).collect()
    assert len(alone) == odd_docs.count() and {x.predicted for x in alone} == {0} and {x.score for x in alone} == {0.5}
    assert toxicity.judge(no_docs, no_labels).count() == 0


def test_url_rules(spark):
    cases = {
        "https://a.net/x": ("net/", "block"), "https://a.net": (None, "allow"), "http://EXAMPLE.net/en/1?q#f": ("example.net/en/", "allow"),
        "http://sub.example.com/de/": ("example.com/de/", "block"), "http://x.org/fr/y": ("org/fr/", "allow"), "http://x.org/fr": (None, "allow"),
        "http://badexample.com/de/": (None, "allow"), "no scheme": (None, "allow"), "": (None, "allow"), None: (None, "allow"),
        "http://m.free-bets.example.org/a": (None, "block"), "x://h?y/z": (None, "allow"), "http://" + "a." * 3000 + "net/" + "p" * 5000: ("net/", "block"),
    }
    rows = [(i, u, 1) for i, u in enumerate([*cases, *cases])]
    pages = spark.createDataFrame(rows, "page_id long, url string, Host int")
    got = urls.judge(pages, urls.listing(spark, urls.RULES, urls.LISTED)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.rule, r.verdict) == cases[r.url], r.url
    assert {r.verdict for r in urls.judge(pages, urls.listing(spark, [])).collect()} == {"allow"}
    assert urls.judge(pages.where("false"), urls.listing(spark, urls.RULES)).count() == 0


def test_bloom_filter_loses_nothing(spark):
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.concat(F.lit("h"), "id").alias("key"))
    bloom = urls.BloomFilter(keys, 3000)
    assert keys.where(bloom.probe(spark, F.col("key"))).count() == 3000
    other = spark.range(20000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert other.where(bloom.probe(spark, F.col("key"))).count() < 600


def test_licences(spark, odd_docs, no_docs):
    text = licences.KNOWN["MIT"]
    rows = [(1, text), (2, text.upper().replace("\n\n", "\n\nCopyright (c) 2020 Someone\n\n", 1)), (3, text + " more"), (4, "x\nReleased under the MIT Licence\ny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in licences.scan(docs, licences.known_digests(spark)).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "MIT notice")}
    assert licences.scan(odd_docs, licences.known_digests(spark)).count() == odd_docs.count()
    assert licences.scan(no_docs, licences.known_digests(spark)).count() == 0


def test_a_notice_without_the_keyword(spark):
    assert all(licences.KEYWORD in text.lower() for text in licences.KNOWN.values())
    known = licences.known_digests(spark, {"PD": "This work is dedicated to the public domain."})
    docs = spark.createDataFrame([(1, "a\nThis work is dedicated to the Public Domain\n\nb"), (2, "")], "doc_id long, text string")
    assert {r.doc_id: r.notices for r in licences.scan(docs, known).collect()} == {1: "PD", 2: ""}
