import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm import sentence_pieces, token_files  # noqa: E402
from tidemark.llm.words import CodedWords, forget_worker_state, slices, worker_state  # noqa: E402

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [
    " ", "  ", "\n", "▁", "a", "the", "er", "th", "in", "é", "漢", "\t", "😀", "\u0301", "<s>", "<0x0A>", "0", "=", "'s", "'S",
    "<|endoftext|>", "</w>", "\x1c", "\x85", "\u00a0", "Σ", "İ", "ﬁ", "\x00", "ing", "\r\n",
]


def texts(n, longest, seed):
    r = random.Random(seed)
    return ["", " ", "   ", "▁ ▁", "a" * 700, " " * 200, "there" * 100] + [
        "".join(r.choices(ALPHABET, k=r.randint(1, longest))) for _ in range(n)
    ]


def test_pieces_equal_the_library():
    import sentencepiece

    docs = texts(2000, 60, 1)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coder = sentence_pieces.PieceCoder(PIECES)
    ids, starts = coder.encode_texts(pa.array(docs, pa.large_string()))
    decoded = coder.pieces.decode(ids, starts).to_pylist()
    for doc, want, a, b, back in zip(docs, library.encode(docs, num_threads=1), starts[:-1], starts[1:], decoded):
        assert ids[a:b].tolist() == want, doc
        assert back == library.decode(want), doc


def test_long_words_equal_the_library_in_linear_time():
    import sentencepiece

    library, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    docs = ["".join(r.choice(x) for _ in range(n)) for x in ("ab=-0 1", "the", "etaoinshr") for n in (1, 17, 40, 300) for _ in range(40)]
    docs += [(x * 1_000_000)[:1_000_000] for x in ("a", "ab", "=", "-=", "the")]
    docs += ["".join(r.choices(letters, k=1_000_000)), "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(200_000))]
    coder = sentence_pieces.PieceCoder(PIECES)
    start = time.process_time()
    ids, starts = coder.encode_texts(pa.array(docs, pa.large_string()))
    assert time.process_time() - start < 60  # minutes or hours if it grew with the square of a word
    for doc, a, b in zip(docs, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == library.encode(doc), doc[:40]


def test_memory_is_bounded_in_bytes():
    encode = lambda words: (np.zeros(len(words), np.int32), np.ones(len(words), np.int64))
    memory = CodedWords(encode, room=1 << 18)
    for i in range(60):
        memory.lookup(pa.array([f"{'x' * 200}{i}-{j}" for j in range(100)] + ["y" * 100_000 + str(i)], pa.large_string()))
        assert sum(run.nbytes for run in memory.runs) <= 1 << 18


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    docs = texts(2000, 50, 2)
    library = Tokenizer.from_file(WORDS)
    ids, starts = token_files.encode_texts(pa.array(docs, pa.large_string()), WORDS, None)
    for doc, want, a, b in zip(docs, library.encode_batch(docs, add_special_tokens=False), starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == want.ids, doc


def test_plain_words_are_cut_like_the_library(tmp_path):
    """op10_token_files: the tokenizer's call for whole words took most of the time; other rules than the known ones keep it."""
    import json
    from pathlib import Path

    from tokenizers import Tokenizer

    r = random.Random(9)
    plain = [chr(x) for x in [*range(0x21, 0x7F), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]]
    plain += ["'s", "'S", "'ll", "''re", "<|", "|>", "endoftext", "<|endoftext|>", "<|ENDOFTEXT|>"] * 3
    odd = [*plain, "\u0301", "\u030c", "İ", "\x7f", "\x00", "漢", "\u00a0", "×", "÷", "ª", "²"]
    words = ["".join(r.choices(letters, k=r.randint(1, 9))) for letters in (plain, odd) for _ in range(5000)]
    told = json.loads(Path(WORDS).read_text())
    told["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(told))
    for model in (WORDS, str(tmp_path / "cased.json")):
        library = Tokenizer.from_file(model)
        assert token_files._cut_alike(library) == (model == WORDS)
        ids, counts = token_files._word_coder(model).encode(words)
        ends = np.cumsum(counts)
        for word, want, n, end in zip(words, library.encode_batch(words, add_special_tokens=False), counts, ends):
            assert ids[end - n : end].tolist() == want.ids, word


def test_a_full_memory_changes_nothing():
    def encode(words):
        return np.concatenate([np.frombuffer(w.encode(), np.uint8).astype(np.int32) for w in words]), np.array([len(w.encode()) for w in words])

    small, r = CodedWords(encode, room=20), random.Random(3)
    for _ in range(50):
        words = sorted({str(r.randint(0, 60)) for _ in range(15)})
        flat, starts, counts = small.lookup(pa.array(words, pa.large_string()))
        assert [bytes(flat[s : s + c].astype(np.uint8)).decode() for s, c in zip(starts, counts)] == words


@pytest.mark.parametrize("values", [
    np.zeros(1024), np.arange(1024), np.full(2048, 2**32 - 1), np.r_[np.zeros(1000), np.full(24, 2**32 - 1)],
    np.random.default_rng(0).integers(0, 2**32, 4096), np.random.default_rng(1).geometric(0.001, 8192),
])
def test_blocks_round_trip(values):
    blocks = token_files.encode_blocks(values.astype(np.uint32))
    starts = np.cumsum([0, *map(len, blocks)])[:-1]
    assert (token_files.decode_blocks(b"".join(blocks), starts) == values).all()


def test_files_round_trip(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = token_files.token_files(odd_docs, WORDS).collect()
    want, start = [], 0
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: -1 if r[0] is None else r[0])
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_files(no_docs, WORDS).count() == 0


def test_coded_documents(spark, odd_docs, no_docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    clash = odd_docs.withColumnRenamed("size", "IDS")
    rows = sentence_pieces.encode_decode(clash, PIECES).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert sentence_pieces.encode_decode(no_docs, PIECES).count() == 0


def test_a_worker_that_reads_files_holds_no_words():
    """op10_token_files reads in workers that have coded before."""
    made = []
    worker_state("token-files x", lambda: made.append(1) or CodedWords(None))
    forget_worker_state()
    worker_state("token-files x", lambda: made.append(1) or CodedWords(None))
    forget_worker_state()
    forget_worker_state()
    assert len(made) == 2


def most_bytes(run):
    import tracemalloc

    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_working_space_of_coding():
    """pipeline (token-ids): two workers and their executor took more than its memory, as a task's 2 MB of texts took 164 MB of arrays."""
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    docs = [" ".join("".join(r.choices(letters, k=r.randint(2, 12))) for _ in range(1000)) for _ in range(250)]
    coder = sentence_pieces.PieceCoder(PIECES)
    coded = []
    assert most_bytes(lambda: coded.append(coder.encode_texts(pa.array(docs, pa.large_string())))) < 100 << 20
    assert most_bytes(lambda: coder.pieces.decode(*coded[0])) < 20 << 20
    assert coder.pieces.decode(*coded[0]).to_pylist() == docs


def test_working_space_of_a_full_memory():
    """pipeline (token-ids): joining what is remembered took three times its room."""
    encode = lambda words: (np.zeros(4 * len(words), np.int32), np.full(len(words), 4))
    memory = CodedWords(encode, room=8 << 20)

    def fill():
        for i in range(60):
            memory.lookup(pa.array([f"word {i} {j}" for j in range(4000)], pa.large_string()))

    assert most_bytes(fill) < 22 << 20


def test_other_steps_drop_what_a_worker_holds():
    """pipeline: workers kept the coder and its words beside the steps that follow."""
    rows = pa.record_batch({"text": ["a", None]})
    worker_state("sentence-pieces x", lambda: "coder")
    assert next(slices(iter([rows]), "text", state="sentence-pieces x")).num_rows == 2
    assert worker_state("sentence-pieces x", lambda: "made again") == "coder"
    assert next(slices(iter([rows]), "text")).num_rows == 2
    assert worker_state("sentence-pieces x", lambda: "made again") == "made again"
    forget_worker_state()
