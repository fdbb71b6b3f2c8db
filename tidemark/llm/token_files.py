"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of one ascending range of documents: blocks of 1,024 ids, then the
place of every block, then the documents (id, whether it is null, number of ids), then a
tail of fixed length. A block stores its least id, a bit width that holds most of its
ids less that least one (a percentile, so that a few large ids do not widen all), the
packed values, and a list of the exceptions with their places.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .scratch import new_path, written
from .words import CodedWords, forget_worker_state, ids_of_words, ragged, slices, split_words, text_array, worker_state

BLOCK = 1024
_LANES = 32
_HEAD = np.dtype([("least", "<u4"), ("width", "<u2"), ("exceptions", "<u2")])
_TAIL = "<QQQQ8s"
_MAGIC = b"PFORIDS1"
_CHUNK = 512  # blocks packed or unpacked at once
_WORDS = 2000  # words coded by one call of the tokenizer
PIECE_BYTES = 16 << 20  # of pieces of words that a worker remembers
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 1024) values below 2**width to (blocks, 32 * width) words, 32 values of each lane side by side."""
    v = values.reshape(len(values), _LANES, _LANES).astype(np.uint32)
    out = np.zeros((len(values), width, _LANES), np.uint32)
    for i in range(_LANES):
        word, shift = divmod(i * width, 32)
        out[:, word] |= v[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= v[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(len(words), width, _LANES)
    out = np.empty((len(words), _LANES, _LANES), np.uint32)
    mask = np.uint32(0xFFFFFFFF >> (32 - width))
    for i in range(_LANES):
        word, shift = divmod(i * width, 32)
        v = w[:, word] >> np.uint32(shift)
        if shift + width > 32:
            v = v | (w[:, word + 1] << np.uint32(32 - shift))
        out[:, i] = v & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 90.0) -> list[bytes]:
    """Whole blocks (the last one filled up by its caller) as bytes."""
    values = ids.reshape(-1, BLOCK).astype(np.uint32)
    least = values.min(axis=1)
    over = values - least[:, None]
    bits = bit_lengths(over)
    place = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    widths = np.partition(bits, place, axis=1)[:, place]
    large = bits > widths[:, None]
    rows, places = np.nonzero(large)
    bounds = np.searchsorted(rows, np.arange(len(values) + 1))
    head = np.empty(len(values), _HEAD)
    head["least"], head["width"], head["exceptions"] = least, widths, np.diff(bounds)
    outliers = over[rows, places].astype("<u4")
    over = np.where(large, 0, over)
    packed: list[bytes] = [b""] * len(values)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        for row, words in zip(at, _pack(over[at], int(width)).astype("<u4")):
            packed[row] = words.tobytes()
    places = places.astype("<u2")
    return [
        head[i].tobytes() + packed[i] + places[lo:hi].tobytes() + outliers[lo:hi].tobytes()
        for i, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:]))
    ]


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that begin at ``starts`` within the bytes."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(_HEAD.itemsize)].copy().view(_HEAD)[:, 0]
    widths = head["width"].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        words = raw[(starts[at] + _HEAD.itemsize)[:, None] + np.arange(4 * _LANES * width)].copy().view("<u4")
        out[at] = _unpack(words, int(width))
    for i in np.flatnonzero(head["exceptions"]):
        n, at = int(head["exceptions"][i]), int(starts[i] + _HEAD.itemsize + 4 * _LANES * widths[i])
        places = np.frombuffer(data, "<u2", n, at)
        out[i, places] = np.frombuffer(data, "<u4", n, at + 2 * n)
    out += head["least"][:, None]
    return out.reshape(-1)


class TokenFileWriter:
    """Appends documents to one file; ``close`` writes the indexes."""

    def __init__(self, stream: pa.NativeFile, percentile: float = 90.0):
        self.stream, self.percentile = stream, percentile
        self.waiting: list[np.ndarray] = []
        self.held = self.at = self.n_tokens = 0
        self.blocks: list[int] = []
        self.docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def append(self, doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append((doc_ids.astype("<i8"), missing.astype("u1"), counts.astype("<i8")))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        if self.held >= _CHUNK * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate([*self.waiting, np.zeros(0, np.int32)])
        whole = len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        if last and len(rest):
            ids = np.concatenate([ids, np.full(BLOCK - len(rest), rest.min(), ids.dtype)])
            whole, rest = len(ids), rest[:0]
        for lo in range(0, whole, _CHUNK * BLOCK):
            for block in encode_blocks(ids[lo : min(whole, lo + _CHUNK * BLOCK)], self.percentile):
                self.blocks.append(self.at)
                self.stream.write(block)
                self.at += len(block)
        self.waiting, self.held = [rest], len(rest)

    def close(self) -> None:
        self._flush(True)
        columns = [np.concatenate(c) for c in zip(*self.docs)] if self.docs else [np.zeros(0)] * 3
        for part in (np.array(self.blocks, "<u8"), *columns):
            self.stream.write(part.tobytes())
        self.stream.write(struct.pack(_TAIL, self.at, len(self.blocks), len(columns[0]), self.n_tokens, _MAGIC))
        self.stream.close()


def read_documents(
    file: pa.NativeFile,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, null marks, place of each document's first id in the file, counts, and the ids end to end."""
    size = file.size()
    file.seek(size - struct.calcsize(_TAIL))
    at, n_blocks, n_docs, n_tokens, magic = struct.unpack(_TAIL, file.read())
    if magic != _MAGIC:
        raise ValueError("not a token file")
    file.seek(at)
    blocks = np.append(np.frombuffer(file.read(8 * n_blocks), "<u8").astype(np.int64), at)
    doc_ids = np.frombuffer(file.read(8 * n_docs), "<i8")
    missing = np.frombuffer(file.read(n_docs), "u1").astype(bool)
    counts = np.frombuffer(file.read(8 * n_docs), "<i8")
    ends = np.cumsum(counts)
    held, first, done = np.zeros(0, np.uint32), 0, 0  # ids not given out yet, place of the first, documents given out
    for lo in range(0, n_blocks, _CHUNK):
        hi = min(n_blocks, lo + _CHUNK)
        file.seek(int(blocks[lo]))
        ids = decode_blocks(file.read(int(blocks[hi] - blocks[lo])), blocks[lo:hi] - blocks[lo])
        held = np.concatenate([held, ids[: n_tokens - lo * BLOCK]])
        upto = int(np.searchsorted(ends, first + len(held), "right"))
        if upto > done:
            cut = int(ends[upto - 1]) - first
            part = slice(done, upto)
            yield doc_ids[part], missing[part], ends[part] - counts[part], counts[part], held[:cut]
            held, first, done = held[cut:], first + cut, upto


# What a tokenizer must say of itself for its plain words to be cut here: the cut below equals these rules on these letters.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
]}
_SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    }},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+| ")  # a space parts words
_MARK = "<|"  # words with it may hold a special token


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return dict(zip([*shown, *(b for b in range(256) if b not in shown)], [*shown, *range(256, 512)]))


def _cut_alike(tokenizer) -> bool:
    told = json.loads(tokenizer.to_str())
    return (
        told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _SPLITTER
        and all(_MARK in t["content"] for t in told["added_tokens"])
    )


def _word_coder(path: str) -> CodedWords:
    """Ids of words by the tokenizer.

    Most of a call is spent on the offsets and parts that it keeps of each word. So plain words are cut into their pieces here, and the
    tokenizer's model codes each distinct piece once; all other words are coded by the tokenizer as they are.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, _byte_letters()

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _WORDS):  # one call for many words costs less than a result for each
            own = words[at : at + _WORDS]
            found = tokenizer.encode(own, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.int32))
            counts.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [
            [t.id for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(letters))] for p in pieces
        ]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    if not _cut_alike(tokenizer):
        return CodedWords(encode)
    known = CodedWords(encode_pieces, PIECE_BYTES)

    def encode_plain(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = pa.array(_PIECES.findall(" ".join(words).lower()), pa.large_string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary
        space = pc.index(distinct, " ").as_py()
        word = np.cumsum(codes == space)[codes != space]
        flat, starts, counts = known.lookup(distinct)
        codes = codes[codes != space]
        n_ids = np.bincount(word, counts[codes], len(words)).astype(np.int64)
        return flat[ragged(starts[codes], counts[codes])], n_ids

    def encode_mixed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(words, pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(column, _PLAIN), pc.match_substring(column, _MARK)).to_numpy(zero_copy_only=False)
        where = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        coded = [f([words[i] for i in at]) for f, at in zip((encode_plain, encode), where)]
        counts, starts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        base = 0
        for at, (ids, n_ids) in zip(where, coded):
            counts[at], starts[at] = n_ids, base + np.cumsum(n_ids) - n_ids
            base += len(ids)
        return np.concatenate([ids for ids, _ in coded])[ragged(starts, counts)], counts

    return CodedWords(encode_mixed)


def _state(model: str) -> str:
    return f"token-files {model}"


def encode_texts(texts: pa.Array, model: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and where each text starts.

    The tokenizer never joins letters across white space, so each distinct word is coded once.
    """
    codes, ends, distinct = split_words(texts)
    ids, starts = ids_of_words(worker_state(_state(model), lambda: _word_coder(model)), codes, ends, distinct)
    if end_id is None:
        return ids, starts
    return np.insert(ids, starts[1:], end_id), starts + np.arange(len(starts))


def write_token_files(
    docs: DataFrame, folder: str, model: str, end_id: int | None = 2, percentile: float = 90.0
) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; returns the list of files.

    Documents are dealt by ranges of (doc_id, hash of the text), so one id on many rows
    is still split. Each task writes a file of a name of its own; a file counts only if
    it stands in the returned table, which Spark commits, so what a lost or repeated
    task leaves behind is never read. Null ids come first, null texts are empty, equal
    ids go by the hash of their text, and an empty table gives no file. Other columns are ignored.
    """
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        writer = stream = None
        for batch in slices(batches, "text", 4 << 20, _state(model)):
            if writer is None:
                store, base = fs.FileSystem.from_uri(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/ids-{shard:06d}-{uuid.uuid4().hex}.pfor"
                stream = store.open_output_stream(path)
                writer = TokenFileWriter(stream, percentile)
            ids, starts = encode_texts(text_array(batch.column("text")), model, end_id)
            doc_ids = batch.column("doc_id")
            writer.append(
                doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), np.diff(starts), ids
            )
        if writer is not None:
            writer.close()
            n_docs = sum(len(d[0]) for d in writer.docs)
            row = [shard], [path], [n_docs], [writer.n_tokens], [store.get_file_info(path).size]
            types = pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, types)], names=["shard", "path", "n_docs", "n_tokens", "n_bytes"]
            )

    return written(dealt.mapInArrow(write, MANIFEST), "token-list")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files.

    Each file is read by one task in bounded pieces; ``start`` adds the ids of earlier files, of which
    there is one row a file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget_worker_state()  # the tokenizer and its words would stay in the worker beside what is read
        store, _ = fs.FileSystem.from_uri(folder)
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"]):
                with store.open_input_file(path) as file:
                    for doc_ids, missing, starts, counts, ids in read_documents(file):
                        ids = np.ascontiguousarray(ids, "<u4")
                        bounds = np.concatenate([[0], np.cumsum(counts)])
                        yield pd.DataFrame({
                            "doc_id": pd.arrays.IntegerArray(doc_ids.astype(np.int64), missing),
                            "start": starts + base,
                            "n_tokens": counts,
                            "ids_crc32": [zlib.crc32(ids[a:b].data) for a, b in zip(bounds[:-1], bounds[1:])],
                        })

    n_files = max(1, manifest.count())
    return listed.select("path", "base").repartition(n_files).mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def token_files(docs: DataFrame, model: str, end_id: int | None = 2, percentile: float = 90.0) -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, model, end_id, percentile), folder)
