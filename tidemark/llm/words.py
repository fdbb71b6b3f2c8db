"""Arrow helpers shared by the operators: bounded slices, words, and a cache of coded words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that a task works on at once; one longer text forms a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes of words and ids that a worker remembers before it forgets the rarer half.
CACHED_BYTES = 40 << 20
#: A word longer than this is coded anew each time.
LONG_WORD = 256
#: Bytes or characters of words that are worked on by one call; its arrays take many times as much.
BLOCK = 1 << 18


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """One object per Python worker, kept from task to task until a task asks for another key (task code itself is sent anew with every job)."""
    if not holds_state(key):
        forget_worker_state()
        give_back()  # also what other steps left in this worker
        kept = sys.modules["_tidemark_worker"] = types.ModuleType("_tidemark_worker")
        kept.key, kept.value = key, make()
    return sys.modules["_tidemark_worker"].value


def forget_worker_state() -> None:
    """Drop what this Python worker keeps and give its memory back."""
    kept = sys.modules.pop("_tidemark_worker", None)
    if kept is not None:
        kept.value = None
        gc.collect()
        give_back()


def holds_state(key: Hashable) -> bool:
    """Whether this Python worker keeps the object of ``key``."""
    return getattr(sys.modules.get("_tidemark_worker"), "key", None) == key


def give_back() -> None:
    """Give memory that is free in this Python worker back."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as 64-bit-offset strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(lengths: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """First and end of runs of about ``limit`` in all; one greater length is not divided."""
    group = np.cumsum(lengths, dtype=np.int64) // limit
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    yield from zip(starts.tolist(), [*starts[1:].tolist(), len(group)])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, state: Hashable = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes, so that memory does not follow the batch size.

    ``state`` is the key of what the worker keeps for this step; what it keeps for another one is dropped.
    """
    if not holds_state(state):
        forget_worker_state()
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for lo, hi in blocks(lengths, limit):
            yield batch.slice(lo, hi - lo)
            pa.default_memory_pool().release_unused()  # a worker's tasks would else pile up what the pool keeps


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space of each text.

    Returns the code of each word, the place where each text's words start (one more
    than texts), and the distinct words that the codes stand for.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    filled = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(filled).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), kept[ends], coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    some = lengths > 0
    starts, lengths = starts[some], lengths[some]
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[heads] = np.concatenate([[starts[0]], starts[1:] - (starts[:-1] + lengths[:-1] - 1)])
    return np.cumsum(out, out=out)


class CodedWords:
    """Ids of words, each distinct word coded once while it is remembered.

    ``encode`` codes a list of words and returns their ids end to end and the number of ids of each.
    Words lie in runs, each with its own index, whose sizes at least halve from one to the next; new words are a run of
    their own, and runs of like size are merged. So a slice pays for its own words, not for all that are remembered. Beyond
    ``room`` bytes the half that was asked for most often stays.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], room: int = CACHED_BYTES):
        self.encode, self.room = encode, room
        self.runs: list[_Run] = []

    def _add(self, run: _Run) -> None:
        self.runs.append(run)
        while len(self.runs) > 1 and 2 * len(self.runs[-1].keys) >= len(self.runs[-2].keys):
            last = self.runs.pop()
            self.runs[-1] = self.runs[-1].with_words(last)
        if sum(r.nbytes for r in self.runs) > self.room:
            self._forget()

    def _forget(self) -> None:
        """Keep the half that was asked for most often, as one run; what goes is dropped before anything is merged."""
        keys, asked = (np.concatenate([getattr(r, name) for r in self.runs]) for name in ("keys", "asked"))
        stays = np.zeros(len(keys), bool)
        stays[np.lexsort((keys, -asked))[: len(keys) // 2]] = True
        del keys, asked
        ends = np.cumsum([len(r.keys) for r in self.runs])
        for i, part in enumerate(np.split(stays, ends[:-1])):
            self.runs[i] = self.runs[i].only(np.flatnonzero(part))
        while len(self.runs) > 1:
            last = self.runs.pop()
            self.runs[-1] = self.runs[-1].with_words(last)
        self.runs[0].asked //= 2

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids end to end, and where each of the distinct words' ids start and how many they are."""
        keys = word_keys(words)
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        todo, parts, base = np.arange(len(words)), [], 0
        for run in self.runs:
            at, known = run.find(keys[todo], words.take(pa.array(todo)))
            starts[todo[known]] = base + run.starts[at]
            counts[todo[known]] = run.counts[at]
            run.asked[at] += 1
            parts.append(run.flat)
            base += len(run.flat)
            todo = todo[~known]
        if len(todo):
            new = words.take(pa.array(todo))
            ids, n_ids = self.encode(new.to_pylist())
            n_ids = n_ids.astype(np.int64)
            first = np.cumsum(n_ids) - n_ids
            starts[todo], counts[todo] = base + first, n_ids
            parts.append(ids.astype(np.int32))
            short = np.flatnonzero(pc.binary_length(new).to_numpy(zero_copy_only=False) <= LONG_WORD)
            if len(short):
                self._add(_Run.of(keys[todo[short]], new.take(pa.array(short)), ids[ragged(first[short], n_ids[short])].astype(np.int32), n_ids[short]))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), starts, counts


class _Run:
    """Words in order of their hashes, and where the ids of each start in ``flat``, in any order."""

    def __init__(self, keys: np.ndarray, words: pa.Array, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, asked: np.ndarray):
        self.keys, self.words, self.flat, self.starts, self.counts, self.asked = keys, words, flat, starts, counts, asked
        self.nbytes = keys.nbytes + words.nbytes + flat.nbytes + 3 * counts.nbytes

    @staticmethod
    def of(keys: np.ndarray, words: pa.Array, flat: np.ndarray, counts: np.ndarray) -> _Run:
        order = np.argsort(keys, kind="stable")
        starts = np.cumsum(counts) - counts
        return _Run(keys[order], words.take(pa.array(order)), flat, starts[order], counts[order], np.zeros(len(keys), np.int64))

    def with_words(self, other: _Run) -> _Run:
        """Both, made column by column, so that only one column is held a third time."""
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.concatenate([self.starts, other.starts + len(self.flat)])[order]
        counts = np.concatenate([self.counts, other.counts])[order]
        asked = np.concatenate([self.asked, other.asked])[order]
        words = pa.concat_arrays([self.words, other.words]).take(pa.array(order))
        return _Run(keys, words, np.concatenate([self.flat, other.flat]), starts, counts, asked)

    def only(self, at: np.ndarray) -> _Run:
        """The words at these places."""
        counts = self.counts[at]
        flat = self.flat[ragged(self.starts[at], counts)]
        return _Run(self.keys[at], self.words.take(pa.array(at)), flat, np.cumsum(counts) - counts, counts, self.asked[at])

    def find(self, keys: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known ones among ``words``, and which they are; a word whose hash belongs to another one counts as unknown."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        hit = np.flatnonzero(known)
        same = pc.equal(self.words.take(pa.array(at[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        known[hit[~same]] = False
        return at[known], known


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    keys = np.zeros(len(words), np.uint64)
    for lo, hi in blocks(np.diff(bounds)):
        keys[lo:hi] = _keys(raw, bounds[lo : hi + 1])
    return keys


def _keys(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    own = raw[bounds[0] : bounds[-1]].astype(np.uint64)
    lengths = np.diff(bounds)
    place = np.arange(len(own)) - np.repeat(bounds[:-1] - bounds[0], lengths)
    h = (own + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9) + (place.astype(np.uint64) << np.uint64(1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
    ends = bounds - bounds[0]
    key = total[ends[1:]] - total[ends[:-1]] + lengths.astype(np.uint64)
    return key ^ (key >> np.uint64(31))


def ids_of_words(
    cache: CodedWords, codes: np.ndarray, ends: np.ndarray, distinct: pa.Array
) -> tuple[np.ndarray, np.ndarray]:
    """All ids end to end, and where each text's ids start (one more than texts)."""
    flat, starts, counts = cache.lookup(distinct)
    per_word = counts[codes]
    ids = flat[ragged(starts[codes], per_word)]
    return ids, np.concatenate([[0], np.cumsum(per_word)])[ends]
