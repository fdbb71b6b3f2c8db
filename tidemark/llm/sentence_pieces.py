"""SentencePiece BPE with byte fallback in numpy: vectorised merge rounds over many words at once.

All distinct words of a slice of texts lie end to end in flat symbol arrays. A round takes
the best pair rank of every word (a segmented minimum), merges that pair at its leftmost
places in all words at once, and closes the gaps; a word leaves when no pair of its
symbols forms a piece. In a word longer than any piece, a pair need only be the best as far as a piece can
reach, so distant parts of one long word merge side by side. Where a merge would make a pair that is better
than it (or as good), the places that follow within that reach wait for the next round, so the result is
always the one of a word coded by one merge after the other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .words import CodedWords, blocks, give_back, ids_of_words, slices, text_array, worker_state

SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Text bytes that a task codes at once: the arrays of a slice take some 40 times as much.
_SLICE = 1 << 19
_CUT_EVERY = 8  # rounds from one search for finished parts of long words to the next


def _least_near(values: np.ndarray, before: int, after: int) -> np.ndarray:
    """The least value from ``before`` places before each one to ``after`` places after it."""
    low = np.concatenate([np.full(before, _NONE), values, np.full(after, _NONE)])
    have, width = 1, before + after + 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[: -(width - have)], low[width - have :]) if have < width else low


class Pieces:
    """The vocabulary of a model as arrays: symbols, pairs that merge, and what ids stand for."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)]
        plain = {p: i for i, (p, s) in enumerate(zip(pieces, special)) if not s}
        if any(model.is_unused(i) for i in range(n)) or any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("this model joins words or has unused pieces")
        self.byte_ids = np.zeros(256, np.int32)
        bytes_of: list[bytes] = []
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                spelt = bytes([int(p[3:5], 16)])
            else:
                spelt = b"" if special[i] else p.replace(SPACE, " ").encode()
            bytes_of.append(spelt)
        self.spelt = pa.array(bytes_of, pa.large_binary())
        # Symbols are pieces, then characters that occur in pieces only, then any other character.
        symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - plain.keys()):
            symbol[c] = n + len(symbol)
        self.n_ids = n
        self.others = n + len(symbol) + 1
        self.span = self.others + 0x110000
        chars = sorted((ord(p), i) for p, i in symbol.items() if len(p) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_symbols = np.array([i for _, i in chars], np.int64)
        scores = {p: model.get_score(i) for p, i in plain.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        keys, ranks, merged = [], [], []
        for p, i in plain.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.span + b)
                    ranks.append(order[scores[p]])
                    merged.append(i)
        at = np.argsort(keys)
        self.keys = np.array(keys, np.int64)[at]
        self.ranks = np.array(ranks, np.int32)[at]
        self.merged = np.array(merged, np.int64)[at]
        #: Symbols to either side that can matter to a pair: no piece is longer.
        self.reach = max(map(len, plain)) + 2
        self.breaks_lines = not any("\n" in p for p in plain)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; the largest rank where there is none."""
        keys = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        return np.where(known, self.ranks[at], _NONE), np.where(known, self.merged[at], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end and the number of ids of each; blanks count as the space mark."""
        done = [self._encode(words[lo:hi]) for lo, hi in blocks(np.fromiter(map(len, words), np.int64, len(words)))]
        return np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in done]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in done]])

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        text[text == 0x20] = ord(SPACE)
        at = np.minimum(np.searchsorted(self.chars, text), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == text, self.char_symbols[at], self.others + text)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at = np.cumsum(lengths) - lengths  # where each part of a word began
        at, sizes = at[lengths > 0], lengths[lengths > 0]
        rank, into = np.full(len(symbols), _NONE), np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            rank[:-1], into[:-1] = self.pairs(symbols[:-1], symbols[1:])
        rank[np.cumsum(sizes) - 1] = _NONE  # no pair reaches into the next word
        rounds = 0
        while len(at):
            rounds += 1
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            ended = best == _NONE
            if ended.any():
                out = np.repeat(ended, sizes)
                done.append((at[ended], sizes[ended], symbols[out]))
                symbols, rank, into = symbols[~out], rank[~out], into[~out]
                at, sizes, best = at[~ended], sizes[~ended], best[~ended]
                if not len(at):
                    break
            long = sizes > self.reach
            if rounds % _CUT_EVERY == 0 and long.any():
                at, sizes = self._cut(at, sizes, rank)
                continue
            owner = np.repeat(np.arange(len(at)), sizes)
            hits = self._safe(symbols, rank, into, owner, best[owner], long[owner] if long.any() else None)
            symbols[hits] = into[hits]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            place = np.cumsum(stay) - 1
            sizes = sizes - np.bincount(owner[hits], minlength=len(at))
            symbols, rank, into, owner = symbols[stay], rank[stay], into[stay], owner[stay]
            new = place[hits]
            for near in (new, new[new > 0] - 1):  # the pairs on both sides of what was merged
                inside = near[(near + 1 < len(symbols)) & (owner[np.minimum(near + 1, len(owner) - 1)] == owner[near])]
                rank[near], into[near] = _NONE, -1
                rank[inside], into[inside] = self.pairs(symbols[inside], symbols[inside + 1])
        return self._ids(lengths, done)

    def _cut(self, at: np.ndarray, sizes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cut long words where no pair within reach forms a piece: nothing can change there, and the parts end on their own."""
        quiet = _least_near(rank, self.reach, self.reach) == _NONE
        ends = np.cumsum(sizes)
        cut = np.zeros(len(rank), bool)
        cut[ends - 1] = True
        cut |= quiet & np.repeat(sizes > self.reach, sizes)
        last = np.flatnonzero(cut)
        parts = np.diff(last, prepend=-1)
        # A part's key keeps the order of the parts of its word: symbols stand for at least one character each.
        first = last - parts + 1
        word = np.searchsorted(ends, first, side="right")
        return at[word] + first - (ends - sizes)[word], parts

    def _safe(self, symbols, rank, into, owner, best, long) -> np.ndarray:
        """The places whose merge cannot be forestalled, in order.

        ``best`` is the least rank of the place's word. ``long`` marks places in long words: there the least rank
        within reach counts, and a place waits if one of equal rank to its left is not itself the least around.
        """
        if long is None:
            reach = len(symbols)
            hits = np.flatnonzero(rank == best)
        else:
            reach = self.reach
            best = np.where(long, _least_near(rank, reach, reach), best)
            hits = np.flatnonzero((rank == best) & (rank != _NONE))
        run = np.diff(hits, prepend=-2) != 1  # places that overlap: every second one of a run merges
        keep = (np.arange(len(hits)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0
        hits = hits[keep]
        r, made, mine = rank[hits], into[hits], owner[hits]
        follows = np.zeros(len(hits), bool)
        follows[1:] = (np.diff(hits) == 2) & (mine[1:] == mine[:-1])
        left = np.where(follows, np.concatenate([made[:1], made[:-1]]), symbols[np.maximum(hits - 1, 0)])
        has_left = (hits > 0) & (owner[np.maximum(hits - 1, 0)] == mine)
        after = np.minimum(hits + 2, len(symbols) - 1)
        has_right = (hits + 2 < len(symbols)) & (owner[after] == mine)
        danger = (has_left & (self.pairs(left, made)[0] <= r)) | (has_right & (self.pairs(made, symbols[after])[0] <= r))
        near = np.zeros(len(hits), bool)
        near[1:] = (mine[1:] == mine[:-1]) & (np.diff(hits) <= reach)
        blocked = np.zeros(len(hits), bool)
        if long is not None:
            others = np.where(rank == best, _NONE, rank)
            blocked = long[hits] & (_least_near(others, reach, 0)[hits] <= r)
        group = np.maximum.accumulate(np.where(near, 0, np.arange(len(hits))))
        earlier = np.cumsum(danger) - danger + np.cumsum(blocked) - blocked
        return hits[earlier + blocked == earlier[group]]

    def _ids(self, lengths: np.ndarray, done: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """The finished parts in the order of their places, other characters as bytes."""
        n_words = len(lengths)
        if not done:
            return np.zeros(0, np.int32), np.zeros(n_words, np.int64)
        at = np.concatenate([a for a, _, _ in done])
        sizes = np.concatenate([s for _, s, _ in done])
        symbols = np.concatenate([s for _, _, s in done])
        at = np.repeat(at, sizes)
        order = np.argsort(at, kind="stable")
        symbols = symbols[order]
        owner = np.searchsorted(np.cumsum(lengths) - lengths, at[order], side="right") - 1
        bare = symbols >= self.n_ids
        if bare.any():
            of = {i: c for c, i in zip(self.chars.tolist(), self.char_symbols.tolist())}
            spelt = {
                s: [*self.byte_ids[list(chr(s - self.others if s >= self.others else of[s]).encode())]]
                for s in np.unique(symbols[bare]).tolist()
            }
            widths = np.ones(len(symbols), np.int64)
            widths[bare] = [len(spelt[s]) for s in symbols[bare].tolist()]
            ids = np.repeat(symbols, widths)
            ids[np.repeat(bare, widths)] = [b for s in symbols[bare].tolist() for b in spelt[s]]
            symbols, owner = ids, np.repeat(owner, widths)
        return symbols.astype(np.int32), np.bincount(owner, minlength=n_words)

    def decode(self, flat: np.ndarray, starts: np.ndarray) -> pa.Array:
        """The texts of ids that ``encode_texts`` gave, without the space put before each."""
        _, offsets, data = self.spelt.take(pa.array(flat)).buffers()  # the pieces end to end
        bounds = np.frombuffer(offsets, np.int64)[starts] if len(flat) else np.zeros(len(starts), np.int64)
        data = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        spaced = (np.diff(bounds) > 0) & (data[np.minimum(bounds[:-1], max(len(data) - 1, 0))] == 0x20) if len(data) else np.zeros(len(starts) - 1, bool)
        stay = np.ones(len(data), bool)
        stay[bounds[:-1][spaced]] = False
        bounds = bounds - np.concatenate([[0], np.cumsum(spaced)])
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data[stay])])
        try:
            return found.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([b.decode("utf-8", "replace") for b in found.to_pylist()], pa.string())


class PieceCoder:
    """A model with its memory of words, kept by a worker."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.words = CodedWords(self.pieces.encode)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text starts.

        A text gets a space in front (an empty one stays empty) and is cut before each
        run of spaces and around line ends, where no piece can reach across.
        """
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        spaced = pc.if_else(pc.equal(texts, none), none, pc.binary_join_element_wise(space, texts, none))
        _, offsets, data = spaced.buffers()
        offsets = np.frombuffer(offsets, np.int64)[spaced.offset : spaced.offset + len(spaced) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)[: offsets[-1]]
        cut = np.zeros(len(raw) + 1, bool)
        blank = raw == 0x20
        before = np.zeros(len(raw), bool)
        before[1:] = blank[:-1]
        mark = np.flatnonzero(raw == 0x81)  # the space mark itself in a text joins the spaces after it
        mark = mark[mark >= 2]
        mark = mark[(raw[mark - 1] == 0x96) & (raw[mark - 2] == 0xE2)] + 1
        before[mark[mark < len(raw)]] = True
        cut[:-1] = blank & ~before
        if self.pieces.breaks_lines:
            line = np.flatnonzero(raw == 0x0A)
            cut[line] = cut[line + 1] = True
        cut[offsets] = True
        bounds = np.flatnonzero(cut[offsets[0] :]) + offsets[0]
        coded = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int64)), data)
        coded = coded.dictionary_encode()
        return ids_of_words(
            self.words, coded.indices.to_numpy().astype(np.int64), np.searchsorted(bounds, offsets),
            coded.dictionary,
        )


def _state(model: str) -> str:
    return f"sentence-pieces {model}"


def coder(model: str) -> PieceCoder:
    return worker_state(_state(model), lambda: PieceCoder(model))


def encode_decode(docs: DataFrame, model: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the ids of every whole ``text`` and the text that they decode to.

    No begin or end ids and no sampling. A null text counts as empty and gives no ids and
    an empty text; texts of any length are coded whole; repeated rows stay. Other columns
    pass untouched, but columns named like the two new ones (in any case) are replaced.
    ``model`` is a path that every executor has. No shuffle: rows stay where they are.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in (ids.lower(), decoded.lower())]
    schema = T.StructType([
        *kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType()),
    ])
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE, _state(model)):
            own = coder(model)
            flat, starts = own.encode_texts(text_array(batch.column(at)))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(flat))
            texts = own.pieces.decode(flat, starts)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, texts], names=[*batch.schema.names, ids, decoded])
            del flat, starts, lists, texts
            give_back()

    return docs.select(*[F.col(f"`{f.name.replace('`', '``')}`") for f in kept]).mapInArrow(run, schema)
