"""SentencePiece encoding and decoding by a batched numpy Viterbi over the pieces of a .model file.

Words (a run of blanks and what follows up to the next blank) of equal length advance together, one character at a time.
Hashes of all substrings up to the longest piece probe the sorted hashes of the pieces; at each position the best of the
pieces that end there is kept with a backpointer, and the best path is read backwards.

For a unigram model the best path has the largest sum of scores. A BPE model's own result is not that path: merges go by
rank. It is the one path in which every two neighbours are what merging their own text would give (the merges of the
whole never cross a border that they do not cross on the two pieces alone), so for BPE the maximum runs over pieces that
are compatible with the piece before, and there is exactly one at each reachable position. Compatibility is read off the
pieces' merge trees and kept in a table of fixed size. Ids then equal those of the library.

Defined results: null texts give null ids and back; empty texts give no ids; characters that no piece covers become byte
pieces, or the unknown piece where the model has none; repeated rows are encoded each; an empty table gives an empty
result; other columns are ignored; texts are encoded whole.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

U = np.uint64
BLANK = "▁"
_BASE = U(0x9E3779B97F4A7C15)
SLOTS, CACHE, CHUNK, NONE = 1 << 19, 200_000, 1 << 21, -1
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


def _mixed(points: np.ndarray) -> np.ndarray:
    x = (points.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
    return (x ^ (x >> U(32))) * U(0xFF51AFD7ED558CCD)


def _points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


class Pieces:
    """The pieces of a model and how they join; plain arrays, sent to executors with the function that uses them."""

    def __init__(self, model: bytes):
        self.mark = zlib.crc32(model)
        self.texts: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer, normaliser = {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.texts.append(piece[1].decode())
                self.scores.append(piece[2])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or normaliser.get(2) or USER in self.kinds:
            raise ValueError("only unigram and BPE models without a character map and user-defined pieces are supported")
        self.dummy, self.squeeze = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        usual = [i for i, k in enumerate(self.kinds) if k == NORMAL and self.texts[i]]
        self.longest = max(len(self.texts[i]) for i in usual)
        hashes = np.array([self._hash(self.texts[i]) for i in usual], U)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(usual, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("hashes of pieces collide")
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.keys >> U(42)] = True
        self.points = np.array(self.scores)
        self.splits = not any(re.search(f"[^{BLANK}]{BLANK}", self.texts[i]) for i in usual)
        if self.bpe:
            self._trees(usual)
        shown = [b"" if k in (CONTROL,) else bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else t.replace(BLANK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self.shown = shown
        self.slots = (np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool))

    @staticmethod
    def _hash(text: str) -> int:
        h = U(0)
        with np.errstate(over="ignore"):
            for x in _mixed(np.array([ord(c) for c in text], np.uint32)):
                h = h * _BASE + x
        return int(h)

    def _merge(self, text: str, rank: dict[str, int]) -> list[tuple]:
        """Merge by rank; the trees that are left, each (text, left, right)."""
        parts: list[tuple] = [(c, None, None) for c in text]
        while len(parts) > 1:
            best = min(((rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a[0] + b[0] in rank), default=None)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], parts[i], parts[i + 1])]
        return parts

    def _trees(self, usual: list[int]) -> None:
        """Right and left spines of each piece: the symbols at its border while it is merged, and until which rank each stays."""
        order = sorted(usual, key=lambda i: (-self.scores[i], i))
        rank = {self.texts[i]: r for r, i in enumerate(order)}
        number = {self.texts[i]: i for i in usual}
        end = len(order)
        spines: list[list[list[tuple[int, int]]]] = [[], []]
        self.whole = np.zeros(len(self.texts), bool)
        for i in range(len(self.texts)):
            trees = self._merge(self.texts[i], rank) if self.kinds[i] == NORMAL and self.texts[i] else []
            self.whole[i] = len(trees) == 1
            for side in (0, 1):
                spine, node, until = [], trees[0] if len(trees) == 1 else None, end
                while node:
                    spine.append((number.get(node[0], NONE), until))
                    until, node = rank.get(node[0], NONE), node[2 - side]
                spines[side].append(spine)
        depth = [max(len(s) for s in x) for x in spines]
        self.right, self.left = (np.full((len(self.texts), d, 2), NONE, np.int64) for d in depth)
        for table, side in ((self.right, spines[0]), (self.left, spines[1])):
            for i, spine in enumerate(side):
                table[i, : len(spine)] = spine or np.empty((0, 2), np.int64)
        joins = {number[t[:k]] * len(self.texts) + number[t[k:]]: rank[t] for t in number for k in range(1, len(t)) if t[:k] in number and t[k:] in number}
        self.joins = np.array(sorted(joins), np.int64)
        self.join_rank = np.array([joins[k] for k in self.joins.tolist()], np.int64)

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the text of a and b gives a and b: no symbol at a's end ever merges with one at b's start."""
        s, t = np.broadcast_arrays(self.right[a][:, :, None], self.left[b][:, None])
        pair, x, y = np.nonzero((s[..., 0] >= 0) & (t[..., 0] >= 0))
        s, t = s[pair, x, y], t[pair, x, y]
        key = s[:, 0] * len(self.texts) + t[:, 0]
        at = np.minimum(np.searchsorted(self.joins, key), len(self.joins) - 1)
        r = self.join_rank[at]
        ok = np.ones(len(a), bool)
        # of merges of one rank the leftmost goes first
        ok[pair[(self.joins[at] == key) & (r < s[:, 1]) & (r <= t[:, 1])]] = False
        return ok

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, values = self.slots
        key = a * len(self.texts) + b
        slot = ((key.astype(U) * _BASE) >> U(45)).astype(np.int64)
        new = np.flatnonzero(keys[slot] != key)
        if len(new):
            pairs, where = np.unique(key[new], return_inverse=True)
            found = self._fits(pairs // len(self.texts), pairs % len(self.texts))
            out = values[slot]
            out[new] = found[where]
            spot = ((pairs.astype(U) * _BASE) >> U(45)).astype(np.int64)
            keys[spot] = pairs
            values[spot] = False
            last = keys[spot] == pairs  # of pairs that share a slot one stays
            values[spot[last]] = found[last]
            return out
        return values[slot]

    def viterbi(self, points: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each row of code points."""
        n, length = points.shape
        mixed = _mixed(points)
        sums = np.zeros((length + 1, n), U)
        for j in range(length):
            sums[j + 1] = sums[j] * _BASE + mixed[:, j]
        ending: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]
        power = np.ones(1, U)
        for size in range(1, min(self.longest, length) + 1):
            power = power * _BASE
            h = sums[size:] - sums[: length + 1 - size] * power
            row, column = np.nonzero(self.maybe[h >> U(42)])
            found = h[row, column]
            at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
            hit = self.keys[at] == found
            row, column, piece = row[hit], column[hit], self.ids[at[hit]]
            if size == 1 and len(row) < h.size:
                ids = -2 - points.T.astype(np.int64)
                ids[row, column] = piece
                row, column, piece = np.repeat(np.arange(length), n), np.tile(np.arange(n), length), ids.ravel()
            elif self.bpe and size > 1:
                usable = self.whole[piece]
                row, column, piece = row[usable], column[usable], piece[usable]
            cut = np.searchsorted(row, np.arange(len(h) + 1))
            for j in np.flatnonzero(cut[1:] > cut[:-1]):
                ending[j + size].append((size, column[cut[j] : cut[j + 1]], piece[cut[j] : cut[j + 1]]))
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last, back = np.full((length + 1, n), NONE), np.zeros((length + 1, n), np.int64)
        low = float(self.points.min()) - 10
        for j in range(1, length + 1):
            for size, rows, p in ending[j]:
                before = last[j - size, rows]
                if self.bpe and j > size:
                    open_ = before != NONE
                    rows, p, before = rows[open_], p[open_], before[open_]
                if self.bpe:
                    check = np.flatnonzero((p >= 0) & (before >= 0))
                    ok = np.ones(len(rows), bool)
                    ok[check] = self.fits(before[check], p[check])
                    rows, p = rows[ok], p[ok]
                    value = np.full(len(rows), float(size))
                else:
                    value = best[j - size, rows] + np.where(p >= 0, self.points[p], low)
                better = value > best[j, rows]
                rows, p = rows[better], p[better]
                best[j, rows], last[j, rows], back[j, rows] = value[better], p, size
        out = np.full((length, n), NONE)
        at = np.full(n, length)
        for k in range(length):
            rows = np.flatnonzero(at > 0)
            if not len(rows):
                break
            out[k, rows] = last[at[rows], rows]
            at[rows] -= back[at[rows], rows]
        size = (out != NONE).sum(0)
        back_to_front = out[::-1].T
        flat = back_to_front[back_to_front != NONE]
        ends = np.cumsum(size)
        found = np.split(flat, ends[:-1])
        for i in np.flatnonzero((out < NONE).any(0)):
            found[i] = self._covered(found[i])
        return found

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word on its own."""
        found: list[np.ndarray] = [np.empty(0, np.int64)] * len(words)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for length, which in by_length.items():
            step = max(1, 200_000 // max(1, length))
            for begin in range(0, len(which) if length else 0, step):
                part = which[begin : begin + step]
                for i, ids in zip(part, self.viterbi(_points([words[i] for i in part], length)), strict=True):
                    found[i] = ids
        return found

    def _covered(self, ids: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, np.int64)

    def words(self, text: str) -> list[str]:
        """What is merged on its own: blanks and what follows."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        text = (" " * self.dummy + text).replace(" ", BLANK)
        if not self.splits:
            return [text]
        if text[0] == BLANK and BLANK + BLANK not in text and text[-1] != BLANK:
            return [BLANK + w for w in text[1:].split(BLANK)]
        return re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", text)

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text


class Encoder:
    """Encodes texts, remembering the first CACHE words it meets; one for each model and process."""

    shared: dict[int, Encoder] = {}

    def __init__(self, pieces: Pieces):
        self.pieces, self.known = pieces, {}
        self.flat, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    @classmethod
    def of(cls, pieces: Pieces) -> Encoder:
        if pieces.mark not in cls.shared:
            cls.shared.clear()
            cls.shared[pieces.mark] = cls(pieces)
        return cls.shared[pieces.mark]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        parts = [self.pieces.words(t) for t in texts]
        new = [w for w in set().union(*parts) if w not in self.known]
        known, flat, first, size = self.known, self.flat, self.first, self.size
        if new:
            found = self.pieces.encode_words(new)
            more = np.array([len(x) for x in found], np.int64)
            first = np.concatenate([first, len(flat) + np.cumsum(more) - more])
            flat = np.concatenate([flat, *[x.astype(np.int32) for x in found]])
            size = np.concatenate([size, more])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        k = size[at]
        ids = flat[np.repeat(first[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
        ends = np.concatenate([[0], np.cumsum(k)])[np.cumsum([0, *map(len, parts)])]
        keep = max(len(self.size), CACHE)
        if len(known) > keep:  # full: the last words are forgotten again
            for w in new[len(new) - (len(known) - keep) :]:
                del known[w]
            first, size = first[:keep].copy(), size[:keep].copy()
            flat = flat[: int(first[-1] + size[-1])].copy()
        self.flat, self.first, self.size = flat, first, size
        return ids, np.diff(ends)


def load(path: str) -> Pieces:
    """Pieces of a .model file; read on the driver."""
    return Pieces(Path(path).read_bytes())


def _encoded(pieces: Pieces, decoded: bool):
    """Batches with ids appended, read from the last column; with decoded, also the text that the ids give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(pieces)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            begin, lengths = 0, np.asarray(pc.binary_length(texts.fill_null("")))
            while begin < len(texts):
                end, size = begin + 1, lengths[begin]
                while end < len(texts) and size + lengths[end] <= CHUNK:
                    size += lengths[end]
                    end += 1
                part = [t.as_py() for t in texts[begin:end]]
                ids, n = encoder.encode([t or "" for t in part])
                ends = np.concatenate([[0], np.cumsum(n)])
                offsets = pa.array(ends.astype(np.int32), mask=np.append([t is None for t in part], False))
                chunk, more, names = batch.slice(begin, end - begin), [pa.ListArray.from_arrays(offsets, pa.array(ids))], ["ids"]
                if decoded:
                    more.append(pa.array([None if t is None else pieces.decode(ids[a:z]) for t, a, z in zip(part, ends[:-1], ends[1:], strict=True)], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays([*chunk.columns[:-1], *more], [*batch.schema.names[:-1], *names])
                begin = end

    return run


def _decoded(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            texts = [None if x is None else pieces.decode(np.asarray(x)) for x in (lists[i].values if lists[i].is_valid else None for i in range(len(lists)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "decoded"])

    return run


def _with(df: DataFrame, column: str, function, more: dict[str, str]) -> DataFrame:
    """df with columns that a function of Arrow batches puts in the place of the last, a copy of column."""
    fields = [f for f in df.schema.fields if f.name not in more]
    rows = df.select(*[F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(fields)], F.col(f"`{column}`").alias("_in"))
    schema = ", ".join([f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)] + [f"{name} {kind}" for name, kind in more.items()])
    found = arrow_map(rows, function, schema)
    return found.select(*[F.col(f"_{i}").alias(f.name) for i, f in enumerate(fields)], *more)


def encode(df: DataFrame, pieces: Pieces, text: str = "text", decoded: bool = False) -> DataFrame:
    """df with ids array<int>; with decoded, also the text that they give back, decoded by the same task."""
    return _with(df, text, _encoded(pieces, decoded), {"ids": "array<int>"} | ({"decoded": "string"} if decoded else {}))


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """df with decoded, the text of an array of ids."""
    return _with(df, ids, _decoded(pieces), {"decoded": "string"})
