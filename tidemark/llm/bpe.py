"""Byte-level BPE over padded numpy matrices.

Text is cut by the tokenizer's pattern; each distinct piece is encoded once per worker. Pieces are put into
matrices by length bucket, one row each, padded with -1. In every round all rows look up the rank of each
neighbouring pair in a hash table, merge their leftmost pair of least rank, and close the gap; rows without a
mergeable pair are finished and leave the matrix (compaction).

Defined results: a null or empty text has no tokens; texts of any length are encoded whole, in slices of the
piece list; repeated rows are encoded alike; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, ragged, slices, utf8

#: Distinct pieces a worker remembers before it starts afresh; bounds memory, changes no result.
REMEMBERED = 200_000
#: Bytes of text handled at once.
SLICE = 1 << 21
#: Bytes of the longest piece that gets a matrix row; longer ones (no white space for pages) use a heap.
LONGEST_ROW = 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _closed(matrix: np.ndarray, fill: int) -> np.ndarray:
    """Every row moved one cell to the left."""
    out = np.empty_like(matrix)
    out[:, :-1] = matrix[:, 1:]
    out[:, -1] = fill
    return out


class PairTable:
    """(left id, right id) -> merged id, by open addressing in numpy; -1 where the pair doesn't merge."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(pairs) * 2.5).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, -1, np.int32)
        slot, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            candidates = left[free]
            _, first = np.unique(slot[candidates], return_index=True)
            placed = candidates[first]
            self.keys[slot[placed]], self.values[slot[placed]] = pairs[placed], merged[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)
        self.mask = size - 1

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(pairs)
        found = self.keys[slot]
        out = np.where(found == pairs, self.values[slot], -1)
        open_ = np.flatnonzero((found != pairs) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == pairs[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        self.table = PairTable(np.array(pairs, np.uint64), np.array(merged, np.int32))
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelling_length = np.array([len(x) for x in spelled], np.int64)
        self.spelling_start = np.cumsum(self.spelling_length) - self.spelling_length
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.ids = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(sizes, kind="stable")
        for k in np.flatnonzero(sizes > LONGEST_ROW).tolist():
            out[k] = self._merge_long(pieces[k])
        order = order[: len(order) - int((sizes > LONGEST_ROW).sum())]
        bounds = np.unique(np.concatenate([[0], np.searchsorted(sizes[order], [2, 3, 5, 7, 9, 12, 16, 24, 32, 64, 128, 256, 512]), [len(order)]]))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[lo:hi]
            step = max(1, (1 << 19) // max(1, int(sizes[rows].max(initial=1))))
            for at in range(0, len(rows), step):
                self._merge(pieces, rows[at : at + step], sizes, out)
        return out

    def _merge(self, pieces: list[bytes], rows: np.ndarray, sizes: np.ndarray, out: list) -> None:
        own = sizes[rows]
        width = int(own.max(initial=0))
        if width == 0:
            for r in rows:
                out[r] = np.zeros(0, np.int32)
            return
        column = np.arange(width)
        matrix = np.full((len(rows), width), -1, np.int32)
        matrix[column[None, :] < own[:, None]] = self.byte_ids[np.frombuffer(b"".join([pieces[r] for r in rows.tolist()]), np.uint8)]
        length = own.copy()
        big = np.int32(2**31 - 1)
        ranks = np.full((len(rows), max(width - 1, 1)), big, np.int32)
        if width > 1:
            valid = matrix[:, 1:] >= 0
            found = self.table(matrix[:, :-1][valid], matrix[:, 1:][valid])
            ranks[valid] = np.where(found < 0, big, found)
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of the least
            each = np.arange(len(rows))
            least = ranks[each, best]
            done = least == big
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[rows[k]] = matrix[k, : length[k]].copy()
                live = ~done
                rows, matrix, ranks, length, best, least = rows[live], matrix[live], ranks[live], length[live], best[live], least[live]
                if not len(rows):
                    return
                most = int(length.max())
                if most < matrix.shape[1]:
                    matrix, ranks = matrix[:, :most].copy(), ranks[:, : max(most - 1, 1)].copy()
                each = np.arange(len(rows))
            matrix[each, best] = least
            matrix = np.where(np.arange(matrix.shape[1])[None, :] > best[:, None], _closed(matrix, -1), matrix)
            ranks = np.where(np.arange(ranks.shape[1])[None, :] >= best[:, None], _closed(ranks, big), ranks)
            length -= 1
            left = np.flatnonzero(best > 0)
            if len(left):
                found = self.table(matrix[left, best[left] - 1], matrix[left, best[left]])
                ranks[left, best[left] - 1] = np.where(found < 0, big, found)
            right = np.flatnonzero(best + 1 < length)
            if len(right):
                found = self.table(matrix[right, best[right]], matrix[right, best[right] + 1])
                ranks[right, best[right]] = np.where(found < 0, big, found)

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One piece too long for a matrix, by the same merges in the same order, with a heap of pairs."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        found = self.table(ids[:-1], ids[1:])
        heap = [(r, i, i + 1, 0, 0) for i, r in enumerate(found.tolist()) if r >= 0]
        heapq.heapify(heap)
        value, after, before = ids.tolist(), list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges = [0] * len(value)  # of each cell so far; an entry made before a merge of either cell is stale
        while heap:
            rank, i, j, mi, mj = heapq.heappop(heap)
            if value[i] < 0 or value[j] < 0 or merges[i] != mi or merges[j] != mj:
                continue
            value[i], value[j] = rank, -1
            merges[i] += 1
            after[i] = after[j]
            if after[j] < len(value):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(value):
                    r = int(self.table(np.array([value[a]], np.int32), np.array([value[b]], np.int32))[0])
                    if r >= 0:
                        heapq.heappush(heap, (r, a, b, merges[a], merges[b]))
        return np.array([v for v in value if v >= 0], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the number of each."""
        if len(self.known) > REMEMBERED:
            self._forget()
        findall, known = self.pattern.findall, self.known
        before = len(known)
        words = [np.fromiter(map(known.__getitem__, found), np.int32, len(found)) for found in map(findall, texts)]
        if len(known) > before:
            new = [w.encode() for w in list(known)[before:]]
            fresh = self.merge_rows(new)
            lengths = np.array([len(x) for x in fresh], np.int64)
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.ids = np.concatenate([self.ids, *fresh])
        each = np.array([int(self.length[w].sum()) for w in words], np.int64)
        flat = np.concatenate(words) if words else np.zeros(0, np.int32)
        return ragged(self.ids, self.start[flat], self.length[flat]), each

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids spell."""
        return ragged(self.spelling, self.spelling_start[ids], self.spelling_length[ids]).tobytes()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, read once per process."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(path, pattern)
    return _CODECS[key]


def _batches(batches: Iterator[pa.RecordBatch], path: str, pattern: str):
    """(row numbers' first, ids per row) for slices of each batch."""
    coder = codec(path, pattern)
    for batch in batches:
        _, at = utf8(batch.column(1))
        for lo, hi in slices(np.diff(at), SLICE):
            texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
            ids, each = coder.encode(texts)
            yield coder, batch.column(0).slice(lo, hi - lo), np.split(ids, np.cumsum(each)[:-1]) if len(each) else []


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids``, the token ids of the whole text as array<int>."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for _, keys, parts in _batches(batches, path, pattern):
            values = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, values], ["id", "ids"])

    return map_arrow(docs.select(f"`{id_col}`", f"`{text_col}`"), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and ``text``: what the ids spell; bytes that aren't UTF-8 become the replacement character."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = codec(path, pattern)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return map_arrow(encoded.select(f"`{id_col}`", f"`{ids_col}`"), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and whether the decoded bytes are the text's."""

    def run(batches):
        for coder, keys, parts in _batches(batches, path, pattern):
            ids = [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]
            texts = [hashlib.sha256(coder.decode(p)).hexdigest() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [keys.cast(pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
