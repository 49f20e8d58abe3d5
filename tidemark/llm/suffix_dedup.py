"""Exact removal of repeated byte strings by hash-compared suffix sorting.

A byte goes when a string of LENGTH bytes around it also starts anywhere else, in any document. Strings are found
without moving every position:

1. Anchors. Each window of LENGTH bytes has one anchor, its least-hashed (then leftmost) K-byte string, so equal
   windows have equal anchors at equal offsets. Windows in a row that share an anchor form one row: the anchor's
   hash, the hash of the row's whole context (all bytes of its windows), document and place. About one row per 85
   bytes of text; a periodic run collapses into one row.
2. Rows whose anchor and context hashes both occur again are repeats from end to end. Rows whose anchor occurs again
   in another context only may be repeats in part, and their contexts are fetched.
3. Contexts that share an anchor are sorted as suffixes, once to the right of the anchor and once, reversed, to its
   left, by a mergesort whose comparisons find the common extension by binary search over prefix polynomial hashes.
   Neighbours' extensions bound the windows a row can share; claimed extensions are verified byte by byte. With two
   rows the bounds are the answer; with more, the remaining windows are matched by their hash, and the bytes of every
   matched window are compared with those of the first one of its hash.
4. An anchor in very many contexts (a passage in a third of all documents) is dealt out in shards of at most SHARD
   rows; windows that a shard can't decide are matched between shards, at most one row per shard and window.

Where the bytes are not at hand (whole contexts, windows of different shards) two rows match if two independent 64-bit
hashes agree, a polynomial one and XXH64 of the bytes.

Defined results: a null or empty text has no bytes; texts under LENGTH bytes lose nothing; repeated rows are copies
of each other and lose all their windows; an empty table gives an empty table; rows that share an id, or have none, are
documents of their own like any others; other columns pass through ``cleaned`` untouched. A document's wanted contexts
are gathered in one row, about one for every 85 bytes of its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, stored, utf8

LENGTH = 200
K = 32
#: Rows of one anchor sorted together.
SHARD = 1024
#: Undecided windows matched between shards by one task, about.
MATCHED = 1 << 19
#: Bytes worked on at once.
SEGMENT = 1 << 19
CONTEXTS = 1 << 20
#: For joins with texts or with a row per anchor. Spark takes a table's size from its files, where copies are packed to
#: a small part of their bytes (0.6 GB of texts in 19 MB), and would broadcast it whole.
UNPACKED = "merge"
#: Spark's readers hold a batch of rows and a column of a row group for each task, outside the memory that Spark counts.
#: 512 texts instead of 4,096, and no second copy of the column by vectored input, leave room for writers and sorts.
READER_ROWS = 512
_ROWS_READ, _ROWS_DEFAULT, _VECTORED = "spark.sql.parquet.columnarReaderBatchSize", "4096", "parquet.hadoop.vectored.io.enabled"
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(29))


#: A fixed random-looking 64-bit value per byte, from a rule.
LETTER = _mix(_mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xA0761D6478BD642F)))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Prefixes:
    """Prefix polynomial hashes of one byte array, modulo 2 ** 64 over random letter values."""

    _up = _down = np.zeros(0, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(Prefixes._up) < len(data) + 1:
            n = max(len(data) + 1, 1 << 16)
            Prefixes._up, Prefixes._down = _powers(BASE, n), _powers(INVERSE, n)
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * Prefixes._up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Prefixes._down[start]


def anchors(data: np.ndarray, left: np.ndarray | None = None, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start and the anchor of each row of windows that share an anchor.

    left: for each byte, the number of bytes from it to the end of its own text, where several texts lie end to end.
    """
    n = len(data) - length + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = data.astype(np.uint64)
    for shift in (1, 2, 4):
        word = word[:-shift] | (word[shift:] << _U(8 * shift))
    part = len(data) - k + 1
    h = np.zeros(part, np.uint64)
    for at in range(0, k, 8):
        h = _mix(h ^ (word[at : at + part] * _U(0x9FB21C651E98DF25)))
    del word
    low = (h & ~_U((1 << 24) - 1)) | np.arange(part, dtype=np.uint64)  # ties go to the left
    span, width = length - k + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    at = (low & _U((1 << 24) - 1)).astype(np.int64)
    start = np.arange(n) if left is None else np.flatnonzero(left[:n] >= length)
    if not len(start):
        return start, start, start
    at = at[start]
    edge = np.flatnonzero(at[1:] != at[:-1]) + 1
    head = np.concatenate([[0], edge])
    return start[head], start[np.concatenate([edge - 1, [len(start) - 1]])], at[head]


def _rows(texts: list[tuple[int, int, np.ndarray]], out: list) -> None:
    """Rows of (document, place of its first byte in the document, bytes) laid end to end."""
    size = np.array([len(x) for _, _, x in texts], np.int64)
    data = np.concatenate([x for _, _, x in texts])
    stop = np.cumsum(size)
    first, last, at = anchors(data, np.repeat(stop, size) - np.arange(len(data)))
    if not len(first):
        return
    owner = np.searchsorted(stop, first, side="right")
    doc = np.array([d for d, _, _ in texts], np.int64)[owner]
    shift = (np.array([s for _, s, _ in texts], np.int64) - (stop - size))[owner]
    prefixes = Prefixes(data)
    key = _mix(prefixes.hash(at, at + K))
    raw, digest = data.tobytes(), xxhash.xxh64_intdigest
    context = np.array([digest(raw[a:z], 11) for a, z in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64)
    check = _mix(prefixes.hash(first, last + LENGTH) + (last - first).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    # a run of equal neighbouring rows (periodic text) is one row that repeats itself
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (check[1:] != check[:-1]) | (owner[1:] != owner[:-1])]))
    count = np.diff(np.concatenate([new, [len(first)]]))
    end = last[np.concatenate([new[1:] - 1, [len(first) - 1]])] + LENGTH
    move = shift[new]
    out.append((key[new].view(np.int64), context[new].view(np.int64), check[new].view(np.int64), doc[new], first[new] + move, end + move, last[new] + LENGTH + move, at[new] + move, count))


def _segments(size: int) -> Iterator[tuple[int, int]]:
    """Byte ranges whose window starts cover a text once."""
    for start in range(0, max(size - LENGTH + 1, 0), SEGMENT):
        yield start, min(size, start + SEGMENT + LENGTH - 1)


#: context and check: two hashes of the context's bytes; first and end: the whole run; near: the end of its first row's own context.
_ROWS = "key long, context long, check long, doc long, first long, end long, near long, anchor long, times long"


def anchor_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stage 1: one row per run of windows that share an anchor."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            ids = batch.column(0).cast(pa.int64()).to_pylist()
            out, texts, held = [], [], 0
            for i, doc in enumerate(ids):
                text = data[at[i] : at[i + 1]]
                for lo, hi in _segments(len(text)):
                    texts.append((doc, lo, text[lo:hi]))
                    held += hi - lo
                    if held >= SEGMENT:
                        _rows(texts, out)
                        texts, held = [], 0
            if texts:
                _rows(texts, out)
            yield _table(out)

    return map_arrow(docs.select(f"`{id_col}`", f"`{text_col}`"), run, _ROWS)


def _table(out: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in _ROWS.split(", ")]
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


class Suffixes:
    """Suffixes of one array, each with an end, sorted within groups by hash-compared mergesort."""

    def __init__(self, prefixes: Prefixes, start: np.ndarray, end: np.ndarray, group: np.ndarray):
        self.prefixes, self.start, self.end = prefixes, start, end
        n = len(start)
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([begin, [n]]))
        self.begin, self.size = np.repeat(begin, size), np.repeat(size, size)
        self.order = self._sorted(n)

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b: binary search over equal hashes."""
        x, y = self.start[a], self.start[b]
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.end[a] - x, self.end[b] - y)
        while True:
            open_ = low < high
            if not open_.any():
                return low
            middle = (low + high + 1) >> 1
            same = self.prefixes.hash(x, x + middle) == self.prefixes.hash(y, y + middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before b; a suffix sorts before its own extensions."""
        common = self.extension(a, b)
        x, y = self.start[a] + common, self.start[b] + common
        done, other = x >= self.end[a], y >= self.end[b]
        top = len(self.prefixes.data) - 1
        byte = self.prefixes.data[np.minimum(x, top)] < self.prefixes.data[np.minimum(y, top)]
        return np.where(done, ~other, ~other & byte)

    def _sorted(self, n: int) -> np.ndarray:
        order, place = np.arange(n), np.arange(n)
        inner = place - self.begin
        width, most = 1, int(self.size.max(initial=0))
        while width < most:
            run = inner // width
            other = (run ^ 1) * width
            count = np.clip(self.size - other, 0, width)
            low, high = np.zeros(n, np.int64), count.copy()
            odd = (run & 1).astype(bool)
            while True:
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                middle = (low[live] + high[live]) >> 1
                rival = order[self.begin[live] + other[live] + middle]
                mine = order[live]
                before = np.zeros(len(live), bool)  # does the rival stand before mine? equal ones keep their order
                right = odd[live]
                before[right] = ~self.less(mine[right], rival[right])
                before[~right] = self.less(rival[~right], mine[~right])
                low[live] = np.where(before, middle + 1, low[live])
                high[live] = np.where(before, high[live], middle)
            target = self.begin + (run & ~1) * width + inner % width + low
            merged = np.empty_like(order)
            merged[target] = order
            order, width = merged, width * 2
        return order

    def nearest(self) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix, its longest common extension with any other of its group, and with whom."""
        n = len(self.order)
        best, mate = np.zeros(n, np.int64), np.full(n, -1)
        if n < 2:
            return best, mate
        joined = np.flatnonzero(self.begin[1:] == self.begin[:-1])
        a, b = self.order[joined], self.order[joined + 1]
        common = self.extension(a, b)
        common = np.minimum(common, self._verified(a, b, common))
        for one, two in ((a, b), (b, a)):
            better = common > best[one]
            best[one[better]], mate[one[better]] = common[better], two[better]
        return best, mate

    def _verified(self, a: np.ndarray, b: np.ndarray, common: np.ndarray) -> np.ndarray:
        """Collision check: the length over which the bytes themselves agree, up to ``common``."""
        out, data = common.copy(), self.prefixes.data
        step = max(1, (1 << 19) // max(1, int(common.max(initial=1))))
        for at in range(0, len(a), step):
            x, y, c = self.start[a[at : at + step]], self.start[b[at : at + step]], common[at : at + step]
            column = np.arange(int(c.max(initial=0)))
            inside = column[None, :] < c[:, None]
            top = len(data) - 1
            differ = inside & (data[np.minimum(x[:, None] + column, top)] != data[np.minimum(y[:, None] + column, top)])
            bad = differ.any(axis=1)
            out[at : at + step][bad] = differ[bad].argmax(axis=1)
        return out


#: A row is a removed span, or (bucket not null) windows of a dealt-out anchor: hash, number, document, place.
_FOUND = "doc long, first long, end long, bucket long, windows binary"


def differing(data: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the windows at x and y differ in a byte. Where both stand one byte after the pair before them only the
    last byte is new, and the pair is taken to differ if the pair before it does."""
    if not len(x):
        return np.zeros(0, bool)
    head = np.concatenate([[True], (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1)])
    bad = data[x + LENGTH - 1] != data[y + LENGTH - 1]
    at, column = np.flatnonzero(head), np.arange(LENGTH)
    for i in range(0, len(at), 4096):
        some = at[i : i + 4096]
        bad[some] = (data[x[some][:, None] + column] != data[y[some][:, None] + column]).any(axis=1)
    run = np.cumsum(head) - 1
    return np.bincount(run, weights=bad)[run] > 0


def alike(data: np.ndarray, start: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal windows stand together, and where a new one begins. Windows are given by ascending start
    with their hashes; the bytes of each are compared with the first of its hash, and if any differ, the windows of
    that hash are told apart by their bytes."""
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    begin = np.flatnonzero(new)
    first = np.empty(len(order), np.int64)
    first[order] = np.repeat(order[begin], np.diff(np.concatenate([begin, [len(order)]])))
    pairs = np.flatnonzero(first != np.arange(len(order)))
    bad = differing(data, start[pairs], start[first[pairs]])
    if not bad.any():
        return order, new
    kind, names = np.zeros(len(window), np.int64), {}
    for i in np.flatnonzero(np.isin(window, window[pairs[bad]])).tolist():
        kind[i] = names.setdefault(data[start[i] : start[i] + LENGTH].tobytes(), len(names) + 1)
    order = np.lexsort((kind, window))
    return order, np.concatenate([[True], (window[order][1:] != window[order][:-1]) | (kind[order][1:] != kind[order][:-1])])


def resolve(doc: np.ndarray, first: np.ndarray, anchor: np.ndarray, group: np.ndarray, shared: np.ndarray, blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Removed spans (document, first, end) of contexts ordered by group, and what stays open.

    For groups dealt over several shards (shared) each distinct window is also returned once: its hash, its number
    here, document and place of one such, and a second hash.
    """
    size = np.array([len(b) for b in blobs], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(blobs), np.uint8)
    forward, backward = Prefixes(data), Prefixes(data[::-1])
    place = begin + (anchor - first)
    end = begin + size
    right = Suffixes(forward, place, end, group)
    more, right_mate = right.nearest()
    left = Suffixes(backward, len(data) - place, len(data) - begin, group)
    less, left_mate = left.nearest()
    lo = np.maximum(LENGTH - more, place + LENGTH - end)  # windows start this many bytes before the anchor, at least
    hi = np.minimum(less, place - begin)
    some = (right_mate >= 0) & (hi >= lo)
    windows = np.zeros((0, 5), np.int64)
    alone = some & (right.size == 2) & ~shared
    spans = [(doc[alone], anchor[alone] - hi[alone], anchor[alone] - lo[alone] + LENGTH)]
    # rows with more company: the windows in their bounds, matched by hash
    many = np.flatnonzero((some & (right.size > 2)) | shared)
    if len(many):
        lowest = np.where(shared[many], place[many] + LENGTH - end[many], lo[many])
        highest = np.where(shared[many], place[many] - begin[many], hi[many])
        number = np.maximum(highest - lowest + 1, 0)
        owner = np.repeat(many, number)
        back = np.repeat(highest, number) - (np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number))
        start = place[owner] - back  # ascending
        window = _mix(forward.hash(start, start + LENGTH) ^ _U(0x5851F42D4C957F2D))
        order, new = alike(data, start, window)
        times = np.diff(np.concatenate([np.flatnonzero(new), [len(order)]]))
        again = np.empty(len(order), bool)
        again[order] = np.repeat(times, times) > 1
        hit = np.flatnonzero(again)
        if len(hit):
            nearest, farthest = np.full(len(doc), 1 << 40), np.full(len(doc), -1)
            np.minimum.at(nearest, owner[hit], back[hit])
            np.maximum.at(farthest, owner[hit], back[hit])
            got = np.flatnonzero(farthest >= 0)
            spans.append((doc[got], anchor[got] - farthest[got], anchor[got] - nearest[got] + LENGTH))
        told = np.flatnonzero(new)
        one = order[told]
        wanted = shared[owner[one]]
        one, times = one[wanted], times[wanted]
        raw, digest = data.tobytes(), xxhash.xxh64_intdigest
        other = np.array([digest(raw[a : a + LENGTH], 13) for a in start[one].tolist()], np.uint64)
        windows = np.stack([window[one].view(np.int64), times, doc[owner[one]], anchor[owner[one]] - back[one], other.view(np.int64)], axis=1)
    return [np.concatenate(x) for x in zip(*spans, strict=True)], windows


def match(tables: pa.Table) -> pa.Table:
    """Stage 4: spans of windows that are single in their shard but known to another one."""
    every = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 5) for b in tables.column("windows").to_pylist()])
    every = every[np.lexsort((every[:, 4], every[:, 0]))]
    new = np.concatenate([[True], (every[1:, 0] != every[:-1, 0]) | (every[1:, 4] != every[:-1, 4])])
    size = np.diff(np.concatenate([np.flatnonzero(new), [len(every)]]))
    hit = every[(np.repeat(size, size) > 1) & (every[:, 1] == 1)]
    return pa.table({"doc": hit[:, 2], "first": hit[:, 3], "end": hit[:, 3] + LENGTH})


def _resolved(contexts: DataFrame, buckets: int) -> DataFrame:
    """Stage 3 over context rows that arrive sorted by key and shard."""
    names = [x.split()[0] for x in _FOUND.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.binary()]

    def flush(rows: list) -> pa.RecordBatch:
        if not rows:
            return pa.RecordBatch.from_arrays([pa.array([], k) for k in kinds], names)
        key, shard, shards, doc, first, anchor, blob = zip(*rows, strict=True)
        key, shard = np.array(key, np.int64), np.array(shard, np.int64)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])]))
        found, windows = resolve(np.array(doc, np.int64), np.array(first, np.int64), np.array(anchor, np.int64), group, np.array(shards, np.int64) > 1, list(blob))
        bucket = windows[:, 0] % buckets
        order = np.argsort(bucket, kind="stable")
        told, start = np.unique(bucket[order], return_index=True)
        blobs = [x.tobytes() for x in np.split(windows[order], start[1:])] if len(told) else []
        n, m = len(found[0]), len(blobs)
        columns = [np.concatenate([c, np.zeros(m, np.int64)]).tolist() for c in found] + [[None] * n + told.tolist(), [None] * n + blobs]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches):
        rows, held, now = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if held > CONTEXTS and row[:2] != now:
                    yield flush(rows)
                    rows, held = [], 0
                now = row[:2]
                rows.append(row)
                held += len(row[6])
        yield flush(rows)

    return map_arrow(contexts.select("key", "shard", "shards", "doc", "first", "anchor", "blob"), run, _FOUND)


def _contexts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The bytes of the wanted rows, fetched from their documents."""
    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "shards", "first", "end", "anchor")).alias("_wanted"))
    joined = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").alias("_text")).join(listed.hint(UNPACKED), "doc").select("doc", "_text", "_wanted")

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            column = batch.column(2)
            flat, offsets = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            each = np.diff(offsets)
            owner = np.repeat(np.arange(len(each)), each)
            first, end = (flat.field(i).to_numpy() for i in (2, 3))
            lo, hi = (at[owner] + first).tolist(), (at[owner] + end).tolist()
            raw = data.tobytes()
            doc = batch.column(0).to_numpy()[owner]
            for i in range(0, len(doc), 20_000):
                j = min(i + 20_000, len(doc))
                yield pa.RecordBatch.from_arrays(
                    [flat.field(0)[i:j], flat.field(1)[i:j], pa.array(doc[i:j]), pa.array(first[i:j]), flat.field(4)[i:j], pa.array([raw[a:b] for a, b in zip(lo[i:j], hi[i:j], strict=True)], pa.binary())],
                    ["key", "shards", "doc", "first", "anchor", "blob"])

    return map_arrow(joined, run, "key long, shards long, doc long, first long, anchor long, blob binary")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, first, end: byte ranges to remove; they may overlap. Ids are whole numbers, one for each row (see ``named``)."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(anchor_rows(docs, id_col, text_col), "anchors")
    both = F.struct("context", "check")
    keys = rows.groupBy("key").agg(F.sum("times").alias("n"), F.min(both).alias("low"), F.max(both).alias("high")).where("n > 1")
    # stored first: between two plain shuffles Spark can split a common key's many rows
    known = stored(keys.select("key", (F.col("low") != F.col("high")).alias("mixed")), "keys")
    again = stored(rows.join(known.hint(UNPACKED), "key"), "again")
    whole = again.where("NOT mixed OR times > 1").select("doc", "first", "end")
    mixed = again.where("mixed").drop("mixed")
    named = F.struct("doc", "first", "near", "anchor")
    contexts = stored(mixed.groupBy("key", "context", "check").agg(F.sum("times").alias("n"), F.min(named).alias("one")), "contexts")
    # contexts that repeat whole: all their rows go, and one of them stands for the rest below
    repeated = contexts.where("n > 1").select("key", "context", "check")
    whole_mixed = mixed.join(repeated.hint(UNPACKED), ["key", "context", "check"], "left_semi").select("doc", "first", "end")
    common = stored(contexts.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > SHARD), "common")
    wanted = contexts.join(common, "key", "left").select(
        "key", F.coalesce(F.ceil(F.col("m") / SHARD), F.lit(1)).cast("long").alias("shards"), F.col("one.doc").alias("doc"),
        F.col("one.first").alias("first"), F.col("one.near").alias("end"), F.col("one.anchor").alias("anchor"))
    fetched = _contexts(docs, wanted, id_col, text_col)
    shard = F.pmod(F.xxhash64("doc", "first"), F.col("shards"))
    sharded = fetched.withColumn("shard", shard).repartition(parts, "key", "shard").sortWithinPartitions("key", "shard", "doc", "first")
    dealt = common.agg(F.sum("m")).first()[0] or 0
    found = stored(_resolved(sharded, max(1, dealt * LENGTH // MATCHED)), "found")
    part = found.where("bucket is null").select("doc", "first", "end")
    crossing = found.where("bucket is not null").groupBy("bucket").applyInArrow(match, "doc long, first long, end long")
    return whole.union(whole_mixed).union(part).union(crossing)


def _merged(first: list[int], end: list[int], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(first, end, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return [(a, min(z, size)) for a, z in out]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row (all columns), _doc (a number of the row's own) and _text.

    The ids serve if no two rows share one and none is null, which takes a count of ids. Else the rows are written
    once with numbers, so that every later read finds the same ones.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    own = F.col(f"`{id_col}`").cast("long")
    if docs.groupBy(own.alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").limit(1).count():
        kept = stored(docs.select(row, F.monotonically_increasing_id().alias("_doc")), "numbered")
    else:
        kept = docs.select(row, own.alias("_doc"))
    return kept.select("_row", "_doc", F.col("_row").getField(text_col).alias("_text"))


def _lean_reads(spark: SparkSession) -> None:
    """Sets the session's Parquet reads to small buffers, where it has the defaults."""
    if spark.conf.get(_ROWS_READ, None) in (None, _ROWS_DEFAULT):
        spark.conf.set(_ROWS_READ, str(READER_ROWS))
    if spark.conf.get(_VECTORED, None) is None and spark._jsc.hadoopConfiguration().get(_VECTORED) is None:
        spark.conf.set(_VECTORED, "false")


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of docs and _spans; the row travels as one struct, so its names meet no others."""
    _lean_reads(docs.sparkSession)
    rows = named(docs, id_col, text_col)
    listed = spans(rows, "_doc", "_text").groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("first", "end")).alias("_spans"))
    return rows.select("_row", "_doc").join(listed.hint(UNPACKED), "_doc", "left").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], "_spans")


def _each(batch: pa.RecordBatch, text: int, spans_at: int):
    """For each row: its bytes and its maximal removed ranges."""
    data, at = utf8(batch.column(text))
    raw = data.tobytes()
    for i, listed in enumerate(batch.column(spans_at).to_pylist()):
        own = raw[at[i] : at[i + 1]]
        yield own, _merged([x["first"] for x in listed], [x["end"] for x in listed], len(own)) if listed else []


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the remaining bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for own, gone in _each(batch, 1, 2):
                view, kept, at = memoryview(own), hashlib.sha256(), 0
                for a, z in gone:
                    kept.update(view[at:a])
                    at = z
                kept.update(view[at:])
                out.append((len(own), sum(z - a for a, z in gone), len(gone), kept.hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_arrow(_joined(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", "text", "_spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the repeated bytes cut out of text_col; a null text stays null.

    A character that is cut in part goes as a whole, so the text stays valid UTF-8. No row is dropped: a document
    that consists of repeats keeps an empty text.
    """
    names = docs.columns
    joined = _joined(docs, id_col, text_col)
    text_at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for (own, gone), given in zip(_each(batch, text_at, len(names)), batch.column(text_at), strict=True):
                pieces, at = [], 0
                for a, z in gone:
                    pieces.append(own[at:a])
                    at = z
                pieces.append(own[at:])
                texts.append("".join(p.decode("utf-8", "ignore") for p in pieces) if given.is_valid else None)
            columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(joined, run, docs.schema)
