"""Packing along a space-filling curve.

Each document is tokenized once. Its token counts, hashed into signed buckets, are projected to a few dimensions;
the Hilbert index of that point is the sort key, so documents near in content are near in order. Documents are
range-sorted by the key and laid end to end; every ``width`` ids begin a new sequence, so only the last sequence of
all can be short. A document's first position needs nothing but the sizes of the key ranges before its own.

Defined results: a null or empty text has just the end id; ties in the key follow doc_id, then the ids, so repeated
rows are laid one after the other; an empty table has no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, stored, utf8

WIDTH = 1024
DIMENSIONS, BITS = 4, 8
BUCKETS = 512
SLICE = 1 << 21
#: Ids of a key range, about; bits of a document's own hash that follow the key's 4 * 8 in the order, which is exact as a double.
RANGE, SPREAD = 1 << 24, 20


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level BPE vocabulary in the tokenizers library's JSON.

    Its tokens are spelled with one printable character per byte: printable bytes as themselves, the others, in
    order, as the characters from 256 on.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    for i, b in enumerate(x for x in range(256) if x not in set(printable)):
        to_byte[chr(256 + i)] = b
    special = {t["content"] for t in vocabulary["added_tokens"] if t["special"]}
    return {bytes(map(to_byte.__getitem__, t)): i for t, i in vocabulary["model"]["vocab"].items() if t not in special}


def added_ids(path: str) -> dict[str, int]:
    """The vocabulary's added tokens, which the library matches in text before anything else."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def top_id(path: str) -> int:
    return max([*byte_ranks(path).values(), *added_ids(path).values()])


_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    """A function from text to ids, the same ids as the tokenizers library's for this vocabulary, and the number of ids.

    The merges of such a vocabulary are ranked by id, so a rank encoder over the same vocabulary gives the same
    ids at a quarter of the cost; the tests hold the two against each other. Texts are split at added tokens first.
    """
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=byte_ranks(path), special_tokens=added_ids(path))
        _ENCODERS[path, pattern] = partial(ranks.encode, allowed_special="all", disallowed_special=()), top_id(path) + 1
    return _ENCODERS[path, pattern]


def _mixed(n: int, salt: int) -> np.ndarray:
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def projection(vocabulary: int) -> np.ndarray:
    """Per id, its hashed bucket's row of a fixed Gaussian matrix with the bucket's sign: vocabulary x DIMENSIONS."""
    hashed = _mixed(vocabulary, 7)
    matrix = np.random.default_rng(20240607).standard_normal((BUCKETS, DIMENSIONS)).astype(np.float32)
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0).astype(np.float32)
    return matrix[(hashed >> np.uint64(8)).astype(np.int64) % BUCKETS] * sign[:, None]


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates, by Skilling's transform of all rows at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        below = step - 1
        for i in range(n):
            inverted = (x[i] & step) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inverted, below, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((x[n - 1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def curve_keys(flat: np.ndarray, each: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert key of each document, from all ids one after the other and the number of each."""
    if not len(each):
        return np.zeros(0, np.int64)
    starts = np.cumsum(each) - each
    sums = np.add.reduceat(table[flat], starts, axis=0) / np.sqrt(each)[:, None]
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    return hilbert(np.clip((unit + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1))


def tokenized(docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """doc_id, key, doc_tokens and the ids (little-endian, 16 bits each where the vocabulary allows, else 32)."""

    def run(batches):
        encode, top = encoder(path, pattern)
        table, kind = projection(top + 1), np.dtype("<u2" if top <= 65536 else "<u4")
        for batch in batches:
            _, at = utf8(batch.column(1))
            for lo, hi in slices(np.diff(at), SLICE):
                parts = [np.array([*encode(t or ""), end_id], np.int32) for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                each = np.array([len(p) for p in parts], np.int64)
                keys = curve_keys(np.concatenate(parts), each, table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), pa.array(keys, pa.int64()), pa.array(each, pa.int64()), pa.array([p.astype(kind).tobytes() for p in parts], pa.binary())],
                    ["doc_id", "key", "doc_tokens", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, key long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Key ranges come from approximate quantiles of the order, as many as it takes for RANGE ids each; their sizes, one
    row per range, are the only data that reach the driver. The key alone fills half of the order, a hash of the id
    the rest, so the copies of a common text are spread over ranges too. Each range goes to the partition that its
    place among all ids gives it, so partitions hold neighbouring ranges and about equally many ids.
    """
    written = stored(tokenized(docs, path, pattern, end_id), "tokenized")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << SPREAD) - 1))
    place = written.withColumn("_order", F.col("key") * (1 << SPREAD) + spread)  # copies of one text share a key; their ids deal them out
    total = written.agg(F.sum("doc_tokens")).first()[0] or 0
    wanted = max(8 * parts, -(-total // RANGE))
    cuts = place.select("_order").approxQuantile("_order", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted)) if wanted > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)

    def ranges(batches, target: np.ndarray | None):
        for batch in batches:
            at = np.searchsorted(bounds, batch.column(batch.num_columns - 1).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())] + ([] if target is None else [pa.array(target[at])]), [*batch.schema.names, "_range"] + ([] if target is None else ["_part"]))

    def ranged(*columns: str, target: np.ndarray | None = None) -> DataFrame:
        picked = place.select(*columns, "_order")
        return map_arrow(picked, partial(ranges, target=target), ", ".join(f"{n} {t}" for n, t in [*picked.dtypes, ("_range", "int")] + ([] if target is None else [("_part", "int")])))

    sizes = ranged("doc_tokens").groupBy("_range").agg(F.sum("doc_tokens").alias("n")).collect()
    count = np.zeros(len(bounds) + 1, np.int64)
    for row in sizes:
        count[row["_range"]] = row["n"]
    base = np.cumsum(count) - count
    target = np.minimum(base * parts // max(total, 1), parts - 1).astype(np.int32)
    base = base.tolist()
    four = top_id(path) >= 65536

    def run(batches):
        kind = np.dtype("<u4" if four else "<u2")
        now, position = -1, 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            held = 0
            for part, doc, tokens, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    now, position = part, base[part]
                wide = np.frombuffer(blob, kind).astype("<u4")
                start = 0
                while start < tokens:
                    offset = position % width
                    length = min(tokens - start, width - offset)
                    piece = wide[start : start + length].tobytes()
                    for k, v in zip(out, (doc, start, length, zlib.crc32(piece), tokens, position // width, offset, piece), strict=True):
                        out[k].append(v)
                    start, position, held = start + length, position + length, held + length
                if held > 1 << 20:
                    yield _pieces(out)
                    out, held = {k: [] for k in out}, 0
            yield _pieces(out)

    dealt = ranged("doc_id", "doc_tokens", "ids", target=target).repartitionById(parts, F.col("_part")).sortWithinPartitions("_range", "_order", "doc_id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    return map_arrow(dealt.select("_range", "doc_id", "doc_tokens", "ids"), run, schema)


def _pieces(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], list(out))
