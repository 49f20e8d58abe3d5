"""SimHash near-duplicates through vantage-point trees.

A fingerprint is the bitwise majority over the XXH64 hashes of all word shingles. Distinct fingerprints are linked
when at most RADIUS bits differ. The 64 bits are cut into three blocks; of RADIUS = 4 differing bits some block has
at most one, so each block is a metric space searched with radius one:

* The top of each block's tree is fixed: rings by Hamming distance to a few vantage points, more of them for more
  fingerprints, a shard per combination of rings. A block value one bit away lies exactly one ring in or out at every level (the triangle bound, tight for
  radius one), so a fingerprint visits its own shard and the 2 ** (levels - 1) boundary shards further out; the
  nearer ones visit it. Every pair meets, once per block.
* A shard of more than SHARD rows is dealt into chunks that meet in pairs, so what a task holds is bounded.
* Within a shard a vantage-point tree over the block values prunes rings the same way, and candidates are compared
  on all 64 bits.

Shards return a spanning forest of their links, never all pairs, and linked fingerprints are merged into components
by alternating large and small stars over DataFrames.

``similar`` serves pipelines, where two documents are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Fingerprints only propose there: links of 64 bits, and of 256-bit fingerprints of the
shingle sets found the same way over 28 blocks, form candidate groups, and within each group the hashed sets
themselves are compared. Only links of 0.8 or more make components.

Defined results: null and empty texts share fingerprint zero; texts under the shingle width have one shingle, the
whole word sequence; equal texts always share a component; a row without an id is in none; an empty table gives an empty table; other columns are
ignored by the scores and kept by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, slices, utf8

SHINGLE = 4
RADIUS = 4
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Rows that one task compares, about; a shard of more is dealt into chunks, and each pair of chunks is compared.
SHARD = 1 << 20


def vantages(levels: int) -> list[int]:
    """Vantage points of the top levels, cut to a block's width: the fractional part of multiples of the golden ratio, mixed."""
    out = []
    for k in range(levels):
        x = (k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor % (1 << 64)
        out.append(x ^ x >> 31)
    return out


#: Largest matrix of items by queries compared at once in a leaf.
LEAF = 1 << 14


#: The five primes of XXH64, fixed values.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
#: Strings longer than LONG, and lengths that fewer than FEW strings of a span share, are hashed one by one.
LONG, FEW = 256, 48
#: Bytes of text whose strings are hashed together.
SPAN = 1 << 20


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(v: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _rotated(lane * np.uint64(P2) + v, 31) * np.uint64(P1)


def _xxh64_equal(lanes: np.ndarray, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    """XXH64 of the strings of n bytes at ``starts``; lanes[i] holds the eight bytes from i on."""
    at, mask = 0, (1 << 64) - 1
    if n >= 32:
        v = [np.full(len(starts), x & mask, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while n - at >= 32:
            v = [_round(x, lanes[starts + (at + 8 * k)]) for k, x in enumerate(v)]
            at += 32
        h = _rotated(v[0], 1) + _rotated(v[1], 7) + _rotated(v[2], 12) + _rotated(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * np.uint64(P1) + np.uint64(P4)
        h += np.uint64(n)
    else:
        h = np.full(len(starts), (seed + P5 + n) & mask, np.uint64)
    while n - at >= 8:
        h = _rotated(h ^ _round(np.uint64(0), lanes[starts + at]), 27) * np.uint64(P1) + np.uint64(P4)
        at += 8
    if at < n:
        rest = lanes[starts + at]
        if n - at >= 4:
            h = _rotated(h ^ (rest & np.uint64(0xFFFFFFFF)) * np.uint64(P1), 23) * np.uint64(P2) + np.uint64(P3)
            rest >>= np.uint64(32)
            at += 4
        for _ in range(n - at):
            h = _rotated(h ^ (rest & np.uint64(0xFF)) * np.uint64(P5), 11) * np.uint64(P1)
            rest >>= np.uint64(8)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(P2)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(P3)
    return h ^ (h >> np.uint64(32))


def xxh64_many(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i] : starts[i] + lengths[i]] for ascending starts; strings of one length are hashed together.

    A span of text at a time is widened to eight bytes a position, so memory is bounded whatever the text.
    """
    out = np.empty(len(starts), np.uint64)
    digest = xxhash.xxh64_intdigest
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = int(np.searchsorted(starts, first + SPAN, side="right"))
        part, sizes = starts[lo:hi] - first, lengths[lo:hi]
        window = data[first : first + int(part[-1]) + LONG] + bytes(8)
        lanes = np.ndarray(len(window) - 7, "<u8", buffer=window, strides=(1,)).copy()
        order = np.argsort(np.minimum(sizes, LONG + 1).astype(np.uint16), kind="stable")
        cuts = np.searchsorted(np.minimum(sizes[order], LONG + 1), np.arange(LONG + 2))
        singly = [order[cuts[-1] :]]
        for n in np.flatnonzero(np.diff(cuts)).tolist():
            same = order[cuts[n] : cuts[n + 1]]
            if len(same) < FEW:
                singly.append(same)
            else:
                out[lo + same] = _xxh64_equal(lanes, part[same], n, seed)
        for i in (np.concatenate(singly) + lo).tolist():
            a = int(starts[i])
            out[i] = digest(data[a : a + int(lengths[i])], seed)
        lo = hi
    return out


def shingles_of(texts: list[str | None], widths: tuple[int, ...]) -> list[list[np.ndarray]]:
    """For each width, and each text, XXH64 of each shingle; of the whole sequence where it is shorter; none without words."""
    split = [(t or "").encode().lower().split() for t in texts]  # bytes.lower() changes A-Z only; bytes.split() cuts at the six ASCII spaces
    counts = np.fromiter(map(len, split), np.int64, len(split))
    data = b" ".join([b" ".join(words) for words in split if words])
    ends = np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32), len(data))  # words hold no space
    starts = np.append(0, ends[:-1] + 1)
    tops = np.cumsum(counts)  # words up to and with each text
    out = []
    for width in widths:
        made = np.where(counts > 0, np.maximum(counts - width, 0) + 1, 0)
        bounds = np.cumsum(made)
        # the k-th shingle of a text begins with its k-th word
        head = np.arange(int(made.sum())) + np.repeat(tops - counts - (bounds - made), made)
        tail = head + np.repeat(np.minimum(width, counts), made) - 1
        found = xxh64_many(data, starts[head], ends[tail] - starts[head])
        out.append([found[b - n : b] for b, n in zip(bounds.tolist(), made.tolist(), strict=True)])
    return out


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The shingle hashes of one text."""
    return shingles_of([text], (width,))[0][0]


def batched(column: pa.Array, widths: tuple[int, ...], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """The shingle hashes of each text of a column, a tuple of one array per width; texts are taken together up to ``most`` bytes."""
    _, at = utf8(column)
    for lo, hi in slices(np.diff(at), most):
        yield from zip(*shingles_of(column.slice(lo, hi - lo).to_pylist(), widths), strict=True)


def _majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 << 7):
        bits = np.unpackbits(hashes[at : at + (255 << 7)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        full = len(bits) // 255 * 255  # sums of 255 bits fit a byte
        counts += bits[full:].sum(axis=0, dtype=np.uint8)
        if full:
            counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text: bits set in over half of its shingles' hashes, repeats included."""
    return _majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """id_col and ``fp``, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = np.array([_majority(h) for (h,) in batched(batch.column(1), (width,))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64), pa.int64())], ["id", "fp"])

    return map_arrow(docs.select(f"`{id_col}`", f"`{text_col}`"), run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def wide_fingerprint(hashes: np.ndarray, words: int = 4) -> list[int]:
    """64 * words bits over the distinct hashes of a text's shingles, as signed longs.

    The first word's hashes are those of the shingles; each further word mixes them anew. Bits differ between two
    texts in proportion to the angle between their shingle sets.
    """
    if not len(hashes):
        return [0] * words
    out = []
    for k in range(words):
        h = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        if k:
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        out.append(_majority(h))
    return [x - (1 << 64) if x >> 63 else x for x in out]


class Metric:
    """Which fingerprints link: columns of 64 bits each, blocks of them searched at radius one, and the radius over all."""

    def __init__(self, columns: tuple[str, ...], blocks: tuple[tuple[int, int, int], ...], radius: int, least_levels: int):
        self.columns, self.blocks, self.radius, self.least_levels = columns, blocks, radius, least_levels

    def levels(self, n: int) -> int:
        """Levels of the fixed tree top for n fingerprints: a level more while the fullest ring of rings, with its visitors,
        is expected to hold more than SHARD rows. Rings of w bits hold about 0.8 / sqrt(w) of all at most. A level more
        doubles the copies that visit, so no more than six are fixed; what is still too full is dealt into chunks."""
        width, found = min(w for _, _, w in self.blocks), self.least_levels
        while found < 6 and n * (0.8 / width**0.5) ** found * (1 + (1 << (found - 1))) > SHARD:
            found += 1
        return found


#: Fingerprints of 64 bits within four: of four differing bits one of three blocks has at most one, so no link is lost.
NARROW = Metric(("fp",), tuple((0, first, width) for first, width in BLOCKS), RADIUS, 3)
#: Candidates: fingerprints of 256 bits within 64 that agree but for one bit in one of 28 overlapping blocks. Texts whose
#: sets of five-word shingles have a Jaccard similarity of 0.8 differ in 39 bits on average (standard deviation 5.7),
#: unrelated ones in 128; with independent bits, 0.12 of 100 pairs at 0.8 don't meet directly (simulated).
WIDE = Metric(("w0", "w1", "w2", "w3"), tuple((w, 8 * i, 16) for w in range(4) for i in range(7)), 64, 2)
#: A candidate group of more documents or shingles than this is dealt into chunks, and each pair of chunks is compared.
GROUP_DOCS, GROUP_SHINGLES = 1024, 1 << 21


def _shards(distinct: DataFrame, metric: Metric, levels: int) -> DataFrame:
    """A row for each shard a fingerprint lives in (home) or visits, for each block."""
    rows = []
    for b, (word, first, width) in enumerate(metric.blocks):
        part = F.shiftrightunsigned(metric.columns[word], first).bitwiseAND(F.lit((1 << width) - 1))
        rings = [F.bit_count(part.bitwiseXOR(F.lit(v & ((1 << width) - 1)))) for v in vantages(levels)]
        for turn in range(-1, 1 << (levels - 1)):
            moved = [rings[k] + (0 if turn < 0 else 1 if k == 0 or turn >> (k - 1) & 1 else -1) for k in range(levels)]
            code = F.lit(b).cast("long")
            for ring in moved:
                code = code * 32 + ring + 1
            rows.append(F.struct(code.alias("shard"), F.lit(turn < 0).alias("home")))
    spread = distinct.select(*metric.columns, "rep", F.explode(F.array(*rows)).alias("_s"))
    return spread.select(F.col("_s.shard").alias("shard"), *metric.columns, "rep", F.col("_s.home").alias("home"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of shards with i and j, the pair of chunks a task compares. A shard of at most SHARD rows is one chunk; the
    rows of a larger one meet every other chunk of it, so no pair is lost and no task has more than about 2 * SHARD."""
    large = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > SHARD).select("shard", F.ceil(F.col("n") / SHARD).cast("int").alias("chunks")))
    if large.isEmpty():
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    chunked = rows.join(large, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.withColumn("chunk", F.expr("cast(pmod(xxhash64(rep), chunks) as int)"))
    other = F.explode(F.expr("sequence(0, chunks - 1)"))
    return chunked.withColumn("other", other).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "chunk", "other")


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges, in place, the components of the linked nodes a and b; a label is the smallest node of its component."""
    x, y = label[a], label[b]
    new = x != y
    if not new.any():
        return
    nodes, at = np.unique(np.concatenate([x[new], y[new]]), return_inverse=True)
    half = len(at) // 2
    to = np.arange(len(label))
    to[nodes] = nodes[forest(len(nodes), at[:half], at[half:])]
    label[:] = to[label]


def tree_links(block: np.ndarray, items: np.ndarray, queries: np.ndarray, whole: np.ndarray, radius: int) -> np.ndarray:
    """Component labels under the links (item, query) whose blocks differ in at most one bit and whole rows in at most radius.

    The tree is walked by all queries at once: a node splits its items by distance to a vantage point and hands each
    ring the queries at most one ring away. A node that no vantage splits (all blocks equal), or a small one, is
    compared directly, a few items at a time; items already in one component skip the queries that are in it too, so
    a dense group costs about as much as its size, not its square.
    """
    label = np.arange(len(block))
    stack = [(items, queries)]
    while stack:
        own, asking = stack.pop()
        if not len(own) or not len(asking):
            continue
        if len(own) * len(asking) > LEAF:
            vantage = block[own[len(own) // 2]]
            near = np.bitwise_count(block[own] ^ vantage).astype(np.int16)
            if near.any():
                away = np.bitwise_count(block[asking] ^ vantage).astype(np.int16)
                stack += [(own[near == ring], asking[np.abs(away - ring) <= 1]) for ring in np.unique(near).tolist()]
                continue
        at, step = 0, 16
        while at < len(own):
            some, rest = own[at : at + step], asking
            if at:
                own[at:] = own[at:][np.argsort(label[own[at:]], kind="stable")]
                some = own[at : at + step]
                if (label[some] == label[some[0]]).all():
                    rest = asking[label[asking] != label[some[0]]]
            at += len(some)
            step = max(16, min(1 << 12, LEAF // max(len(rest), 1)))
            for lo in range(0, len(rest), LEAF):
                part = rest[lo : lo + LEAF]
                i, q = np.nonzero(np.bitwise_count(block[some][:, None] ^ block[part][None, :]) <= 1)
                for k in range(0, len(i), LEAF):
                    a, z = some[i[k : k + LEAF]], part[q[k : k + LEAF]]
                    close = np.bitwise_count(whole[a] ^ whole[z]).sum(axis=1) <= radius
                    join_labels(label, a[close], z[close])
    return label


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node of its component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def links(distinct: DataFrame, metric: Metric = NARROW) -> DataFrame:
    """Links (a, b), a < b, that connect exactly the representatives whose fingerprints link, directly or through others."""
    levels = metric.levels(distinct.count())

    def shard_links(table: pa.Table) -> pa.Table:
        word, first, width = metric.blocks[table.column("shard")[0].as_py() >> (5 * levels)]
        whole = np.stack([table.column(c).to_numpy().view(np.uint64) for c in metric.columns], axis=1)
        rep = table.column("rep").to_numpy()
        home = table.column("home").to_numpy(zero_copy_only=False)
        block = (whole[:, word] >> np.uint64(first)) & np.uint64((1 << width) - 1)
        block = block.astype(np.uint16 if width <= 16 else np.uint32)
        label = tree_links(block, np.flatnonzero(home), np.arange(len(rep)), whole, metric.radius)
        # the forest spans the shard's links: each node to the smallest representative of its component
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        low = least[label]
        linked = low != rep
        return pa.table({"a": pa.array(low[linked], pa.int64()), "b": pa.array(rep[linked], pa.int64())})

    return _dealt(_shards(distinct, metric, levels)).groupBy("shard", "i", "j").applyInArrow(shard_links, "a long, b long").distinct()


def stars(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, component): every node of the edges with the smallest node it reaches, by large-star and small-star rounds."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are cut off first: between two plain shuffles Spark can split a hub's many rows
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = large.where("u <> v").distinct()
        kept = cut(kept)
        low = cut(kept.groupBy("u").agg(F.min("v").alias("m")))
        small = kept.join(low, "u")
        edges = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def components(prints: DataFrame, id_col: str = "doc_id", metrics: tuple[Metric, ...] = (NARROW,), carried: tuple[str, ...] = ()) -> DataFrame:
    """The columns of prints that the metrics name, and those carried along, with ``component_id``, the smallest id
    reachable by any link.

    Equal fingerprints are one node, named by their smallest id. The join back is on the fingerprint, whose hot
    values are rows of a few longs that Spark's skew join can split.
    """
    columns = list(dict.fromkeys(c for m in metrics for c in m.columns))
    distinct = prints.groupBy(*columns).agg(F.min(id_col).cast("long").alias("rep")).where("rep is not null")
    # a few bytes a row here, and a row for every shard next: spread over all cores before that
    distinct = cut(distinct.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    edges = links(distinct, metrics[0])
    for metric in metrics[1:]:
        edges = edges.union(links(distinct, metric))
    found = stars(edges)
    named = distinct.join(found, distinct["rep"] == found["node"], "left").select(*columns, F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, columns, "left").select(id_col, *carried, *columns, "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every document, by 64-bit fingerprints within four."""
    prints = cut(fingerprints(docs))
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def alike(a: int, b: int | np.ndarray, common: int | np.ndarray):
    """Whether sets of sizes a and b with so many common members have a Jaccard similarity of 0.8 or more, exactly."""
    return 9 * common >= 4 * (a + b)


def set_links(sets: list[np.ndarray]) -> np.ndarray:
    """Component labels under the links of similarity 0.8 or more between sets of distinct values; empty sets link to none.

    Components grow from a set at a time; whatever has been reached is compared no more. Only sets between 0.8 and
    1.25 times as large can link, which is a range where the sets are sorted by size.
    """
    label = np.arange(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    left = np.argsort(sizes, kind="stable")
    left = left[sizes[left] > 0]
    if len(left) < 2:
        return label
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    own = [ids[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    marked = np.zeros(int(ids.max()) + 1, bool)
    queue: list[int] = []
    gone = np.zeros(len(sets), bool)

    def packed():
        return np.concatenate([own[i] for i in left.tolist()]), np.concatenate([[0], np.cumsum(sizes[left])])

    flat, at = packed()
    for seed in left.tolist():
        if gone[seed]:
            continue
        gone[seed] = True
        queue.append(seed)
        while queue:
            x = queue.pop()
            if 2 * np.count_nonzero(gone[left]) > len(left):
                left = left[~gone[left]]
                if not len(left):
                    break
                flat, at = packed()
            n = int(sizes[x])
            lo = np.searchsorted(sizes[left], -(-4 * n // 5))
            hi = np.searchsorted(sizes[left], 5 * n // 4, side="right")
            if lo >= hi:
                continue
            marked[own[x]] = True
            common = np.add.reduceat(marked[flat[at[lo] : at[hi]]].astype(np.int32), at[lo:hi] - at[lo])
            marked[own[x]] = False
            near = left[lo:hi][alike(n, sizes[left[lo:hi]], common)]
            near = near[~gone[near]]
            gone[near] = True
            label[near] = label[seed]
            queue += near.tolist()
        queue.clear()
        if not len(left):
            break
    return label


def _same(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set of shingles (its sorted hashes)."""
    return xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes())


def verified(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes (same, rep, size, group) of each group whose shingle sets are alike.

    A group is compared in one piece, or, if large, chunk against chunk, so its sets are copied once per chunk.
    """
    groups = nodes.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("total")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / GROUP_DOCS, F.col("total") / GROUP_SHINGLES)).cast("int")
    # cut off, so that the join has shuffles of its own, in which Spark can split a large group's rows
    asked = nodes.join(cut(groups.select("group", chunks.alias("chunks"))), "group").select(
        "group", "chunks", "rep", "same", F.expr("cast(pmod(xxhash64(same), chunks) as int)").alias("chunk"))
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    found = asked.join(texts, "rep").select("group", "chunks", "chunk", "rep", "same", "text")

    def sets(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [np.unique(h) for (h,) in batched(batch.column(5), (5,))]
            # another text under the same id has its own node
            right = [i for i, (h, s) in enumerate(zip(made, batch.column(4).to_pylist(), strict=True)) if _same(h) == s]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(pa.array(right, pa.int64())) for k in range(4)), pa.array([made[i].astype("<u8").tobytes() for i in right], pa.binary())],
                ["group", "chunks", "chunk", "rep", "hashes"])

    def group_links(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        label = set_links([np.frombuffer(x.as_py(), "<u8") for x in table.column("hashes")])
        least = np.full(len(rep), np.iinfo(np.int64).max)
        np.minimum.at(least, label, rep)
        low = least[label]
        linked = low != rep
        return pa.table({"a": pa.array(low[linked], pa.int64()), "b": pa.array(rep[linked], pa.int64())})

    held = map_arrow(found, sets, "group long, chunks int, chunk int, rep long, hashes binary")
    other = F.explode(F.expr("filter(sequence(0, chunks - 1), c -> chunks = 1 or c <> chunk)"))
    dealt = held.withColumn("other", other).select("group", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "rep", "hashes")
    return dealt.groupBy("group", "i", "j").applyInArrow(group_links, "a long, b long").distinct()


def similar(docs: DataFrame) -> DataFrame:
    """doc_id and component_id of every document, linked where the sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; texts without words are alike."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            narrow, wide, same, size = [], [], [], []
            for four, five in batched(batch.column(1), (SHINGLE, 5)):
                hashes = np.unique(five)
                narrow.append(_majority(four))
                wide.append(wide_fingerprint(hashes))
                same.append(_same(hashes))
                size.append(len(hashes))
            wide = np.array(wide, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(same, pa.binary()), pa.array(size, pa.int64()), pa.array(np.array(narrow, np.uint64).view(np.int64)), *(pa.array(wide[:, k]) for k in range(4))],
                ["doc_id", "same", "size", "fp", "w0", "w1", "w2", "w3"])

    prints = cut(map_arrow(docs.select("doc_id", "text"), run, "doc_id long, same binary, size long, fp long, w0 long, w1 long, w2 long, w3 long"))
    proposed = components(prints, metrics=(NARROW, WIDE), carried=("same", "size"))
    # equal sets have equal wide fingerprints and so one group
    nodes = cut(proposed.groupBy("same").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.min("component_id").alias("group")).where("rep is not null"))
    found = stars(verified(docs, nodes))
    named = nodes.join(found, nodes["rep"] == found["node"], "left").select("same", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "same", "left").select("doc_id", "component_id")


def keep(docs: DataFrame) -> DataFrame:
    """One document of each group of ``similar``, the one with the smallest id; rows that share an id share its
    verdict, and rows without an id stay."""
    gone = similar(docs).where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
