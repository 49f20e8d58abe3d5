"""Exact top-k by inner product through ball trees, branch and bound.

Candidates are dealt into shards by place: planes fitted on a bounded sample (SAMPLE rows a shard) cut space into cells
of about SHARD rows, and a cell that holds more (a very common vector) is dealt out by id. Each shard's ball tree is
built once and stored. A node knows its centre, radius, smallest id and rows; no row of it can score above
q . centre + |q| * radius.

A query visits shards by descending bound of their roots, in rounds of 1, 4, 16, ... shards, and hands its k-th best
score on from round to round: a shard whose bound lies below it is never visited. Within a shard nodes wait in a queue
ordered by bound, with the queries that are still interested; a query leaves a node, and all below it, once its k-th
best score so far is above the bound (nodes whose bound only equals it are entered if they hold a smaller id than the
k-th). Where queries prefer different children, each group enters its own one first.

Shard summaries (a centre and three numbers each) are sent to the workers: at most SHARDS of them; beyond
SHARDS * SHARD candidates shards grow instead. Queries are a stated set; at most QUERIES of them meet a shard in one
task, so a tree is copied once per that many of its visitors.

Defined results: vectors that are null or hold null or non-finite components, or no id, take no part, as query or candidate; a
query with fewer than k candidates returns all; ties go to the smaller id; repeated candidates count each; repeated
query rows are answered each on its own, and rows of a query's own id are no candidates of it; vectors of unequal
length are padded with zeros; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_arrow, stored

K = 20
SCALE = 64
#: Rows of a shard, about; shards, at most; rows sampled per shard to fit the planes; rows of a leaf, at most.
SHARD = 16_384
SHARDS = 1 << 16
SAMPLE = 16
LEAF = 128
#: Queries that meet a shard in one task, and that go through a tree together; groups of fewer are not split at a node.
QUERIES = 1 << 16
BLOCK = 1024
GROUP = 128
_EXACT = float(1 << 53)


def _plane(own: np.ndarray) -> np.ndarray:
    """The line between two far points of some vectors."""
    one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
    two = own[((own - one) ** 2).sum(axis=1).argmax()]
    return two - one


class Cells:
    """Planes that cut space into a number of cells, from a sample: each halves its part of the sample."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axes, self.cuts, self.children = [], [], []
        self.count = 0
        self.root = self._fit(sample, cells)

    def _fit(self, rows: np.ndarray, cells: int) -> int:
        """A node's number, or -1 - cell."""
        axis = _plane(rows) if cells > 1 and len(rows) > 1 else np.zeros(0)
        if not axis.any():
            self.count += 1
            return -self.count
        at = rows @ axis
        cut_ = float(np.quantile(at, (cells // 2) / cells))
        node = len(self.axes)
        self.axes.append(axis)
        self.cuts.append(cut_)
        self.children.append((0, 0))
        self.children[node] = (self._fit(rows[at < cut_], cells // 2), self._fit(rows[at >= cut_], cells - cells // 2))
        return node

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(vectors), np.int64), [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                low = vectors[rows] @ self.axes[node] < self.cuts[node]
                stack += [(self.children[node][0], rows[low]), (self.children[node][1], rows[~low])]
        return out


class BallTree:
    """A shard's vectors in tree order; nodes with their balls, children after their parents."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.arange(len(ids))
        start, end, left = [0], [len(ids)], []
        node = 0
        while node < len(start):  # breadth first
            rows = order[start[node] : end[node]]
            left.append(-1)
            if len(rows) <= LEAF:
                order[start[node] : end[node]] = rows[np.argsort(ids[rows], kind="stable")]
            else:
                own, middle = vectors[rows], len(rows) // 2
                order[start[node] : end[node]] = rows[np.argsort(own @ _plane(own), kind="stable")]
                left[node] = len(start)
                start += [start[node], start[node] + middle]
                end += [start[node] + middle, end[node]]
            node += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.start, self.end, self.left = np.array(start), np.array(end), np.array(left)
        self.centre = np.array([self.vectors[a:z].mean(axis=0) for a, z in zip(start, end, strict=True)])
        self.radius = np.array([np.sqrt(((self.vectors[a:z] - c) ** 2).sum(axis=1).max(initial=0)) for a, z, c in zip(start, end, self.centre, strict=True)])
        self.least = np.array([self.ids[a:z].min(initial=np.iinfo(np.int64).max) for a, z in zip(start, end, strict=True)])
        self.norm = float(np.sqrt((self.vectors**2).sum(axis=1).max(initial=0)))
        self.leaves = np.flatnonzero(self.left < 0)

    _PARTS = ("ids", "vectors", "start", "end", "left", "centre", "radius", "least", "leaves")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, norm=self.norm, **{k: getattr(self, k) for k in self._PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as parts:
            for k in cls._PARTS:
                setattr(tree, k, parts[k])
            tree.norm = float(parts["norm"])
        return tree

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, id, score) of up to k best per query with scores of at least the query's floor."""
        n = len(queries)
        size = np.sqrt((queries**2).sum(axis=1))
        slack = 1e-9 * (1 + size * self.norm)  # rounding never hides a row
        best = np.full((n, k), -np.inf)
        ids = np.full((n, k), np.iinfo(np.int64).max)
        exact = size.max(initial=0) * self.norm < _EXACT
        heap: list = []

        def wait(node: int, rows: np.ndarray, bound: np.ndarray) -> None:
            if len(rows):
                heapq.heappush(heap, (-float(bound.max()), len(heap), node, id(rows), rows, bound))

        def bounds(node: int, rows: np.ndarray) -> np.ndarray:
            return queries[rows] @ self.centre[node] + size[rows] * self.radius[node] + slack[rows]

        everyone = np.arange(n)
        wait(0, everyone, bounds(0, everyone))
        while heap:
            *_, node, _, rows, bound = heapq.heappop(heap)
            kth, low = best[rows, -1], floor[rows]
            limit = np.maximum(low, kth)
            live = (bound > limit) | ((bound >= limit) & ((self.least[node] < ids[rows, -1]) | (kth < low)))
            rows = rows[live]
            if not len(rows):
                continue
            child = int(self.left[node])
            if child >= 0:
                one, two = bounds(child, rows), bounds(child + 1, rows)
                first = one >= two
                if len(rows) >= 2 * GROUP and first.any() and not first.all():
                    for part in (first, ~first):
                        wait(child, rows[part], one[part])
                        wait(child + 1, rows[part], two[part])
                else:
                    wait(child, rows, one)
                    wait(child + 1, rows, two)
                continue
            a, z = int(self.start[node]), int(self.end[node])
            score = queries[rows] @ self.vectors[a:z].T
            if not exact:
                score = (queries[rows].astype(np.int64) @ self.vectors[a:z].T.astype(np.int64)).astype(np.float64)
            score[self.ids[None, a:z] == query_ids[rows][:, None]] = -np.inf
            score[score < np.maximum(floor[rows], best[rows, -1])[:, None]] = -np.inf
            some = np.isfinite(score).any(axis=1)
            if not some.any():
                continue
            rows, score = rows[some], score[some]
            all_scores = np.concatenate([best[rows], score], axis=1)
            all_ids = np.concatenate([ids[rows], np.broadcast_to(self.ids[a:z], score.shape)], axis=1)
            all_ids = np.where(np.isneginf(all_scores), np.iinfo(np.int64).max, all_ids)
            pick = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, pick, axis=1)
            ids[rows] = np.take_along_axis(all_ids, pick, axis=1)
        row, column = np.nonzero(~np.isneginf(best))
        return row, ids[row, column], best[row, column].astype(np.int64)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and ``v``, floor(scale * component) as doubles, of the rows that take part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    """A list column as rows of ``wide`` doubles."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy()
    if len(size) and (size == wide).all():
        return flat.reshape(-1, wide)
    out = np.zeros((len(size), wide))
    out[np.arange(wide)[None, :] < size[:, None]] = flat
    return out


_TREE = "shard long, tree binary, centre array<double>, radius double, least long, norm double"
_HIT = "q long, query long, id long, score long"


def index(candidates: DataFrame, wide: int) -> tuple[DataFrame, dict[str, np.ndarray]]:
    """The stored trees (shard, tree) of all candidates, and the shards' summaries."""
    n = candidates.count()
    shards = min(SHARDS, max(1, -(-n // SHARD)))
    most = -(-n // shards)
    sample = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * shards).select("v").collect() if shards > 1 else []
    points = np.zeros((len(sample), wide))
    for i, row in enumerate(sample):
        points[i, : len(row["v"])] = row["v"]
    cells = candidates.sparkSession.sparkContext.broadcast(Cells(points, shards))

    def dealt(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.value(_matrix(batch.column(1), wide)), pa.int64())], ["id", "v", "cell"])

    placed = cut(map_arrow(candidates.select("id", "v"), dealt, "id long, v array<double>, cell long"))
    full = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * most).collect()  # at most SHARDS / 2 cells
    parts = F.lit(1)
    for row in full:
        parts = F.when(F.col("cell") == row["cell"], F.lit(-(-row["n"] // most))).otherwise(parts)
    shard = F.col("cell") * (1 << 31) + F.pmod(F.xxhash64("id"), parts)

    def built(table: pa.Table) -> pa.Table:
        tree = BallTree(table.column("id").to_numpy(), _matrix(table.column("v"), wide))
        return pa.table({"shard": table.column("shard")[:1], "tree": pa.array([tree.to_bytes()], pa.binary()), "centre": pa.array([tree.centre[0]], pa.list_(pa.float64())),
                         "radius": pa.array([tree.radius[0]]), "least": pa.array([tree.least[0]]), "norm": pa.array([tree.norm])})

    trees = stored(placed.select(shard.alias("shard"), "id", "v").groupBy("shard").applyInArrow(built, _TREE), "trees")
    rows = trees.select("shard", "centre", "radius", "least", "norm").orderBy("shard").collect()
    summary = {k: np.array([r[k] for r in rows]) for k in ("shard", "centre", "radius", "least", "norm")}
    return trees.select("shard", "tree"), summary


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _visits(asking: DataFrame, summary: dict[str, np.ndarray], wide: int, since: int, until: int) -> DataFrame:
    """q, floor and shard for the shards that come since-th to until-th in a query's order and can reach its floor."""
    shared = asking.sparkSession.sparkContext.broadcast(summary)

    def run(batches):
        s = shared.value
        for batch in batches:
            queries, q = _matrix(batch.column(1), wide), batch.column(0).to_numpy()
            low = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)  # null: nan
            for at in range(0, len(q), BLOCK):
                some = queries[at : at + BLOCK]
                size = np.sqrt((some**2).sum(axis=1))[:, None]
                bound = some @ s["centre"].T + size * s["radius"] + 1e-9 * (1 + size * s["norm"])
                order = np.argsort(-bound, axis=1, kind="stable")[:, since:until]
                near = np.take_along_axis(bound, order, axis=1)
                row, column = np.nonzero(~(near < low[at : at + BLOCK][:, None]))
                floor = low[at + row]
                yield pa.RecordBatch.from_arrays([pa.array(q[at + row]), pa.array(floor, mask=np.isnan(floor)), pa.array(s["shard"][order[row, column]])], ["q", "floor", "shard"])

    return map_arrow(asking.select("q", "v", "floor"), run, "q long, floor double, shard long")


def search(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query, rank, id, score: the k best candidates of each query row. Both frames hold ``id`` and ``v``."""
    queries = cut(queries.select("id", "v", F.monotonically_increasing_id().alias("q")))
    count = queries.count()
    wide = max(df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (candidates, queries))
    trees, summary = index(candidates, wide)
    blocks = max(1, -(-count // QUERIES))

    def met(asked: pa.Table, told: pa.Table) -> pa.Table:
        found: list[list[np.ndarray]] = [[], [], [], []]
        if len(asked) and len(told):
            tree = BallTree.from_bytes(told.column("tree")[0].as_py())
            vectors, ids, q = _matrix(asked.column("v"), wide), asked.column("id").to_numpy(), asked.column("q").to_numpy()
            floor = np.nan_to_num(asked.column("floor").to_numpy().astype(np.float64), nan=-np.inf)
            for at in range(0, len(q), BLOCK):
                some = slice(at, at + BLOCK)
                row, hit, score = tree.search(ids[some], vectors[some], floor[some], k)
                for part, value in zip(found, (q[some][row], ids[some][row], hit, score), strict=True):
                    part.append(value)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(("q", "query", "id", "score"), found, strict=True)})

    best = None
    since, width = 0, 1
    while best is None or since < len(summary["shard"]):
        if best is None:
            asking = queries.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = best.where(F.col("rank") == k).select("q", F.col("score").cast("double").alias("floor"))
            asking = queries.join(floors, "q", "left")
        if len(summary["shard"]):
            pairs = cut(_visits(asking, summary, wide, since, since + width))
        else:
            pairs = queries.where("false").selectExpr("q", "cast(null as double) as floor", "0L as shard")
        block = F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")
        asked = pairs.withColumn("block", block).join(queries, "q")
        copies = trees.join(pairs.select("shard", block.alias("block")).distinct(), "shard")
        hits = asked.groupBy("shard", "block").cogroup(copies.groupBy("shard", "block")).applyInArrow(met, _HIT)
        best = cut(_best(hits if best is None else hits.union(best.drop("rank")), k))
        since, width = since + width, width * 4
    return best.select("query", "rank", "id", "score")
