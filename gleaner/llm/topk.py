"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

Components become floor(256 * x), so scores are integers. Each task makes shards of at most ``TREE_ROWS`` vectors and builds
their trees, which are stored once. Queries come in blocks of about ``QUERY_BLOCK``; a block searches all trees in two waves.
Its queries are candidates for each other, which gives each a first k-th score; the first wave is one shard in ``WAVE``; its
k-th scores, all shards' together, are what the second wave starts from. So a search knows the current k-th score of its own
shard and, from wave to wave, that of all shards; what a wave found is stored before the next begins, and the driver holds one
block at a time.

In a tree the whole block descends: a node's bound is the product with its centre plus the query's norm times the radius;
queries whose bound is below their k-th score leave, the others go first to the child with the higher bound, and each leaf
raises the k-th scores at once.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows of the query's own
id are not its candidates; other repeated rows each count; a query id that comes again with a vector of the same length is
asked once, with its least vector. Only vectors of the query's length are compared. A product 256 * x beyond a double is held
to the largest one, and scores beyond 64 bits to the nearest long. Ties go to the smaller id. Other columns are not looked at.
An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tidy

TREE_ROWS = 8_192
LEAF = 256
QUERY_BLOCK = 4096
WAVE = 8
_EXACT = float(2**53)
_NONE = np.iinfo(np.int64).min
_MOST = np.finfo(np.float64).max


def vectors(ids: pa.Array, column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, whole-number vectors as float64)} of the rows that take part."""
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    keys = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    usable = np.asarray(pc.is_valid(ids).to_numpy(zero_copy_only=False)) & (lengths > 0)
    out = {}
    for d in np.unique(lengths[usable]):
        rows = np.flatnonzero(usable & (lengths == d))
        x = flat[starts[rows][:, None] + np.arange(d)]
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            with np.errstate(over="ignore"):
                out[int(d)] = keys[rows[fine]], np.clip(np.floor(256.0 * x[fine]), -_MOST, _MOST)
    return out


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    with np.errstate(over="ignore"):
        top = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1]
    if top < _EXACT:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.clip(whole, _NONE + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; places not taken hold the lowest score."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k = k
        self.scores = np.full((n, k), _NONE, np.int64)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.floor = np.full(n, _NONE, np.int64) if floor is None else floor

    def least(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, own: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(own[:, None] == ids[None, :], _NONE, scores)
        some = (scores >= self.least(rows)[:, None]).any(axis=1)
        rows, scores = rows[some], scores[some]
        if not len(rows):
            return
        s = np.concatenate((self.scores[rows], scores), axis=1)
        i = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        i = np.where(s == _NONE, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -np.maximum(s, _NONE + 1)), axis=-1)[:, : self.k]
        self.scores[rows], self.ids[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class BallTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, nodes: list[tuple] | None = None) -> None:
        self.ids, self.x, self.leaf = ids, x, leaf
        self.nodes: list[tuple] = nodes or []  # centre, radius, rows or None, left, right
        if not nodes:
            self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        x = self.x[rows]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = x.mean(axis=0)
            radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9)
        place = len(self.nodes)
        self.nodes.append((centre, radius, rows, -1, -1))
        if len(rows) > self.leaf and 0 < radius < np.inf:
            a = x[((x - centre) ** 2).sum(axis=1).argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            along = x @ (b - a)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
            self.nodes[place] = (centre, radius, None, left, right)
        return place

    def search(self, q: np.ndarray, own: np.ndarray, best: Best, rows: np.ndarray) -> None:
        """q, own: the block's vectors and ids; rows: their places in ``best``."""
        with np.errstate(over="ignore"):
            norms = np.sqrt((q * q).sum(axis=1))

        def bound(node: int, at: np.ndarray) -> np.ndarray:
            """With room for what doubles round off; without a finite bound there is none."""
            centre, radius = self.nodes[node][:2]
            with np.errstate(over="ignore", invalid="ignore"):
                up = q[at] @ centre + norms[at] * radius
                up = up + 1e-9 * (np.abs(up) + norms[at] * (np.sqrt(centre @ centre) + radius)) + 1e-6
            return np.where(np.isfinite(up), up, np.inf)

        def visit(node: int, at: np.ndarray) -> None:
            at = at[bound(node, at) >= best.least(rows[at])] if len(at) else at
            if not len(at):
                return
            _, _, inside, left, right = self.nodes[node]
            if inside is not None:
                for i in range(0, len(inside), 4 * self.leaf):
                    some = inside[i : i + 4 * self.leaf]
                    best.offer(rows[at], own[at], products(q[at], self.x[some]), self.ids[some])
                return
            first = bound(left, at) >= bound(right, at)
            visit(left, at[first])
            visit(right, at[~first])
            visit(right, at[first])
            visit(left, at[~first])

        visit(0, np.arange(len(q)))


SHARDS = "d int, wave int, tree binary"
HITS = "query_id bigint, d int, vec_id bigint, score bigint"


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> the task's trees."""
    waiting: dict[int, list] = {}
    made = TaskContext.get().partitionId()

    def tree(d: int) -> pa.RecordBatch:
        nonlocal made
        made += 1
        ids, x = (np.concatenate(c) for c in zip(*waiting.pop(d), strict=True))
        if np.abs(x).max() < 2**31:
            x = x.astype(np.int32)
        nodes = BallTree(ids, x.astype(np.float64), LEAF).nodes
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([int(made % WAVE > 0)], pa.int32()), pa.array([pickle.dumps((ids, x, nodes))], pa.binary())], ["d", "wave", "tree"])

    for batch in batches:
        for d, (ids, x) in vectors(batch.column(0), batch.column(1)).items():
            for i in range(0, len(ids), TREE_ROWS):
                waiting.setdefault(d, []).append((ids[i : i + TREE_ROWS], x[i : i + TREE_ROWS]))
                if sum(len(own) for own, _ in waiting[d]) >= TREE_ROWS:
                    yield tree(d)
    for d in list(waiting):
        yield tree(d)
    tidy()


def _searched(held, k: int):
    """SHARDS -> HITS of the block's queries, as many in all as may be among the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best = {d: Best(len(ids), k, floor) for d, (ids, _, floor) in block.items()}
        for batch in batches:
            for d, tree in zip(batch.column("d").to_pylist(), batch.column("tree"), strict=True):
                if d in block:
                    ids, x, nodes = pickle.loads(tree.as_buffer())
                    BallTree(ids, x.astype(np.float64), LEAF, nodes).search(block[d][1], block[d][0], best[d], np.arange(len(block[d][0])))
        for d, (ids, _, floor) in block.items():
            s = best[d].scores
            at, place = np.nonzero((s != _NONE) & (s >= floor[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), d, np.int32)), pa.array(best[d].ids[at, place]), pa.array(s[at, place])], ["query_id", "d", "vec_id", "score"])
        tidy()

    return run


def _best_of(hits: DataFrame, k: int, *query: str) -> DataFrame:
    order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(embeddings: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the ``k`` best of each row for which ``is_query`` holds."""
    if k <= 0:
        raise ValueError("k must be positive")
    context = embeddings.sparkSession.sparkContext
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= float(_MOST)), F.lit(False)))
    asked = rows.where(is_query & usable).groupBy("vec_id", F.size("embedding").alias("d")).agg(F.min("embedding").alias("embedding"))
    asked = stored(asked.select("vec_id", "embedding"), "topk-queries")
    shards = stored(rows.mapInArrow(_shards, SHARDS), "topk-shards")
    blocks = max(1, -(-asked.count() // query_block))
    found = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()
        held = {}
        for d, (ids, x) in vectors(*(block.column(c).combine_chunks() if isinstance(block.column(c), pa.ChunkedArray) else block.column(c) for c in ("vec_id", "embedding"))).items():
            best = Best(len(ids), k)
            for i in range(0, len(ids), 1024):
                best.offer(np.arange(len(ids)), ids, products(x, x[i : i + 1024]), ids[i : i + 1024])
            held[d] = ids, x, best.scores[:, -1]
        for wave in (0, 1):
            sent = context.broadcast(held)
            hits = stored(_best_of(shards.where(F.col("wave") == wave).mapInArrow(_searched(sent, k), HITS), k, "query_id", "d"), "topk-hits")
            found.append(hits)
            if wave == 0:  # a row for each query of the block at most
                now = {(r["query_id"], r["d"]): r["score"] for r in hits.where(F.col("rank") == k).collect()}
                held = {d: (ids, x, np.maximum(floor, [now.get((i, d), _NONE) for i in ids.tolist()])) for d, (ids, x, floor) in held.items()}
            sent.unpersist()
    return _best_of(reduce(DataFrame.unionByName, found).drop("rank"), k, "query_id").select("query_id", "rank", "vec_id", "score")
