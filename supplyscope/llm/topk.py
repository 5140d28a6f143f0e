"""Exact top-k search by inner product: ball-tree branch and bound in shards.

Vectors are dealt to shards of about ``SHARD_BYTES``; a shard's vectors form a ball tree (median
cuts along the widest component; a node has a centre and a radius).  A query's score in a node is at
most q.centre + |q| radius.  Queries meet every shard in two passes:

1. every shard scores each query's best leaf; the k-th best score of these over all shards, which the
   true k-th score can't fall below, is shared with all shards;
2. every shard walks its tree by descending upper bound, with the queries that a node can still
   improve, and keeps raising each query's k-th score.

Components are floor(256 x) with x as double; scores are exact integer inner products (computed as
doubles where no sum can reach 2**53, as Python integers beyond; a score beyond a long is an error).

Defined results: vectors that are null, empty, or hold null or non-finite components, and rows without
an id, take no part; queries only meet vectors of their own length; rows that repeat an id are
candidates each, and a query excludes all rows of its own id; queries that repeat in id and vector count
once; ties go to the smaller id; a query with fewer candidates than k gets all of them.  Empty tables
give an empty result.  Other columns are not read.

Scale: a partition of the shuffle by shard holds the shard's vectors first, then the queries.  A task
holds one shard's tree and lets the queries pass by in batches, so its memory grows with neither table.
No vectors are broadcast or collected into rows, and a pass moves each vector once and each query once a
shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyscope.llm import textops as T
from supplyscope.session import ROWS_PER_TASK

K = 5
#: Ids divisible by this are the queries.
EVERY = 50
#: Rows below which a table isn't cut further for the sake of more tasks, and how far it is.  Queries go to
#: every shard, so more shards than the memory asks for cost copies of the queries.
SHARD_ROWS, SHARDS = 1024, 64
#: Vectors of a shard, as longs, with what a row takes besides in a tree and its bounds.
SHARD_BYTES, ROW_BYTES = 32 << 20, 256
BLOCK_QUERIES = 1024
LEAF_ROWS = 256


def quantised(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, dim, v, salt): valid vectors as little-endian integers of 2, 4 or 8 bytes, the least that hold
    all of a vector's components; the salt spreads repeated rows."""
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, x = batch.column(0), batch.column(1)
            size = pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size)
            with np.errstate(over="ignore"):
                flat = np.floor(256 * pc.fill_null(x.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64))
            held = np.flatnonzero(size)
            most = np.zeros(len(size))
            if len(held):
                # NaN or infinite where a component is.
                most[held] = np.maximum.reduceat(np.abs(flat), end[held] - size[held])
            take = np.flatnonzero(d.is_valid().to_numpy(zero_copy_only=False) & (size > 0) & np.isfinite(most))
            if (most[take] >= 2.0**62).any():
                raise OverflowError(f"the vector of {d[int(take[most[take] >= 2.0**62][0])]} has components beyond 2**62")
            width = np.where(most < 2.0**15, 2, np.where(most < 2.0**31, 4, 8))
            raw = {w: np.where(np.abs(flat) < 2.0 ** (8 * w - 1), flat, 0).astype(f"<i{w}").tobytes() for w in np.unique(width[take])}
            vs = [raw[w][w * (e - n):w * e] for w, n, e in zip(width[take].tolist(), size[take].tolist(), end[take].tolist())]
            yield pa.RecordBatch.from_arrays(
                [d.take(pa.array(take)), pa.array(size[take], pa.int32()), pa.array(vs, pa.binary()), pa.array(take, pa.int64())],
                names=["vec_id", "dim", "v", "salt"])

    T.ship(df.sparkSession)
    thin = df.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>"))
    return thin.mapInArrow(one, "vec_id long, dim int, v binary, salt long")


def unpacked(v: pa.Array, dim: int) -> np.ndarray:
    """The vectors of ``quantised``, all of length ``dim``, as rows of longs."""
    held = v.to_pylist()
    out, width = np.empty((len(held), dim), np.int64), np.array([len(x) for x in held], np.int64) // dim
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        out[at] = np.frombuffer(b"".join([held[i] for i in at]), f"<i{w}").reshape(-1, dim)
    return out


class Tree:
    """A ball tree over rows of integer vectors, which lie leaf by leaf; ``rows`` has each leaf's slice."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.left, self.right, self.rows = [], [], []
        centres, radii, order_of, n = [], [], [], 0
        todo = [(np.arange(len(ids)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            me = len(self.rows)
            if parent >= 0:
                (self.left if side else self.right)[parent] = me
            x = vectors[rows].astype(np.float64)
            centre = x.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max()))
            self.left.append(-1)
            self.right.append(-1)
            if len(rows) <= LEAF_ROWS:
                self.rows.append(slice(n, n + len(rows)))
                order_of.append(rows)
                n += len(rows)
                continue
            self.rows.append(None)
            order = np.argsort(x[:, int(np.ptp(x, axis=0).argmax())], kind="stable")
            half = len(rows) // 2
            todo += [(rows[order[:half]], me, 1), (rows[order[half:]], me, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        placed = np.concatenate(order_of)
        self.ids, self.vectors = ids[placed], vectors[placed]
        self.doubles = self.vectors.astype(np.float64)
        self.most = float(np.abs(self.doubles).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a query (row) in a node (column) is higher, rounding included."""
        q = queries.astype(np.float64)
        norms = np.sqrt((q ** 2).sum(axis=1))[:, None]
        exact = q @ self.centres.T + norms * self.radii[None, :]
        slack = norms * (np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii)[None, :]
        return exact + 1e-9 * slack + 1e-6


class Asked:
    """A block of queries that meets a tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, tree: Tree):
        self.ids, self.vectors, self.tree = ids, vectors, tree
        self.most = float(np.abs(vectors.astype(np.float64)).max(initial=0)) * tree.most * vectors.shape[1]
        self.doubles = vectors.astype(np.float64) if self.most < 2.0**53 else None

    def scores(self, of: np.ndarray, rows: slice) -> np.ndarray:
        """Exact inner products of the queries ``of`` with these rows of the tree, as whole doubles or longs."""
        if self.most < 2.0**53:
            return self.doubles[of] @ self.tree.doubles[rows].T
        if self.most < 2.0**63:
            return self.vectors[of] @ self.tree.vectors[rows].T
        exact = self.vectors[of].astype(object) @ self.tree.vectors[rows].astype(object).T
        return exact.astype(np.int64)  # OverflowError beyond a long


_NONE = np.iinfo(np.int64).min
_LAST = np.iinfo(np.int64).max


class _Best:
    """Each query's k best (score, id) so far, and a score that its k-th can't fall below."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.score = np.full((queries, k), _NONE)
        self.id = np.full((queries, k), _LAST)
        self.k, self.floor = k, floor

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[of], score], axis=1)
        i = np.concatenate([self.id[of], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(s == _NONE, _LAST, i)
        # lexsort by the last key first: descending score (longs can't be negated safely), then id.
        order = np.lexsort((i, ~s), axis=1)[:, :self.k]
        self.score[of] = np.take_along_axis(s, order, axis=1)
        self.id[of] = np.take_along_axis(i, order, axis=1)
        self.floor[of] = np.maximum(self.floor[of], self.score[of][:, -1])


def _leaf(node: int, best: _Best, of: np.ndarray, asked: Asked) -> None:
    """Offer a leaf's scores that reach the floor (a tie can still have the smaller id)."""
    rows = asked.tree.rows[node]
    s = asked.scores(of, rows)
    near = np.flatnonzero((s >= best.floor[of].astype(s.dtype)[:, None]).any(axis=1))
    if len(near):
        of, s, ids = of[near], s[near].astype(np.int64), asked.tree.ids[rows]
        s[(s < best.floor[of][:, None]) | (asked.ids[of][:, None] == ids[None, :])] = _NONE  # not with its own id
        best.add(of, s, ids)


def seed(asked: Asked, k: int) -> _Best:
    """Each query's best scores in its most promising leaf."""
    tree = asked.tree
    best = _Best(len(asked.ids), k, np.full(len(asked.ids), _NONE))
    leaves = np.array([i for i, r in enumerate(tree.rows) if r is not None])
    first = leaves[tree.bounds(asked.vectors)[:, leaves].argmax(axis=1)]
    for node in np.unique(first):
        _leaf(node, best, np.flatnonzero(first == node), asked)
    return best


def search(asked: Asked, k: int, floor: np.ndarray) -> _Best:
    """Each query's k best in the tree that reach ``floor``, by branch and bound."""
    tree = asked.tree
    best = _Best(len(asked.ids), k, floor.copy())
    bounds = tree.bounds(asked.vectors)
    heap = [(-float(bounds[:, 0].max()), 0, np.arange(len(asked.ids)))]
    while heap:
        _, node, of = heapq.heappop(heap)
        of = of[bounds[of, node] >= best.floor[of]]  # a tie can still have the smaller id
        if not len(of):
            continue
        if tree.rows[node] is not None:
            _leaf(node, best, of, asked)
            continue
        for child in (tree.left[node], tree.right[node]):
            mine = of[bounds[of, child] >= best.floor[of]]
            if len(mine):
                heapq.heappush(heap, (-float(bounds[mine, child].max()), child, mine))
    return best


def dealt(vectors: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """The vectors by shard, and behind those of each length in a shard all queries of that length."""
    none = F.lit(0).cast("long")
    shard = F.pmod("salt", F.lit(shards)).cast("int").alias("shard")
    candidates = vectors.select(shard, "dim", F.lit(False).alias("asks"), "vec_id", none.alias("query"), none.alias("floor"), "v")
    copies = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "dim", F.lit(True).alias("asks"),
                          "vec_id", "query", "floor", "v")
    return candidates.union(copies).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "asks")


def _meet(vectors: DataFrame, asked: DataFrame, shards: int, k: int, last: bool) -> DataFrame:
    """(query, query_id, vec_id, score): what ``seed``, or at last ``search``, finds for each query in each shard."""
    block = BLOCK_QUERIES

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, tree = None, [], None
        for batch in batches:
            shard, dim, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            new = (shard[1:] != shard[:-1]) | (dim[1:] != dim[:-1]) | (asks[1:] != asks[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            # A query's block ends with its run or batch, so many small runs make small blocks, not wrong ones.
            for lo, hi in ((a, z) for c, e in zip(cuts, cuts[1:]) for a in range(c, e, block) for z in [min(e, a + block)]):
                if place != (shard[lo], dim[lo]):
                    place, held, tree = (shard[lo], dim[lo]), [], None
                ids, query, floor = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (3, 4, 5))
                rows = unpacked(batch.column(6).slice(lo, hi - lo), int(dim[lo]))
                if not asks[lo]:
                    held.append((ids, rows))
                    continue
                if held:
                    tree, held = Tree(*(np.concatenate(x) for x in zip(*held))), []
                if tree is None:  # the shard has no vectors of this length
                    continue
                met = Asked(ids, rows, tree)
                best = search(met, k, floor) if last else seed(met, k)
                found = best.score != _NONE
                of = np.broadcast_to(np.arange(len(ids))[:, None], found.shape)[found]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query[of], ids[of], best.id[found], best.score[found])],
                                                 names=["query", "query_id", "vec_id", "score"])

    return dealt(vectors, asked, shards).mapInArrow(one, "query long, query_id long, vec_id long, score long")


def top_k(df: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates (ids divisible by ``every`` query)."""
    vectors = T.stored(quantised(df, vec_id, vector).withColumn(
        "salt", F.xxhash64("vec_id", "salt", F.spark_partition_id())), "vectors")
    asks = F.col("vec_id") % every == 0
    n, components, queries = vectors.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0)), F.count_if(asks)).first()
    shards = max(1, math.ceil((8 * components + ROW_BYTES * n) / SHARD_BYTES), min(SHARDS, math.ceil(n / SHARD_ROWS)))
    tasks = max(1, math.ceil(queries * shards / ROWS_PER_TASK))  # that copy the queries for the shards
    # Stored, as the queries' numbers aren't the same in another run of their job.
    asked = T.stored(vectors.where(asks).select("dim", "vec_id", "v").dropDuplicates()
                     .withColumn("query", F.monotonically_increasing_id()), "queries")
    # So many from each shard make k in all, and mostly the k best of all leaves that were read.
    few = min(k, math.ceil(2 * k / shards))
    seeds = _meet(vectors, asked.withColumn("floor", F.lit(_NONE)).repartition(tasks), shards, few, last=False)
    w = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = seeds.withColumn("r", F.row_number().over(w)).where(f"r = {k}").select("query", F.col("score").alias("floor"))
    floored = T.stored(asked.join(kth, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE))), "floors")
    found = _meet(vectors, floored.repartition(tasks), shards, k, last=True)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")
            .select("query_id", "rank", "vec_id", "score"))
