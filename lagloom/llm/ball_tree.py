"""Exact top-k inner-product search by ball trees, branch and bound.

Components become floor(1024 * x).  Rows are dealt into shards of about
``SHARD`` vectors by a hash of their id; each shard is searched through a ball
tree of its own, which is built once and kept.  A node with centre c and radius r
holds no vector with an inner product above <q, c> + |q| r; for every query the
child with the higher bound is visited first, and a node is left out once its
bound is below the query's current kth score.  The current kth score is shared
between shards: a first pass searches one shard for every query, all shards
start from the kth score found there, and a task that goes through several trees
takes it from one to the next.

The table is shuffled once, into trees.  Queries pass it in blocks of
``QUERIES``, which are broadcast (a bounded number of vectors), so a block costs
one pass over the trees and no shuffle of the table.

Ties go to the smaller id.  Vectors that are null or hold a null or a non-finite
component take no part; shorter vectors count as if filled up with zeros; rows
that share a query's id are not its candidates, equal (id, vector) rows are one
query, and unlike vectors under one id answer it together.  Other columns are
ignored.  Components beyond 2**53 in size are taken as 2**53, and scores beyond
64 bits as the largest or smallest 64-bit number.
"""

from __future__ import annotations

import functools
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagloom.llm.common import driver_rows, materialize

SCALE, SHARD, QUERIES, LEAF, TOP = 1024, 16_384, 16_384, 64, 10
#: Vectors of a shard where there are fewer shards than cores.
LEAST_SHARD = 2_048
MOST = 2.0**53
LOWEST = np.iinfo(np.int64).min


def _valid(batches):
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
            v = v.values
            if i is None or v is None or v.null_count:
                continue
            x = v.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                ids.append(i)
                vectors.append(np.clip(np.floor(SCALE * x), -MOST, MOST).astype("<i8").tobytes())
        yield pa.record_batch({"vec_id": pa.array(ids, pa.int64()), "v": pa.array(vectors, pa.binary())})


def _matrix(column, width: int) -> np.ndarray:
    raw = [v.as_py() for v in column]
    if all(len(v) == 8 * width for v in raw):
        return np.frombuffer(b"".join(raw), "<i8").reshape(len(raw), width)
    out = np.zeros((len(raw), width), np.int64)
    for k, v in enumerate(raw):
        x = np.frombuffer(v, "<i8")
        out[k, : len(x)] = x
    return out


class BallTree:
    """Centres and radii of a tree over the rows of x, which are reordered so that every node is a range."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        f, perm = x.astype(np.float64), np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # lo, hi, left, right
        centres, radii, todo = [], [], [(0, len(ids), -1, False)]
        while todo:
            lo, hi, parent, right = todo.pop()
            rows = f[perm[lo:hi]]
            c = rows.mean(0)
            far = np.sqrt(((rows - c) ** 2).sum(1))
            k = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            centres.append(c)
            radii.append(far.max() * (1 + 1e-9) + 1e-6)
            if parent >= 0:
                a, b, u, v = self.nodes[parent]
                self.nodes[parent] = (a, b, u, k) if right else (a, b, k, v)
            if hi - lo > LEAF and radii[-1] > 1e-5:
                a = rows[far.argmax()]
                b = rows[((rows - a) ** 2).sum(1).argmax()]
                side = rows @ (b - a)
                mid = (hi - lo) // 2
                part = np.argpartition(side, mid)
                perm[lo:hi] = perm[lo:hi][part]
                todo += [(lo + mid, hi, k, True), (lo, lo + mid, k, False)]
        for lo, hi, left, _ in self.nodes:
            if left < 0:
                perm[lo:hi].sort()  # ids ascend in a leaf
        self.ids, self.x = ids[perm], x[perm]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def pack(self) -> bytes:
        return pickle.dumps((self.nodes, self.ids, self.x, self.centres, self.radii))

    @classmethod
    def unpack(cls, content: bytes) -> BallTree:
        tree = cls.__new__(cls)
        tree.nodes, tree.ids, tree.x, tree.centres, tree.radii = pickle.loads(content)
        return tree

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), each (queries, k), of the best that reach ``floor``; empty places score LOWEST."""
        qf = q.astype(np.float64)
        norm = np.sqrt((qf**2).sum(1)) * (1 + 1e-9)
        best, who = np.full((len(q), k), LOWEST), np.full((len(q), k), np.iinfo(np.int64).max)
        kth = floor.copy()
        f = self.x.astype(np.float64)
        most = float(np.abs(qf).max(initial=0)) * float(np.abs(f).max(initial=0)) * max(1, q.shape[1])

        def scores(rows, lo, hi):
            if most < 2**53:
                return (qf[rows] @ f[lo:hi].T).astype(np.int64)
            if most < 2**62:
                return q[rows] @ self.x[lo:hi].T
            return np.clip(q[rows].astype(object) @ self.x[lo:hi].T.astype(object), LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)

        def leaf(node, rows):
            lo, hi = self.nodes[node][:2]
            score = scores(rows, lo, hi)
            score[q_ids[rows][:, None] == self.ids[None, lo:hi]] = LOWEST
            hit = (score >= kth[rows][:, None]) & (score > LOWEST)
            better = hit.any(1)
            rows, score = rows[better], np.where(hit[better], score[better], LOWEST)
            if not len(rows):
                return
            best[rows], who[rows] = best_of(best[rows], who[rows], score, np.where(score > LOWEST, self.ids[None, lo:hi], np.iinfo(np.int64).max), k)
            kth[rows] = np.maximum(kth[rows], best[rows, -1])

        def bound(node, rows):
            return qf[rows] @ self.centres[node] + norm[rows] * self.radii[node]

        def visit(node, rows):
            b = bound(node, rows)
            rows = rows[b + np.abs(b) * 1e-9 + 1 >= kth[rows]]
            if not len(rows):
                return
            _, _, left, right = self.nodes[node]
            if left < 0:
                leaf(node, rows)
                return
            prefer = bound(left, rows) >= bound(right, rows)
            visit(left, rows[prefer])
            visit(right, rows)
            visit(left, rows[~prefer])

        visit(0, np.arange(len(q)))
        return best, who


def best_of(s: np.ndarray, i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists of (score, id) a row, ties to the smaller id."""
    s, i = np.concatenate([s, score], 1), np.concatenate([i, ids], 1)
    by_id = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, by_id, 1), np.take_along_axis(i, by_id, 1)
    top = np.argsort(-np.maximum(s, LOWEST + 1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)


def _build(width):
    def run(table: pa.Table) -> pa.Table:
        tree = BallTree(table.column("vec_id").to_numpy(), _matrix(table.column("v"), width))
        return pa.table({"shard": table.column("shard").slice(0, 1), "tree": pa.array([tree.pack()], pa.binary())})

    return run


HITS = "q long, query_id long, vec_id long, score long"


def _hits(rows: np.ndarray, q_ids: np.ndarray, best: np.ndarray, who: np.ndarray) -> dict[str, pa.Array]:
    at, col = np.nonzero(best > LOWEST)
    return {"q": pa.array(rows[at]), "query_id": pa.array(q_ids[at]), "vec_id": pa.array(who[at, col]), "score": pa.array(best[at, col])}


def _pilot(width, k):
    """The queries of one shard against its tree."""

    def run(asked: pa.Table, kept: pa.Table) -> pa.Table:
        q_ids, rows = (asked.column(c).to_numpy().astype(np.int64) for c in ("vec_id", "q"))
        best, who = np.full((len(rows), k), LOWEST), np.full((len(rows), k), np.iinfo(np.int64).max)
        if kept.num_rows and len(rows):
            best, who = BallTree.unpack(kept.column("tree")[0].as_py()).search(q_ids, _matrix(asked.column("v"), width), k, np.full(len(rows), LOWEST))
        return pa.table(_hits(rows, q_ids, best, who))

    return run


def _search(shared, k):
    """A block of queries against all trees of the task; the kth score goes from tree to tree."""

    def run(batches):
        rows, q_ids, q, floor = shared.value
        kth = floor.copy()
        best, who = np.full((len(rows), k), LOWEST), np.full((len(rows), k), np.iinfo(np.int64).max)
        for batch in batches:
            for tree in batch.column("tree"):
                found, ids = BallTree.unpack(tree.as_py()).search(q_ids, q, k, kth)
                best, who = best_of(best, who, found, ids, k)
                kth = np.maximum(kth, best[:, -1])
        yield pa.record_batch(_hits(rows, q_ids, best, who))

    return run


def top_k(vectors: DataFrame, k: int = TOP, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for every row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialize(rows.mapInArrow(_valid, "vec_id long, v binary"), "vectors")
    size = rows.agg(F.count("*"), F.max(F.octet_length("v")), F.count(F.when(F.col("vec_id") % every == 0, 1))).first()
    shards = max(1, -(-size[0] // SHARD), min(spark.sparkContext.defaultParallelism, size[0] // LEAST_SHARD))
    width, blocks = max(1, (size[1] or 0) // 8), max(1, -(-size[2] // QUERIES))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    trees = materialize(dealt.groupBy("shard").applyInArrow(_build(width), "shard long, tree binary"), "trees")
    # a query is known by a hash of id and vector, and belongs to one block and one first shard
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("q", F.xxhash64("vec_id", "v", F.lit(1)))
    queries = queries.withColumn("shard", F.pmod("q", F.lit(shards))).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)))
    first = queries.groupBy("shard").cogroup(trees.groupBy("shard")).applyInArrow(_pilot(width, k), HITS)
    # the kth score of those that have k hits
    floor = first.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("q", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    ready = materialize(queries.join(floor, "q", "left").select("block", "q", "vec_id", "v", F.coalesce("least", F.lit(LOWEST)).alias("floor")), "queries")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    parts = []
    for b in range(blocks):
        asked = sorted(driver_rows(ready.where(F.col("block") == b), 4 * QUERIES, "a block of queries"), key=lambda r: (r.vec_id, r.q))
        ids, q, floors = (np.array([r[c] for r in asked], np.int64) for c in ("vec_id", "q", "floor"))
        block = (q, ids, _matrix(pa.array([bytes(r.v) for r in asked], pa.binary()), width), floors)
        shared = spark.sparkContext.broadcast(block)
        found = trees.select("tree").mapInArrow(_search(shared, k), HITS)
        if blocks == 1:
            return best(found)
        parts.append(materialize(found, "hits"))  # so that a block leaves the driver before the next one comes
        shared.destroy()
    return best(functools.reduce(DataFrame.unionByName, parts))


def op8_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
