"""SimHash near-duplicate groups by a self-join of a binary trie of fingerprints.

Fingerprints: A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, every
3-word shingle (with repeats; fewer words: the whole sequence) is hashed with
XXH64, seed 42, and a bit is 1 if it is set in over half of the hashes.  Null
texts and texts without words have fingerprint zero and are linked like others.

Trie join: distinct fingerprints are the leaves of a binary trie.  The join
goes through pairs of nodes together, adds up the bits in which their paths
differ, and drops a pair as soon as these exceed the error budget.  It begins
below the nodes where linked fingerprints must meet: of budget + 1 parts one is
equal, so each part leads a trie of its own.  Nodes are traversed in tasks, level
by level, on sorted arrays; a task returns a spanning forest of the links it
found, so no link between different texts is lost and copies are never paired
with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import LOWER, Words, documents, materialize, slices, spread, take_worker, text_bytes
from lagloom.llm.components import stars

BITS = 64
SEED = 42
#: Fingerprints of a node that gets a task of its own, and that one task takes at most of one node.
NODE, NODE_MAX = 5_000, 200_000
#: Fingerprints in one task of small nodes, on average.
TASK = 20_000


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprint of every row."""
    words = Words(LOWER[data], offsets)
    size = words.ends - words.starts
    end = np.cumsum(size + 1) - 1  # of each word, when all are joined by one space
    start = end - size
    flat = np.full(int(end[-1]) + 1 if len(end) else 0, 0x20, np.uint8)
    if len(end):
        inside = np.arange(len(flat)) - np.repeat(start - words.starts, size + 1)
        solid = np.ones(len(flat), bool)
        solid[end] = False
        flat[solid] = words.data[inside[solid]]
    flat = flat.tobytes()
    first, n = words.bounds[:-1], words.counts
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
    last = np.minimum(at + shingle - 1, np.repeat(first + n - 1, count))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(start[at].tolist(), end[last].tolist())), np.uint64, len(at))
    return voted(h, count)


def voted(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fingerprint of every row, which has so many of the hashes: bits set in over half of them."""
    out = np.zeros(len(count), np.uint64)
    if len(h):
        some = np.flatnonzero(count)
        begin = (np.cumsum(count) - count)[some]
        lanes = h.view(np.uint8).reshape(-1, 8)
        votes = np.empty((len(some), BITS), np.int64)
        for k in range(8):
            votes[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.unpackbits(lanes[:, k : k + 1], axis=1, bitorder="little"), begin, axis=0, dtype=np.int64)
        out[some] = np.packbits(votes * 2 > count[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(shingle):
    def run(batches):
        take_worker("simhash")
        for batch in batches:
            for x in slices(batch, limit=1 << 20):
                fp = fingerprints_of(*text_bytes(x.column("text")), shingle)
                yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()), "fp": pa.array(fp.view(np.int64))})

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    return spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_fingerprint_batches(shingle), "doc_id long, fp long")


def _root(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _unite(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    while True:
        parent = _root(parent)
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def traverse(leaves: np.ndarray, pairs: list[tuple[int, int, int, int, int]], depth: int, budget: int) -> np.ndarray:
    """Component root (an index) of each of the sorted leaves.

    pairs: start node pairs (a_lo, a_hi, b_lo, b_hi, differing bits) at depth;
    a pair of a node with itself has equal ranges.
    """
    parent = np.arange(len(leaves))
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, np.array(pairs, np.int64).reshape(-1, 5))]
    while todo:
        t, x = todo.pop()
        if len(x) > 400_000:
            todo += [(t, x[: len(x) // 2]), (t, x[len(x) // 2 :])]
            continue
        na, nb = x[:, 1] - x[:, 0], x[:, 3] - x[:, 2]
        small = (na * nb <= 48) | (t >= BITS)
        if small.any():
            y, n = x[small], (na * nb)[small]
            for part in np.array_split(np.arange(len(y)), max(1, int(n.sum() // 4_000_000))):
                z, m = y[part], n[part]
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                width = np.repeat(z[:, 3] - z[:, 2], m)
                i, j = np.repeat(z[:, 0], m) + k // width, np.repeat(z[:, 2], m) + k % width
                near = (np.bitwise_count(leaves[i] ^ leaves[j]) <= budget) & (i != j)
                if near.any():
                    parent = _unite(parent, i[near], j[near])
            x = x[~small]
        if not len(x):
            continue
        if t not in ones:
            ones[t] = np.concatenate([[0], np.cumsum((leaves >> np.uint64(BITS - 1 - t)) & np.uint64(1), dtype=np.int64)])
        c = ones[t]
        a_mid, b_mid = x[:, 1] - (c[x[:, 1]] - c[x[:, 0]]), x[:, 3] - (c[x[:, 3]] - c[x[:, 2]])
        same = x[:, 0] == x[:, 2]
        low = np.stack([x[:, 0], a_mid, x[:, 2], b_mid, x[:, 4]], 1)
        high = np.stack([a_mid, x[:, 1], b_mid, x[:, 3], x[:, 4]], 1)
        one = np.stack([x[:, 0], a_mid, b_mid, x[:, 3], x[:, 4] + 1], 1)
        two = np.stack([a_mid, x[:, 1], x[:, 2], b_mid, x[:, 4] + 1], 1)[~same]
        x = np.concatenate([low, high, one, two])
        todo.append((t + 1, x[(x[:, 0] < x[:, 1]) & (x[:, 2] < x[:, 3]) & (x[:, 4] <= budget)]))
    return _root(parent)


def _prefix(column: str, depth: int):
    return F.shiftrightunsigned(F.col(column), BITS - depth) if depth else F.lit(0).cast("long")


def _join_task(budget):
    """Links within one task: rows (p, q, depth, r) say that leaf r lies below node p or q; the pair of nodes is traversed together."""

    def run(table: pa.Table) -> pa.Table:
        depth = table.column("depth")[0].as_py()
        r = table.column("r").to_numpy().view(np.uint64)
        leaves = np.unique(r)
        node = leaves >> np.uint64(BITS - depth) if depth else np.zeros(len(leaves), np.uint64)
        if table.column("p")[0].as_py() is None:  # many small nodes, each with itself
            edges = np.flatnonzero(np.diff(node, prepend=~node[:1]))
            ends = np.append(edges[1:], len(node))
            several = ends - edges > 1
            pairs = np.stack([edges, ends, edges, ends, np.zeros(len(edges), np.int64)], 1)[several]
        else:
            p, q = (np.uint64(table.column(c)[0].as_py() & (2**64 - 1)) for c in ("p", "q"))
            (a, b), (c, d) = (np.searchsorted(node, [x, x + np.uint64(1)]) for x in (p, q))
            pairs = [(a, b, c, d, int(p ^ q).bit_count())]
        root = traverse(leaves, pairs, depth, budget)
        moved = np.flatnonzero(root != np.arange(len(leaves)))
        part = np.int64(table.column("part")[0].as_py())
        u, v = (_turned(leaves[x], -part).view(np.int64) for x in (moved, root[moved]))
        return pa.table({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return run


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    """The fingerprints with their bits turned left."""
    by = int(by) % BITS
    return x << np.uint64(by) | x >> np.uint64(BITS - by) if by else x


def trie_links(leaves: DataFrame, budget: int = 3) -> DataFrame:
    """Links (u, v), u > v, that connect exactly what fingerprints (column fp, distinct) at up to ``budget`` bits connect.

    Of budget + 1 disjoint parts of two linked fingerprints one is equal.  So
    each part is put first in a trie of its own, and only pairs below one node at
    the part's depth are traversed, with the whole budget: each leaf is sent
    budget + 1 times at any number of leaves.  Small nodes share tasks; a node with
    over ``NODE_MAX`` leaves is opened into its pairs of children within the
    budget, round by round.
    """
    width = BITS // (budget + 1)
    turn = lambda k: F.expr(f"shiftleft(fp, {k}) | shiftrightunsigned(fp, {BITS - k})") if k else F.col("fp")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), turn(k).alias("r")) for k in range(0, width * (budget + 1), width)])).alias("x")
    rows = leaves.select(each).select("x.part", "x.r")
    total = leaves.count()
    tasks = max(1, total // TASK)
    counts = lambda d: rows.groupBy("part", _prefix("r", d).alias("p")).agg(F.count("*").alias("n"))
    # nodes that are not small get tasks of their own; of a third of a task's leaves there are few
    apart = materialize(counts(width).where(F.col("n") > NODE), "nodes")
    small = rows.join(apart.select("part", "p"), (rows.part == apart.part) & (_prefix("r", width) == F.col("p")), "left_anti")
    none = F.lit(None).cast("long")
    sent = small.select("part", none.alias("p"), none.alias("q"), F.lit(width).alias("depth"), F.pmod(F.xxhash64(_prefix("r", width)), F.lit(tasks)).alias("task"), "r")
    pairs, depth = apart.select("part", "p", F.col("p").alias("q"), "n", F.col("n").alias("m")), width
    while True:
        large = (F.col("n") > NODE_MAX) | (F.col("m") > NODE_MAX)
        fits = pairs if depth >= BITS else pairs.where(~large)
        below = fits.select("part", "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("node"))
        mine = rows.withColumn("node", _prefix("r", depth)).join(below, ["part", "node"])
        sent = sent.unionByName(mine.select("part", "p", "q", F.lit(depth).alias("depth"), F.lit(-1).cast("long").alias("task"), "r"))
        if depth >= BITS or (open_ := pairs.where(large)).isEmpty():
            break
        step = min(4, BITS - depth)
        depth += step
        children = counts(depth).withColumn("up", F.shiftrightunsigned("p", step))
        a = children.select("part", F.col("p").alias("p2"), "n", F.col("up").alias("p"))
        b = children.select("part", F.col("p").alias("q2"), F.col("n").alias("m"), F.col("up").alias("q"))
        pairs = open_.select("part", "p", "q").join(a, ["part", "p"]).join(b, ["part", "q"])
        pairs = pairs.where((F.expr("bit_count(p2 ^ q2)") <= budget) & ((F.col("p") != F.col("q")) | (F.col("p2") <= F.col("q2"))))
        pairs = materialize(pairs.select("part", F.col("p2").alias("p"), F.col("q2").alias("q"), "n", "m"), "pairs")
    return sent.groupBy("part", "depth", "p", "q", "task").applyInArrow(_join_task(budget), "u long, v long")


def groups(docs: DataFrame, budget: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id, the smallest doc_id reachable, of every document."""
    prints = materialize(fingerprints(docs, shingle), "prints")
    leaves = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "leaves")
    tree = stars(trie_links(leaves.select("fp"), budget))
    rooted = leaves.join(tree.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = materialize(rooted.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
