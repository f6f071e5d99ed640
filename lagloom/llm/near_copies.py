"""Operator 5 on 5-word shingles: components of texts whose sets of shingles have a Jaccard similarity of at least 0.8.

A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words
has its whole sequence as one shingle, texts without words are equal.  Texts
with equal sets are one node.

The SimHash trie (``simhash_trie.trie_links``) comes first: nodes whose 64-bit
fingerprints of shingle hashes are linked at three bits are candidates, as a
forest, so dense groups join without a pair for every two members.  The trie
alone is not whole: the fingerprints of a pair at 0.8 differ in ten bits on
average, and no error budget is both selective and complete.  So MinHash
completes it: candidates share one of ``BANDS`` keys of ``ROWS`` values each; a pair
at 0.8 has none in common with probability (1 - 0.8**4)**24 = 3e-6, a more
similar pair with less.

Every link is verified by the exact Jaccard of the sets.  With the forest each
node is held against the least node of its keys and the one with most company,
the hub.  What may still be linked in different components is found by edits:
the members x of a hub's keys are seen as their differences e(x) from the hub's
set, as x and y differ in as many shingles as e(x) and e(y) do.  A Jaccard of
0.8 is at most (|x| + |y|) / 9 differing shingles, so with
f(x) = 9 |e(x)| - |x| a pair is linked if and only if 18 |e(x) & e(y)| >=
f(x) + f(y).  A node that is not linked to the hub p has f > |p|, and no f
is below -|p|: such a pair has an edit in common, and the first one in an order
from rare to frequent leaves so many behind it, in both, that the sum can be reached.
Only pairs that share such an edit are verified.  No pair is left out for the
size of its group, and none by chance at this step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.llm.common import LOWER, Words, if_few, materialize, mix, slices, spread, take_worker, text_bytes
from lagloom.llm.components import stars
from lagloom.llm.simhash_trie import trie_links, voted

SHINGLE = 5
#: Bits that may differ in linked fingerprints.
BUDGET = 3
BANDS, ROWS = 24, 4
#: Pairs of one pivot that travel together.
PIVOT_ROWS = 500
_rng = np.random.default_rng(811)
_FACTORS = _rng.integers(0, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LINES = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_rng.bit_generator.advance(512)  # the keys are those of earlier versions, which drew more
_SHIFTS = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
#: Jaccard >= 0.8 of sets a and b with so many shingles in common.
SIMILAR = "9L * size(array_intersect(a, b)) >= 4L * (size(a) + size(b))"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's distinct shingles in order, and each row's bounds."""
    words = Words(LOWER[data], offsets)
    w, n = words.hashes(), words.counts
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(words.rows), count)
    at = np.repeat(words.bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    size = np.minimum(n, SHINGLE)[row]
    h = size.astype(np.uint64) * _FACTORS[SHINGLE]
    for k in range(SHINGLE):
        there = size > k
        h[there] += w[at[there] + k] * _FACTORS[k]
    h = mix(h)
    order = np.lexsort((h, row))
    h = h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[first], np.searchsorted(row[first], np.arange(words.rows + 1))


def _nodes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node of every row (a hash of its set; no shingles: 0) and the rows that have shingles."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros(len(bounds) - 1, np.uint64)
    if len(some):
        out[some] = mix(np.add.reduceat(mix(h + _FACTORS[0]), bounds[some]))
    return out, some


def _least(h: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """MinHash value k of the rows (with shingles) that begin there."""
    return np.minimum.reduceat(h * _LINES[k] + _SHIFTS[k], begin)


def _keys(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Keys of the rows, a column a band."""
    out = np.zeros((len(begin), BANDS), np.uint64)
    if len(begin):
        for band in range(BANDS):
            key = np.full(len(begin), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = mix(key + _least(h, begin, k))
            out[:, band] = key
    return out


def _print_batches(batches):
    take_worker("near_copies")
    for batch in batches:
        for x in slices(batch, limit=1 << 20):
            h, bounds = shingle_sets(*text_bytes(x.column("text")))
            node, some = _nodes(h, bounds)
            ends = np.zeros(len(node) + 1, np.int32)
            ends[some + 1] = BANDS
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(_keys(h, bounds[some]).ravel().view(np.int64)))
            fp = voted(h, np.diff(bounds))
            yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()), "text_key": x.column("text_key"), "node": pa.array(node.view(np.int64)), "fp": pa.array(fp.view(np.int64)), "keys": keys})


def _set_batches(batches):
    take_worker("near_copies")
    for batch in batches:
        for x in slices(batch, limit=1 << 20):
            h, bounds = shingle_sets(*text_bytes(x.column("text")))
            node, _ = _nodes(h, bounds)
            yield pa.record_batch({"node": pa.array(node.view(np.int64)), "shingles": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))})


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))


def _one_text(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """A text of each node; the other texts are not shuffled if the nodes are few."""
    reps = prints.select("node", "text_key").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text_key").alias("text_key"))
    keys = materialize(reps.select("text_key"), "text-keys")
    return _texts(docs).select("text_key", "text").join(if_few(keys), "text_key", "left_semi").dropDuplicates(["text_key"])


def _with_sets(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored pairs (u, v) with the sets a of u and b of v."""
    needed = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
    sets = materialize(_one_text(docs, prints, needed).mapInArrow(_set_batches, "node long, shingles array<long>"), "sets")
    # a pivot of many pairs is sent in so many copies that no task gets all of its pairs
    many = materialize(pairs.groupBy("v").count().where(F.col("count") > PIVOT_ROWS).select("v", F.expr(f"count div {PIVOT_ROWS}").alias("parts")), "many")
    part = F.expr("pmod(hash(u), coalesce(parts, 0) + 1)")
    pairs = pairs.join(F.broadcast(many), "v", "left").select(*pairs.columns, part.alias("part"))
    right = sets.join(F.broadcast(many.withColumnRenamed("v", "node")), "node", "left").select(F.col("node").alias("v"), F.col("shingles").alias("b"), F.explode(F.expr("sequence(0L, coalesce(parts, 0L))")).alias("part"))
    return pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(right, ["v", "part"])


def _verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """The similar ones of the pairs (u, v) as links, u > v."""
    both = _with_sets(docs, prints, materialize(pairs.distinct(), "pairs"))
    return materialize(both.where(SIMILAR).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")


def _by_edits(docs: DataFrame, prints: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (u, v) of a hub's members (hub, node, root; the hub is one, and held against all) that may be linked and have different roots."""
    members = members.select("hub", "node", "root").distinct()
    hubs = members.where("node = hub").select("hub", F.col("root").alias("hub_root"))
    pairs = materialize(members.where("node <> hub").join(hubs, "hub").select(F.col("node").alias("u"), F.col("hub").alias("v"), "root", F.expr("root <> hub_root").alias("out")), "hub-pairs")
    edits = _with_sets(docs, prints, pairs).select(F.col("v").alias("hub"), F.col("u").alias("node"), "root", "out", F.expr("size(a)").alias("n"), F.expr("array_union(array_except(a, b), array_except(b, a))").alias("edits"))
    edits = materialize(edits.withColumn("f", F.expr("9L * size(edits) - n")).drop("n").repartition("hub", "node"), "edits")
    least = materialize(edits.groupBy("hub").agg(F.min("f").alias("least"), F.min(F.expr("if(out, f, null)")).alias("least_out")), "least")
    rows = edits.join(if_few(least), "hub").select("hub", "node", "root", "out", "f", "least", "least_out", F.explode("edits").alias("edit"))
    # an edit within one component is shared by no pair that matters; what is left of a row counts from the frequent end
    same = Window.partitionBy("hub", "edit")
    rows = rows.withColumn("n", F.count("*").over(same)).withColumn("low", F.min("root").over(same)).withColumn("high", F.max("root").over(same)).where("low < high")
    rows = rows.withColumn("left", F.row_number().over(Window.partitionBy("hub", "node").orderBy(F.desc("n"), F.desc("edit"))))
    rows = materialize(rows.where("18L * left >= f + if(out, least, least_out)").select("hub", "edit", "node", "root", "out", "f", "left", F.expr("18L * left >= f + least_out").alias("short")), "shared")
    other = rows.where("short").select("hub", "edit", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "out", "f", "left")])
    found = rows.where("out").join(other, ["hub", "edit"]).where("root <> root2 and (not out2 or node > node2) and 18L * least(left, left2) >= f + f2")
    return found.select(F.greatest("node", "node2").alias("u"), F.least("node", "node2").alias("v")).distinct()


def _forest(prints: DataFrame) -> DataFrame:
    """Pairs of nodes (u, v): each with the first of its fingerprint, and those of linked fingerprints."""
    nodes = prints.where("node <> 0").select("node", "fp").distinct()
    first = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "leaves")
    same = nodes.join(first, "fp").select(F.col("node").alias("u"), F.col("first").alias("v"))
    links = trie_links(first.select("fp"), BUDGET)
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "uv"]
    near = links.join(ends[0], "u").join(ends[1], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return same.unionByName(near).where("u <> v")


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (XXH64 of the text) and group of every row; rows of a group are linked by similar pairs."""
    prints = materialize(spread(_texts(docs)).mapInArrow(_print_batches, "doc_id long, text_key long, node long, fp long, keys array<long>"), "prints")
    rows = prints.select("node", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key", "low")
    members = materialize(rows.join(shared, "key").distinct(), "members")
    company = members.join(members.groupBy("key").count(), "key").groupBy("node").agg(F.sum("count").alias("company"))
    hubs = members.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    members = materialize(members.join(hubs, "key"), "members")
    pairs = members.select(F.col("node").alias("u"), F.explode(F.array("low", "hub")).alias("v")).where("u <> v")
    tree = stars(_verified(docs, prints, pairs.unionByName(_forest(prints))))
    named = members.join(tree.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = named.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    cross = materialize(_by_edits(docs, prints, materialize(named.join(apart, "key").select("hub", "node", "root"), "open")), "cross")
    if not cross.isEmpty():
        tree = stars(tree.select("u", "v").unionByName(_verified(docs, prints, cross)))
    return prints.join(tree.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("group"))
