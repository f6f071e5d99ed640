"""Operators 8 and 10 against brute force."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lagloom.llm import ball_tree, sharding

from .conftest import ODD


def brute_top(rows, k=10, every=100):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in good if i % every == 0}:
        scored = sorted((-int(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("shard,queries,scale", [(16_384, 4_096, 1.0), (50, 3, 1.0), (64, 2, 3000.0)])
def test_top_k(spark, monkeypatch, shard, queries, scale):
    monkeypatch.setattr(ball_tree, "SHARD", shard)
    monkeypatch.setattr(ball_tree, "QUERIES", queries)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 6) * scale / 7 if i % 3 else rng.normal(size=6)).astype(np.float32).tolist()) for i in range(-100, 600)]
    rows += [(1000, None), (1100, [float("nan")] * 6), (1200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1300, [float("inf")] * 6), (1401, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id")
    assert sorted(tuple(r) for r in ball_tree.top_k(df).collect()) == brute_top(rows)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ball_tree.top_k(df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert ball_tree.top_k(df.limit(0)).count() == 0


def test_odd_vectors(spark):
    """Shorter vectors, repeated ids with unlike vectors, very large components, and a column with a clashing name."""
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [-1.0, 0.5]), (1, [3.0]), (2, []), (3, [1e300, 1.0]), (100, [-1e300, -1.0]), (5, [0.5, 0.5]), (5, [2.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 7) for i, v in rows], "vec_id long, embedding array<double>, score int, rank int")
    clip = lambda v: [max(-(2**53), min(2**53, math.floor(1024 * x) if abs(x) < 1e200 else int(math.copysign(2**53, x)))) for x in v]
    dot = lambda a, b: max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(a, b))))
    want = []
    for q in (0, 100):
        mine = {tuple(v) for i, v in rows if i == q}
        scored = sorted((-dot(clip(a), clip(b)), i) for a in mine for i, b in rows if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in ball_tree.top_k(df).collect()) == sorted(want)


def test_shards(odd, none, docs, texts):
    for df, rows in ((odd, ODD), (docs, list(texts.items()))):
        got = sharding.shard(df).collect()
        assert len(got) == len(rows)
        slots, homes = defaultdict(list), defaultdict(set)
        by = defaultdict(list)
        for i, t in rows:
            by[i].append((t or "").encode())
        for r in got:
            assert (r.size, r.text_crc32) in {(len(t) + 16, zlib.crc32(t)) for t in by[r.doc_id]}
            assert 0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None
            slots[r.shard].append(r.slot)
            homes[r.size, r.text_crc32].add(r.shard)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert all(len(v) == 1 for v in homes.values())
    assert sharding.shard(none).count() == 0


def test_sizes_are_near_equal(spark):
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.1").groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 40 and max(sizes) < 1.02 * min(sizes)


def test_packing_uses_all_three_sizes():
    rng = np.random.default_rng(3)
    sizes = rng.lognormal(0, 1, (4000, 3))
    to = sharding.pack(sizes, 10)
    loads = np.stack([np.bincount(to, sizes[:, k], 10) for k in range(3)])
    assert (loads.max(1) < 1.05 * loads.mean(1)).all()


def test_packing_against_plain_loops():
    rng = np.random.default_rng(4)
    sizes = np.round(rng.lognormal(3, 1, (300, 3)))
    sizes[7] = sizes[8] = 0
    total = [sum(s[k] for s in sizes.tolist()) for k in range(3)]
    share = [[s[k] / total[k] for k in range(3)] for s in sizes.tolist()]
    left, want = [[1 / 7] * 3 for _ in range(7)], [0] * 300
    for i in sorted(range(300), key=lambda i: (-max(share[i]), i)):
        fit = [sum(a * b for a, b in zip(r, share[i])) for r in left]
        want[i] = max(range(7), key=lambda j: (fit[j], -j))
        left[want[i]] = [a - b for a, b in zip(left[want[i]], share[i])]
    assert sharding.pack(sizes, 7).tolist() == want


def test_units_grow_with_the_rows(spark, monkeypatch):
    """More rows than fit small units: slots stay whole."""
    monkeypatch.setattr(sharding, "UNIT", 2)
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(2000)], "doc_id long, text string")
    got = sharding.shard(df, shards=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 2000 and all(sorted(v) == list(range(len(v))) for v in slots.values())
