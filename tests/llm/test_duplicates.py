"""Operators 3 and 5 against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from lagloom.llm import simhash_trie, substring_dedup
from lagloom.llm.components import stars

from .conftest import ODD


def brute_repeats(rows):
    """rows: (doc_id, text) in order."""
    seen, out = set(), []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            if key in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(key)
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_repeats_on_odd_rows(odd, none):
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd).collect()]
    assert sorted(got, key=str) == sorted(brute_repeats(ordered(ODD)), key=str)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_repeats_on_planted_passages(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PAGE_BYTES", 3000)
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 25, 60, 200)] + [["a"] * 50, ["a", "b"] * 30]
    rows = []
    for i in range(150):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in substring_dedup.remove_repeats(df).collect()]
    want = brute_repeats(rows)
    assert sum(r[2] for r in want) > 1000
    assert sorted(got) == sorted(want)


def test_rewriting_carries_columns(odd):
    out = substring_dedup.remove_repeats(odd, rewrite=True)
    assert out.schema.names == odd.schema.names
    by = {r.doc_id: r for r in out.collect()}
    assert by[4].text == dict(ODD)[4] and by[5].text == "" and by[5].score == 1.5


def test_every_window_shares_its_symbols():
    """Copies of a window in different surroundings have the same cuts of round 2 where the method says so, and one between the 7th and the 13th word."""
    rng = np.random.default_rng(0)
    for _ in range(300):
        window = rng.integers(1, 7, 20).astype(np.uint64)
        found = []
        for _ in range(2):
            a, b = rng.integers(1, 7, rng.integers(0, 12)).astype(np.uint64), rng.integers(1, 7, 12).astype(np.uint64)
            names = np.concatenate([a, window, b])
            opens = np.zeros(len(names) + 1, bool)
            opens[[0, -1]] = True
            at = np.arange(len(names))
            for level in (1, 2):
                first = substring_dedup.joined(names, at, opens, level)
                names, at = substring_dedup.merge(names, at, first, names[first] * np.uint64(1000) + names[first + 1])
            found.append({k: v for k, v in zip((at - len(a)).tolist(), names.tolist())})
        stable = [{k for k in f if 3 <= k <= 17} for f in found]
        assert stable[0] == stable[1] and any(7 <= k <= 13 for k in stable[0])
        inner = sorted(stable[0])[:-1]
        assert all(found[0][k] == found[1][k] for k in inner)


def test_words_that_polynomials_confuse(spark):
    """Two words of 1,024 letters, each the other with a and b exchanged, as Thue and Morse order them: nothing is repeated."""
    signs = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs)
    around = [f"w{k}" for k in range(19)]
    rows = [(1, " ".join([*around[:9], one, *around[9:]])), (2, " ".join([*around[:9], two, *around[9:]]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}


def test_rows_between_rounds_follow_names():
    """A page sends no more blocks than it has contents, at any number of buckets."""
    x, y = np.sort(np.random.default_rng(1).integers(0, 2**64, (2, 30), dtype=np.uint64))
    for bits in (1, 5, 40):
        blocks = substring_dedup._blocks(7, x, y, np.zeros(30, bool), 64 - bits)
        assert blocks.num_rows <= min(30, 2**bits)
        assert np.array_equal(np.concatenate([substring_dedup._unplanes(b.as_py()) for b in blocks.column("y")]), y)


def test_pages_are_in_order_and_in_the_bucket_of_their_range(spark):
    numbers = [substring_dedup.page_number(part, n, 24) for part in range(24) for n in range(1, 5)]
    assert numbers == sorted(set(numbers))
    got = spark.createDataFrame([(p,) for p in numbers], "page long").selectExpr("pmod(hash(page), 24) AS b").collect()
    assert [r.b for r in got] == [part for part in range(24) for _ in range(4)]


def brute_fingerprint(text):
    b = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())
    w = b.split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def components(values, linked):
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {v: root(v) for v in values}


def test_groups(odd, none, docs, texts):
    got = {r.doc_id: r for r in simhash_trie.groups(docs).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    want = components(ids, [(a, b) for n, a in enumerate(ids) for b in ids[:n] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {i: (r.fp % 2**64, r.component_id) for i, r in got.items()} == {i: (prints[i], want[i]) for i in ids}
    rows = simhash_trie.groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == by[0] == 0 and by[5] == by[6] == 4
    assert simhash_trie.groups(none).count() == 0


@pytest.mark.parametrize("node,most,task", [(4, 30, 50), (1000, 200_000, 1_000_000), (1, 3, 10_000)])
def test_trie_loses_no_link(spark, monkeypatch, node, most, task):
    monkeypatch.setattr(simhash_trie, "NODE", node)
    monkeypatch.setattr(simhash_trie, "NODE_MAX", most)
    monkeypatch.setattr(simhash_trie, "TASK", task)
    rng = np.random.default_rng(1)
    values = set()
    for base in rng.integers(0, 2**64, 25, dtype=np.uint64).tolist():
        for _ in range(30):
            y = base
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                y ^= 1 << int(k)
            values.add(y)
    signed = {int(np.uint64(v).view(np.int64)): v for v in values}
    tree = simhash_trie.stars(simhash_trie.trie_links(spark.createDataFrame([(s,) for s in signed], "fp long"), 3)).collect()
    got = {s: s for s in signed} | {r.u: r.v for r in tree}
    order = sorted(signed)
    want = components(order, [(a, b) for n, a in enumerate(order) for b in order[:n] if (signed[a] ^ signed[b]).bit_count() <= 3])
    assert got == want


def test_stars_on_a_path_and_a_hub(spark):
    links = [(k + 1, k) for k in range(60)] + [(1000 + k, 500) for k in range(1, 80)]
    got = {r.u: r.v for r in stars(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {1000 + k: 500 for k in range(1, 80)}
