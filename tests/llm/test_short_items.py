"""Benchmark items of every length from 1 to 20 words against brute force."""

import random
from itertools import combinations

import pytest

from lagloom.llm import decontaminate

from .test_models import brute_overlap


@pytest.mark.parametrize("n", [9, 10, 11, 12])
def test_masks_leave_a_seed_for_every_allowed_substitution(n):
    most = n - -(-8 * n // 10)
    for k in range(most + 1):
        for gone in combinations(range(n), k):
            assert any(not set(gone) & set(m) for m in decontaminate.short_masks(n))


def test_items_of_1_to_20_words(spark):
    rng = random.Random(6)
    items = [(n, " ".join(f"item{n}x{k}" for k in range(n))) for n in range(1, 21)]
    rows = []
    for n, text in items:
        for k in range(3):
            for gone in combinations(range(n), k):
                part = text.split()
                for g in gone:
                    part[g] = "changed"
                around = ["filler"] * rng.randrange(3)
                rows.append((len(rows), " ".join([*around, *part, *around])))
        words = text.split()
        # at a document's edge the words that it lacks count as substituted in items of 13 words and more
        rows += [(len(rows) + k, " ".join(w)) for k, w in enumerate((words[1:], words[:-1]))] if n < 13 else []
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    want = {(i, k) for i, t in rows for k, q in items if brute_overlap(t, q)}
    assert got == want and len(want) > 200
