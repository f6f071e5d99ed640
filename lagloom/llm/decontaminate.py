"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words that looks at some positions and
ignores the others, so a substituted word there does not hide an overlap.  The
two masks of ``MASKS`` (6 of 9 words) leave at least one seed intact in every
overlap of ``OVERLAP`` (13) words with up to two substitutions, at any places.
Seeds of all documents are joined with those of the benchmark by hash; around
each hit the document is aligned with the whole item, word by word, and counts
as an overlap where ``OVERLAP`` consecutive aligned words have at least
``MATCH`` (11) equal.  Items shorter than that must be there whole: with at
most a fifth of the words substituted from 9 words on (``short_masks`` leaves a
seed intact for every allowed set of substitutions), exactly below 9 (one
contiguous seed for each such length).  As phrases, items of fewer than
``SHORTEST`` words are weak evidence: they are found like others, and the column
item_words tells a caller that wants to leave them aside.

Words: A-Z are lower-cased, ASCII punctuation and white space end a word.

The benchmark is searched in blocks of at most ``BLOCK_WORDS`` words, dealt by
a hash of item and text, and only one block is broadcast at a time: a benchmark of
any size takes more passes, not more memory.  (One longer item is a block of its
own.)  Null and empty texts overlap with nothing; repeated items are each reported.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import LOWER, PUNCTUATION, Words, documents, driver_rows, mix, slices, take_worker, text_bytes, worker_cache

MASKS = ((0, 1, 2, 4, 5, 8), (0, 3, 5, 6, 7, 8))
SPAN = 9
OVERLAP, MATCH = 13, 11
SHORTEST = 5
BLOCK_WORDS = 2_000_000
_FACTORS = np.random.default_rng(97).integers(0, 2**63, OVERLAP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FILTER = 22


def _words(column) -> tuple[Words, np.ndarray]:
    data, offsets = text_bytes(column)
    words = Words(LOWER[data], offsets, PUNCTUATION)
    return words, words.hashes()


def _seeds(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Seed of the mask at every word that has the mask's span after it."""
    n = max(0, len(h) - mask[-1])
    out = np.zeros(n, np.uint64)
    for k in mask:
        out += h[k : k + n] * _FACTORS[k]
    return mix(out)


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks of items of n < OVERLAP words, from the item's first word on.

    One substitution (9 words) spares one of two halves; two (10 to 12 words)
    spare two of four blocks, and each two blocks are a mask.
    """
    if n < SPAN:
        return [tuple(range(n))]
    blocks, spared = (2, 1) if n == SPAN else (4, 2)
    parts = np.array_split(np.arange(n), blocks)
    return [tuple(np.concatenate(c).tolist()) for c in combinations(parts, spared)]


class Index:
    """Seeds of one block of the benchmark."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        words, self.h = _words(pa.array(texts, pa.string()))
        self.ids, self.bounds = pa.array(ids, pa.int64()), words.bounds
        size = words.counts
        self.masks = []
        row = words.row_of()
        for mask, length in [(m, 0) for m in MASKS] + [(m, n) for n in range(1, OVERLAP) for m in short_masks(n)]:
            at = np.arange(max(0, len(self.h) - mask[-1]))
            if length:
                ok = (size[row[: len(at)]] == length) & (at == self.bounds[row[: len(at)]])
            else:
                ok = (at + mask[-1] < self.bounds[1:][row[: len(at)]]) & (size[row[: len(at)]] >= OVERLAP)
            seeds, at = _seeds(self.h, mask)[ok], at[ok]
            if len(at):
                order = np.argsort(seeds, kind="stable")
                bits = min(_FILTER, max(16, len(at).bit_length() + 5))
                may = np.zeros(1 << bits, bool)
                may[seeds >> np.uint64(64 - bits)] = True
                self.masks.append((mask, max(length - 1, mask[-1]), seeds[order], at[order], may, np.uint64(64 - bits)))

    def overlaps(self, words: Words, h: np.ndarray) -> np.ndarray:
        """Rows (text row, item index, equal words, first word, end word): the best stretch for each row and item."""
        found = []
        row_of = words.row_of()
        for mask, reach, seeds, at, may, shift in self.masks:
            mine = _seeds(h, mask)[: max(0, len(h) - reach)]
            hit = np.flatnonzero(may[mine >> shift])
            hit = hit[row_of[hit] == row_of[hit + reach]]
            a, b = np.searchsorted(seeds, mine[hit], "left"), np.searchsorted(seeds, mine[hit], "right")
            n = b - a
            for part in np.array_split(np.arange(len(hit)), 1 + int(n.sum()) // 4_000_000):
                m = n[part]
                place = at[np.repeat(a[part], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                where = np.repeat(hit[part], m)
                item = np.searchsorted(self.bounds, place, "right") - 1
                # the document word that faces the item's first word
                found.append(np.unique(np.stack([row_of[where], item, where - (place - self.bounds[item])], 1), axis=0))
        if not found:
            return np.zeros((0, 5), np.int64)
        lines = np.unique(np.concatenate(found), axis=0)
        size = np.diff(self.bounds)[lines[:, 1]]
        out = [self._align(part, words, h) for part in np.array_split(lines, 1 + int(size.sum()) // 4_000_000)]
        out = np.concatenate(out)
        order = np.lexsort((out[:, 3], -out[:, 2], out[:, 1], out[:, 0]))
        out = out[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:, 0] != out[:-1, 0]) | (out[1:, 1] != out[:-1, 1])
        return out[new]

    def _align(self, lines: np.ndarray, words: Words, h: np.ndarray) -> np.ndarray:
        row, item, line = lines.T
        size = np.diff(self.bounds)[item]
        end = np.cumsum(size)
        k = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
        place = np.repeat(line, size) + k
        inside = (place >= np.repeat(words.bounds[row], size)) & (place < np.repeat(words.bounds[row + 1], size))
        equal = np.zeros(len(k), np.int64)
        equal[inside] = h[place[inside]] == self.h[(np.repeat(self.bounds[item], size) + k)[inside]]
        total = np.concatenate([[0], np.cumsum(equal)])
        width = np.repeat(np.minimum(size, OVERLAP), size)
        need = np.where(width >= OVERLAP, MATCH, np.where(width >= SPAN, np.ceil(0.8 * width), width))
        full = k + width <= np.repeat(size, size)
        start = np.flatnonzero(full)
        good = start[total[start + width[start]] - total[start] >= need[start]]
        covered = np.zeros(len(k) + 1, np.int64)
        np.add.at(covered, good, 1)
        np.add.at(covered, good + width[good], -1)
        covered = (np.cumsum(covered)[:-1] > 0) & inside
        which = np.repeat(np.arange(len(lines)), size)
        hits = np.bincount(which, covered & (equal > 0), len(lines)).astype(np.int64)
        some = np.flatnonzero(hits)
        spots = np.flatnonzero(covered)
        first = spots[np.searchsorted(spots, (end - size)[some])]
        last = spots[np.searchsorted(spots, end[some]) - 1]
        base = words.bounds[row[some]]
        return np.stack([row[some], item[some], hits[some], place[first] - base, place[last] + 1 - base], 1)


@worker_cache()
def _index(ids: tuple, texts: tuple) -> Index:
    return Index(list(ids), list(texts))


def _search(shared):
    def run(batches):
        take_worker("decontaminate")
        index = _index(*shared.value)
        size = np.diff(index.bounds).astype(np.int64)
        for batch in batches:
            for x in slices(batch, limit=1 << 20):
                words, h = _words(x.column("text"))
                row, item, equal, first, end = index.overlaps(words, h).T
                yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()).take(pa.array(row)), "item_id": index.ids.take(pa.array(item)), "n_equal": pa.array(equal), "first_word": pa.array(first), "end_word": pa.array(end), "item_words": pa.array(size[item])})

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that overlap: doc_id, item_id, n_equal, first_word, end_word, item_words."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (4 * BLOCK_WORDS)
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        rows = sorted(driver_rows(block, 16 * BLOCK_WORDS, "a block of the benchmark"), key=lambda r: (r.item_id is not None, r.item_id or 0, r.text))
        shared = docs.sparkSession.sparkContext.broadcast((tuple(r.item_id for r in rows), tuple(r.text for r in rows)))
        found = docs.mapInArrow(_search(shared), "doc_id long, item_id long, n_equal long, first_word long, end_word long, item_words long")
        out = found if out is None else out.unionByName(found)
    return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
