"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, pairs of neighbours and pairs with one
word between (``BUCKETS`` hash buckets; A-Z lower-cased, ASCII punctuation ends
a word), and a bias.  Training goes through a sample document by document:
per-coordinate learning rates, and an L1 term that keeps most weights at zero,
so the model that is broadcast is the list of the non-zero ones.

Labels are read only from rows whose crc32(doc_id) mod 4 is not 2.  The sample
is bounded: about ``TRAIN`` labelled documents, chosen by a threshold on a hash
of doc_id that follows the number of labels, of which so many are used, by
ascending hash, as have ``TRAIN_BYTES`` of text together (the first in any case).  A doc_id with several labels
counts as toxic if one of them says so, and a doc_id with several texts gives
its smallest one to training; null labels are ignored; without any label all
scores are (next to) 0.  Null and empty texts are scored by the bias alone.
Columns of the rows to score that are named like the results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import LOWER, PUNCTUATION, Words, documents, driver_rows, held_out, materialize, mix, slices, spread, take_worker, text_bytes

BUCKETS = 1 << 20
TRAIN, TRAIN_BYTES = 8_000, 32 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 1.0, 5
THRESHOLD = 0.3
BIAS = BUCKETS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip-pair, repeats included."""
    words = Words(LOWER[data], offsets, PUNCTUATION)
    h, row = words.hashes(), words.row_of()
    rows, buckets = [row], [h]
    for gap, salt in ((1, 0x8CB92BA72F3D8DD7), (2, 0xABCFBFB5C92D5F21)):
        ok = row[gap:] == row[:-gap]
        rows.append(row[gap:][ok])
        buckets.append(mix((h[:-gap] * np.uint64(salt) + h[gap:])[ok]))
    return np.concatenate(rows), (np.concatenate(buckets) >> np.uint64(44)).astype(np.int64)


def train(rows: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and their weights, from (distinct buckets, label) in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(x):
        zx = z[x]
        w = -(zx - np.sign(zx) * L1) / ((BETA + np.sqrt(n[x])) / ALPHA + L2)
        free = x == BIAS  # the bias is not shrunk
        w[free] = -zx[free] / ((BETA + np.sqrt(n[x][free])) / ALPHA)
        w[(np.abs(zx) <= L1) & ~free] = 0
        return w

    for _ in range(EPOCHS):
        for x, label in rows:
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            sigma = (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA
            z[x] += g - sigma * w
            n[x] += g * g
    w = weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def _feature_rows(batches):
    take_worker("toxicity")
    for batch in batches:
        for x in slices(batch, limit=1 << 20):
            row, bucket = features(*text_bytes(x.column("text")))
            pairs = np.unique(row * (BUCKETS + 1) + bucket)
            at = np.searchsorted(pairs // (BUCKETS + 1), np.arange(x.num_rows + 1))
            found = (pairs % (BUCKETS + 1)).astype("<i4")
            yield pa.record_batch({"h": x.column("h"), "toxic": x.column("toxic"), "x": pa.array([found[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())})


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    h = F.xxhash64("doc_id", F.lit(7))
    # the labels that are kept are about TRAIN, at any number of labels
    share = min(1.0, TRAIN / max(1, total))
    picked = known.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "toxic", h.alias("h"))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    once = materialize(texts.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    sizes = sorted(driver_rows(once.select("h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")), 4 * TRAIN, "labelled sample"), key=lambda r: r.h)
    used = np.cumsum([r.n for r in sizes]) <= TRAIN_BYTES
    last = sizes[max(1, int(used.sum())) - 1].h if sizes else 0
    rows = once.where(F.col("h") <= last).mapInArrow(_feature_rows, "h long, toxic int, x binary")
    found = driver_rows(rows, 4 * TRAIN, "labelled sample")
    found.sort(key=lambda r: (r.h, r.x))
    return train([(np.append(np.frombuffer(r.x, "<i4").astype(np.int64), BIAS), r.toxic) for r in found])


def _score(shared):
    def run(batches):
        take_worker("toxicity")
        at, w = shared.value
        table = np.zeros(BUCKETS, np.float32)
        inner = at < BUCKETS
        table[at[inner]] = w[inner]
        bias = float(w[~inner].sum())
        for batch in batches:
            for x in slices(batch, limit=1 << 20):
                row, bucket = features(*text_bytes(x.column("text")))
                used = table[bucket] != 0
                pairs = np.unique(row[used] * BUCKETS + bucket[used])
                total = np.bincount(pairs // BUCKETS, table[pairs % BUCKETS].astype(float), x.num_rows) + (bias if len(at) else -np.inf)
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                kept = {n: x.column(n) for n in x.schema.names if n != "text"}
                yield pa.record_batch(kept | {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= THRESHOLD).astype(np.int32))})

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The columns of docs but the text, with score and predicted added (or replaced)."""
    docs = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return spread(docs).mapInArrow(_score(shared), f"{fields}score double, predicted int")


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
