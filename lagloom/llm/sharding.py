"""Sharding by vector bin packing, law ``bytes``.

Groups of equal texts (null counts as empty) stay together and are packed by
three sizes at once: bytes, tokens (words) and rows.  Groups go in order of
their largest share; each goes to the shard where the dot product of its sizes
with the residual capacity is highest.

A group with over 1 / (shards * ``FINE``) of all bytes, tokens or rows is packed
by itself: there are at most 3 * shards * FINE of these.  The others are first
gathered by a hash of the text into shards * ``BINS`` bins, which are packed
like groups.  So the packing sees a bounded number of items at any input size.
A group larger than a shard's capacity has a shard that is larger by necessity.

Slots: rows of a shard are numbered through units (item and a salt by doc_id) of
about ``UNIT`` rows or, where that is more, the square root of a shard's rows, so
neither a shard nor a large group passes through one task, and the units of a
shard are as few as the rows of a unit.  Repeated rows each get a slot of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagloom.llm.common import documents, driver_rows, materialize

SHARDS, FINE, BINS, UNIT, OVERHEAD = 40, 64, 256, 256, 16
DIMS = ("bytes", "tokens", "rows")


def pack(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of sizes): highest dot product with the residual capacity, largest items first."""
    share = sizes / np.maximum(1, sizes.sum(0))
    residual = np.full((shards, sizes.shape[1]), 1 / shards)
    out = np.zeros(len(sizes), np.int64)
    for k in np.lexsort((np.arange(len(sizes)), -share.max(1))):
        out[k] = (residual @ share[k]).argmax()
        residual[out[k]] -= share[k]
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    spark, text = docs.sparkSession, F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2"),
        ),
        "sizes",
    )
    groups = materialize(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS]).first()
    bins = shards * BINS
    limit = shards * FINE
    large = F.lit(False)
    for c in DIMS:
        large = large | (F.col(c) * limit > total[c])
    heavy = driver_rows(groups.where(large), len(DIMS) * limit, "large groups")
    light = driver_rows(groups.where(~large).groupBy(F.pmod("g1", F.lit(bins)).alias("item")).agg(*[F.sum(c).alias(c) for c in DIMS]), bins, "bins")
    heavy.sort(key=lambda r: (r.g1, r.g2))
    light.sort(key=lambda r: r.item)
    items = [(bins + k, r.g1, r.g2, r.bytes, r.tokens, r.rows) for k, r in enumerate(heavy)] + [(r.item, None, None, r.bytes, r.tokens, r.rows) for r in light]
    to = pack(np.array([i[3:] for i in items], np.float64).reshape(-1, len(DIMS)), shards)
    unit = max(UNIT, int((total["rows"] / shards) ** 0.5))
    placed = spark.createDataFrame([(i[0], i[1], i[2], int(s), max(1, -(-i[5] // unit))) for i, s in zip(items, to)], "item long, g1 long, g2 long, shard int, salts long")
    own = F.broadcast(placed.where(F.col("g1").isNotNull()).select("g1", "g2", F.col("item").alias("own")))
    dealt = rows.join(own, ["g1", "g2"], "left").withColumn("item", F.coalesce("own", F.pmod("g1", F.lit(bins))))
    dealt = dealt.join(F.broadcast(placed.select("item", "shard", "salts")), "item")
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts"))).select("doc_id", "size", "text_crc32", "shard", "item", "salt")
    units = dealt.groupBy("shard", "item", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("item", "salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    units = units.select("item", "salt", before.alias("before"))
    inside = F.row_number().over(W.partitionBy("item", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    return dealt.join(units, ["item", "salt"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + inside).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
