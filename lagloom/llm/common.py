"""Helpers shared by the training-data operators.

Texts travel as Arrow batches.  ``slices`` cuts a batch so that a task never
holds the working arrays of more than ``SLICE_BYTES`` of text (one longer
document is a slice of its own), and ``Words`` finds and hashes all words of a
slice at once with NumPy.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
#: Words end at these bytes: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: All ASCII bytes but letters and digits: words free of punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: What is left of eight bytes of which so many belong to a word.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed by BLAKE2b.
LONG_WORD = 512

_caches: list = []
_owner = ""


def worker_cache(maxsize: int = 2):
    """lru_cache for what an operator keeps in a Python worker between tasks."""

    def wrap(f):
        _caches.append(cached := functools.lru_cache(maxsize)(f))
        return cached

    return wrap


def trim() -> None:
    """Give memory that is free back to the system, for the other workers and the JVM beside them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def take_worker(operator: str) -> None:
    """Called first in a task: a reused worker keeps the tables of one operator at a time, and no free memory."""
    global _owner
    if _owner != operator:
        for c in _caches:
            c.cache_clear()
        gc.collect()
        _owner = operator
    trim()


def without_gc(run):
    """A task's generator with the cycle collector off: it makes no cycles, and passes over large tables cost a fourth of its time."""

    @functools.wraps(run)
    def wrapped(batches):
        was = gc.isenabled()
        gc.disable()
        try:
            yield from run(batches)
        finally:
            if was:
                gc.enable()
            trim()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine serves a local master; a cluster has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file:///tmp/lagloom-checkpoints"
    return found.rstrip("/")


_scopes: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What operators write to the shared folder inside is removed at the end, when nothing that was made of it may be read any more."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            if not path.startswith(TABLE_MARK):
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
            else:
                spark.sql(f"DROP TABLE IF EXISTS `{path.removeprefix(TABLE_MARK)}`")


TABLE_MARK = "table:"


def new_path(spark: SparkSession, tag: str, outlives: bool = False) -> str:
    """A new path in the shared folder; outlives: it belongs to the scope around the present one."""
    path = f"{shared_dir(spark)}/lagloom-{tag}-{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if outlives else _scopes
    if scopes:
        scopes[-1].append(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """The frame over all cores, where it is read from files with fewer splits than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().toString():  # it has a shuffle of its own
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, tag: str, outlives: bool = False) -> DataFrame:
    """Write once to the shared folder and read back, so that the lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag, outlives)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str, buckets: int) -> DataFrame:
    """Write the frame, which is dealt into ``buckets`` partitions as Spark hashes the key, as a table so bucketed: such tables join without a shuffle."""
    spark, path, name = df.sparkSession, new_path(df.sparkSession, tag), f"lagloom_{tag}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(name, format="parquet")
    if _scopes:
        _scopes[-1].append(f"{TABLE_MARK}{name}")
    return spark.table(name)


#: Rows of a few numbers each that are broadcast at most: some 30 MB in an executor.
FEW_ROWS = 400_000


def if_few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """A stored frame of a few numbers a row, marked to be broadcast if it has at most so many; else it is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash of whole numbers of 64 bits, by which it deals rows into partitions and buckets (Murmur3, 32 bits, seed 42)."""
    x = np.asarray(x, np.int64).view(np.uint64)
    rotl = lambda v, r: (v << np.uint32(r)) | (v >> np.uint32(32 - r))
    h = np.full(x.shape, 42, np.uint32)
    for half in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)):
        k = rotl(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rotl(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def binary(column) -> pa.LargeBinaryArray:
    """A text column as bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: none) and the offsets of its rows from 0."""
    col = binary(column)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if len(col) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, (off - off[0] if len(off) else np.zeros(1, np.int64))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive row ranges of at most ``limit`` bytes of text or one row."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of every row: byte spans, rows, and hashes on demand.

    Words are runs of bytes that are not in ``gaps``: by default ``[^\\x20\\x09-\\x0D]+``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = SPACE):
        self.data, self.offsets = data, offsets
        self.rows = len(offsets) - 1
        solid = ~gaps[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[inner] |= solid[inner]
        last[inner - 1] |= solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Word index at which each row starts, with the total at the end.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, key: int = 0) -> np.ndarray:
        """64-bit hash of every word: eight bytes at a time through a finaliser, and its length; key: a secret one, so that no texts can be made to collide."""
        size = self.ends - self.starts
        eight = np.ndarray((len(self.data) + 1,), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))
        out = mix(size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(key))
        live, at, left = np.arange(len(size)), self.starts, size
        if (long := size > LONG_WORD).any():
            out[long] = [int.from_bytes(hashlib.blake2b(self.data[a:b].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little") for a, b in zip(self.starts[long], self.ends[long])]
            live, at, left = live[~long], at[~long], left[~long]
        while len(live):
            out[live] = mix((out[live] ^ (eight[at] & _TAIL[np.minimum(left, 8)])) + np.uint64(0x9E3779B97F4A7C15))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        return out

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def driver_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a result whose size is bounded by design; fails rather than overflow the driver."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what}: more than {bound} rows for the driver")
    return rows
