"""Token ids as binary files with a shared zstandard dictionary.

A dataset is a folder with ``dict`` (the dictionary) and ``data`` (the files,
in ascending doc_id order by the two numbers in their names; of ``FILE_BLOCKS``
blocks at most, so that a reader's task holds no more).  A file is a row of blocks, each

    magic "TKZD" | version u8 | id width u8 | dictionary hash, 32 bytes |
    n u32 | index: doc_id i64[n], n_tokens u64[n], frame end u64[n] |
    n zstandard frames | line feed

all little-endian.  Every document is a frame of its own, made with the shared
dictionary, so a short document is read by its index entry alone.  Spark's text
writer writes the blocks as they are (its line separator is the closing line
feed), so the files can go to any store, and a lost executor's files are
written anew under the usual commit rules.

The dictionary is trained on the serialized ids of a sample of ``SAMPLE``
documents at most (those with the smallest hash of doc_id, the first
``SAMPLE_BYTES`` of each); it changes sizes only, never contents.  Null and
empty texts hold the end id alone.  A null doc_id is stored as the smallest
64-bit number and read back as null.  Equal doc_ids keep an order fixed by
their contents.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagloom.llm.common import binary, documents, driver_rows, materialize, new_path, slices, spread, take_worker, without_gc, worker_cache
from lagloom.llm.pretokens import PIECE, Pretokenizer, Table
from lagloom.llm.token_counts import tokenizer_path

MAGIC, VERSION, END_ID = b"TKZD", 1, 1
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 600, 1 << 14, 1 << 16
BLOCK_BYTES = 4 << 20
#: Blocks in a file, and bytes of frames in the range of documents that one task writes.
FILE_BLOCKS, RANGE_BYTES = 8, 128 << 20
TABLE, WORDS = 250_000, 250_000
NULL_ID = -(2**63)


@worker_cache(1)
def _library(path: str) -> tuple[Pretokenizer, Table, Table, dict[int, list[bytes]]]:
    """The pre-tokenizer, the tables of pieces and pre-tokens, and the bytes of every id by its width."""
    return Pretokenizer(path), Table(TABLE), Table(WORDS), {}


def id_width(path: str) -> int:
    return 2 if _library(path)[0].library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def encode_texts(path: str, texts: list[bytes], width: int) -> list[bytes]:
    """Little-endian ids of each text, by the library's model.

    For tokenizers whose pre-tokenizer drops white space: pieces between ASCII
    white space stand for themselves, and pieces and pre-tokens that came
    before are looked up.
    """
    cutter, table, words, written = _library(path)
    tokenize = cutter.library.model.tokenize
    if width not in written:
        written[width] = [k.to_bytes(width, "little") for k in range(cutter.library.get_vocab_size(with_added_tokens=True))]
    written = written[width]

    def word(w: str | int) -> bytes:
        if isinstance(w, int):
            return w.to_bytes(width, "little")
        ids = b"".join([written[t.id] for t in tokenize(w)])
        return words.put(w, ids) if len(w) <= PIECE else ids

    def piece(p: bytes) -> bytes:
        young = words.young.get
        got = [young(w) or words.get(w) or word(w) for w in cutter.of_piece(p)]
        ids = got[0] if len(got) == 1 else b"".join(got)
        return table.put(p, ids) if len(p) <= PIECE else ids

    out = []
    for text in texts:
        pieces = text.split()
        got = list(map(table.young.get, pieces))
        if None in got:
            for k, g in enumerate(got):
                if g is None:
                    found = table.get(pieces[k])
                    got[k] = piece(pieces[k]) if found is None else found
        out.append(b"".join(got))
    return out


def _encode(path, end_id, width, keep=None):
    end = int(end_id).to_bytes(width, "little")

    @without_gc
    def run(batches):
        take_worker("token_files")
        for batch in batches:
            for x in slices(batch):
                ids = [b + end for b in encode_texts(path, [t.as_py() for t in binary(x.column("text"))], width)]
                yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()), "n_tokens": pa.array([len(b) // width for b in ids], pa.int64()), "ids": pa.array([b[:keep] for b in ids], pa.binary())})

    return run


def train_dictionary(docs: DataFrame, path: str, end_id: int, width: int) -> bytes:
    """Dictionary content from a bounded sample; raw content where there is too little to train on."""
    by = F.xxhash64("doc_id")
    picked = docs.orderBy(by, "doc_id").limit(SAMPLE).mapInArrow(_encode(path, end_id, width, SAMPLE_BYTES // width * width), "doc_id long, n_tokens long, ids binary")
    samples = [bytes(r.ids) for r in sorted(driver_rows(picked.select("doc_id", "ids"), SAMPLE, "dictionary sample"), key=lambda r: (r.doc_id or 0, r.ids))]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or bytes(8)


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    trained = content[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _compress(path, end_id, width, shared):
    encode = _encode(path, end_id, width)

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1, dict_data=_dictionary(shared.value))
        for x in encode(batches):
            frames = pa.array([packer.compress(b.as_py()) for b in x.column("ids")], pa.binary())
            yield pa.record_batch({"doc_id": x.column("doc_id"), "n_tokens": x.column("n_tokens"), "size": pc.binary_length(frames).cast(pa.int64()), "frame": frames})

    return run


def _block(ids, counts, frames, width, digest) -> bytes:
    ends = np.cumsum([len(f) for f in frames])
    return b"".join([MAGIC, struct.pack("<BB", VERSION, width), digest, struct.pack("<I", len(ids)), np.array(ids, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), ends.astype("<u8").tobytes(), *frames])


def _pack(width, digest):
    def run(batches):
        take_worker("token_files, packing")
        ids, counts, frames, size = [], [], [], 0

        def block():
            return pa.record_batch({"block": pa.array([_block(ids, counts, frames, width, digest)], pa.binary())})

        for batch in batches:
            for i, n, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                if ids and size + len(f) > BLOCK_BYTES:
                    yield block()
                    ids, counts, frames, size = [], [], [], 0
                ids.append(NULL_ID if i is None else i)
                counts.append(n)
                frames.append(f)
                size += len(f)
        if ids:
            yield block()

    return run


def write_tokens(docs: DataFrame, path: str, to: str, end_id: int = END_ID) -> str:
    """Encode every whole text, append end_id, and write the dataset to the folder ``to``."""
    spark, docs = docs.sparkSession, docs.select("doc_id", F.col("text").cast("string").alias("text"))
    width = id_width(path)
    content = train_dictionary(docs, path, end_id, width)
    digest, shared = hashlib.sha256(content).digest(), spark.sparkContext.broadcast(content)
    text = lambda df, name: df.select(F.col(name).cast("string").alias("value"))
    text(spark.createDataFrame([(bytearray(content),)], "block binary").coalesce(1), "block").write.text(f"{to}/dict")
    frames = materialize(spread(docs).mapInArrow(_compress(path, end_id, width, shared), "doc_id long, n_tokens long, size long, frame binary"), "frames")
    size = frames.agg(F.sum("size")).first()[0] or 0
    ranges = max(min(4 * spark.sparkContext.defaultParallelism, 1 + size // BLOCK_BYTES), size // RANGE_BYTES)
    rows = frames.drop("size").repartitionByRange(ranges, "doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", "frame")
    text(rows.mapInArrow(_pack(width, digest), "block binary"), "block").write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{to}/data")
    return to


def blocks_of(content: bytes):
    """(width, dictionary hash, doc_ids, n_tokens, frame ends, offset of the first frame) of every block of a file."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError("not a token file")
        version, width = struct.unpack_from("<BB", content, at + 4)
        if version != VERSION:
            raise ValueError(f"token file version {version}")
        digest = content[at + 6 : at + 38]
        (n,) = struct.unpack_from("<I", content, at + 38)
        ids, counts, ends = (np.frombuffer(content, kind, n, at + 42 + 8 * n * k) for k, kind in enumerate(("<i8", "<u8", "<u8")))
        first = at + 42 + 24 * n
        yield width, digest, ids, counts, ends, first
        at = first + (int(ends[-1]) if n else 0) + 1


def file_place(name: str) -> tuple[int, int]:
    """Number of the task that wrote a file, and of the file among the task's."""
    found = re.search(r"part-(\d+)-[^/]*-c(\d+)\.txt$", name)
    if not found:
        raise ValueError(f"not a file of a dataset: {name}")
    return int(found[1]), int(found[2])


def _read(shared, with_ids):
    def run(batches):
        take_worker("token_files, reading")
        content = shared.value
        opener, digest = zstandard.ZstdDecompressor(dict_data=_dictionary(content)), hashlib.sha256(content).digest()
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                body, before, (part, nth) = body.as_py(), 0, file_place(name)
                for width, made_with, ids, counts, ends, first in blocks_of(body):
                    if made_with != digest:
                        raise ValueError("the block was made with another dictionary")
                    begin, crcs, texts = 0, [], []
                    for end in ends.tolist():
                        raw = np.frombuffer(opener.decompress(body[first + begin : first + end]), f"<u{width}").astype("<u4").tobytes()
                        crcs.append(zlib.crc32(raw))
                        if with_ids:
                            texts.append(raw)
                        begin = end
                    totals = np.cumsum(counts.astype(np.int64))
                    doc_id = pa.array(ids, pa.int64(), mask=ids == NULL_ID)
                    out = {"part": pa.array([part] * len(ids), pa.int64()), "nth": pa.array([nth] * len(ids), pa.int64()), "doc_id": doc_id, "local": pa.array(before + totals - counts.astype(np.int64)), "n_tokens": pa.array(counts.astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())}
                    before += int(totals[-1])
                    yield pa.record_batch(out | ({"ids": pa.array(texts, pa.binary())} if with_ids else {}))

    return run


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (unsigned 32-bit) of every document of a dataset."""
    raw = driver_rows(spark.read.format("binaryFile").load(f"{folder}/dict/*.txt").select("content"), 1, "dictionary files")
    content = bytes(raw[0].content)[:-1]
    shared = spark.sparkContext.broadcast(content)
    schema = "part long, nth long, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/data").select("path", "content")
    rows = materialize(files.mapInArrow(_read(shared, with_ids), schema), "read")
    # one row a file; the numbers of files ascend with doc_id
    totals = rows.groupBy("part", "nth").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(totals.select("part", "nth", before.alias("before")), ["part", "nth"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def fetch(content: bytes, dictionary: bytes, doc_id: int) -> np.ndarray | None:
    """Ids of one document of one file, by the index alone."""
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    for width, _, ids, _, ends, first in blocks_of(content):
        for k in np.flatnonzero(ids == doc_id):
            begin = int(ends[k - 1]) if k else 0
            return np.frombuffer(opener.decompress(content[first + begin : first + int(ends[k])]), f"<u{width}")
    return None


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_tokens(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), new_path(spark, "tokens"))
    return read_tokens(spark, folder)
