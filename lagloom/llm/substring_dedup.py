"""Exact removal of repeated word windows by recompression.

Names
-----
A word is known by a keyed 64-bit hash of its bytes.  Above it Spark gives all
names, one round a level: round 1 names pairs and runs of two words, round 2 pairs
of the symbols of round 1.  Pages send the distinct contents they hold, dealt by
hash; the reducer numbers those that occur twice at least and returns the
numbers.  What occurs once in all documents gets no name: it is dead, no window
that contains it is repeated, and nothing is built upon it.  Only what lies in a
window that may still be repeated is sent, so later rounds are smaller.

Which neighbours merge is decided by a hash bit of their names (one is a left,
the other a right symbol), that is by these two alone.  A run of equal words never
merges, as a window may cut it anywhere; its name (word, word) only tells
whether the run occurs elsewhere.  Symbols of round 2 have at most 4 words, and
what lies outside a passage changes cuts in its first and last 3 words only.

Windows
-------
A window of 20 words has a cut between its 7th and 13th word, common to all its
copies.  The symbols around a cut (two of round 2, beside them two of round 1,
beside them two words: at most 7 words a side, so all inside the window) are its
high-level symbol.  Each window takes the least hash of those of its cuts;
round 3 tells which of these symbols are shared.  A window without a dead symbol
whose high-level symbol is shared is a candidate.  Round 4 verifies: it compares
candidates by 128 bits, two sums of their 20 words, which are hashed anew with keys
of their own, and tells which of them an earlier page has.  Keys are drawn for each
call, so no texts can be made to collide.  The words under windows that start
earlier elsewhere are removed.

Plan
----
Documents go in doc_id order into pages of ``PAGE_BYTES``.  Pages and replies are
tables bucketed by page (a page's number is chosen so that the range of documents
it comes from is its bucket), so the text is shuffled once and every round shuffles
only its distinct contents, as packed blocks: one row for a page and a bucket,
never more than there are names.  A passage that fills a third of the rows costs a
name a page.

Null and empty texts have no words; repeated doc_ids count in an order fixed by
their text; extra columns are ignored, or carried along when texts are rewritten.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import Words, bucketed, documents, mix, slices, spark_hash, take_worker, text_bytes

WINDOW = 20
#: Words of a window's edge in which no cut is looked for, and words a side that a cut's symbol may span.
EDGE = 7
PAGE_BYTES = 1 << 20
#: Names that one reducer should hold.
BLOCK_NAMES = 1_500_000
LEAST_BUCKETS = 32
#: Bytes of text in one range of documents, which is one bucket of the page tables; Spark takes so many buckets.
RANGE_BYTES, MOST_BUCKETS = 32 << 20, 100_000
NONE = np.uint64(2**64 - 1)


# Pages ------------------------------------------------------------------------------------------------------------

PAGE = pa.schema([("page", pa.int64()), ("n_words", pa.int64()), ("blob", pa.binary())])


def page_number(part: int, n: int, buckets: int) -> int:
    """Numbers ascend with part and n, and Spark puts the page into the bucket of its part."""
    first = (part << 43) + (n << 22)
    for at in range(0, 1 << 22 if part < buckets else 0, 1 << 16):
        fits = np.flatnonzero(spark_hash(first + at + np.arange(1 << 16)) % buckets == part)
        if len(fits):
            return first + at + int(fits[0])
    return first  # dealt elsewhere: a file more


def _page_rows(buckets: int):
    def run(batches):
        take_worker("substring")
        part, n, waiting, size = TaskContext.get().partitionId(), 0, [], 0
        packer = zstandard.ZstdCompressor(level=1)

        def page():
            nonlocal n
            table = pa.Table.from_batches(waiting).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            n += 1
            return pa.record_batch([[page_number(part, n, buckets)], [len(Words(*text_bytes(table.column("text"))))], [packer.compress(sink.getvalue())]], schema=PAGE)

        for batch in batches:
            for x in slices(batch, limit=PAGE_BYTES):
                b = x.nbytes
                if waiting and size + b > PAGE_BYTES:
                    yield page()
                    waiting, size = [], 0
                waiting.append(x)
                size += b
        if waiting:
            yield page()

    return run


# Symbols ----------------------------------------------------------------------------------------------------------


def joined(names: np.ndarray, at: np.ndarray, opens: np.ndarray, level: int) -> np.ndarray:
    """Index of the first of two neighbouring symbols that merge; decided by their names alone."""
    left = mix(names + np.uint64(0x632BE59BD9B4E019 * level & (2**64 - 1))) >> np.uint64(63) == 0
    live = names != 0
    return np.flatnonzero(left[:-1] & ~left[1:] & live[:-1] & live[1:] & ~opens[at[1:]])


def in_runs(names: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Index of the first of two equal neighbouring words."""
    return np.flatnonzero((names[:-1] == names[1:]) & (names[:-1] != 0) & ~opens[1:-1])


def merge(names: np.ndarray, at: np.ndarray, first: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.ones(len(at), bool)
    keep[first + 1] = False
    names = names.copy()
    names[first] = new
    return names[keep], at[keep]


def distinct(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct contents, in order, whether each occurs twice, and the index of each content among them."""
    h = mix(mix(x * np.uint64(0x9FB21C651E98DF25) + np.uint64(1)) + y)
    found, index, many = np.unique(h, return_inverse=True, return_counts=True)
    return found, many > 1, index


class Page:
    """The symbols of one page, as far as the replies of earlier rounds go."""

    def __init__(self, blob: bytes, keys: tuple[int, ...]):
        self.table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()
        self.words, self.keys = Words(*text_bytes(self.table.column("text"))), keys
        self.bounds, self.n = self.words.bounds, len(self.words)
        self.w = self.words.hashes(keys[0])
        self.w[self.w == 0] = 1
        self.opens = np.zeros(self.n + 1, bool)
        self.opens[self.bounds] = True
        self.dead = np.zeros(self.n + WINDOW + 2, np.int32)
        starts = np.arange(self.n)
        self._forbid(starts[starts + WINDOW > np.repeat(self.bounds[1:], self.words.counts)], None, 0)

    def _forbid(self, start: np.ndarray, end: np.ndarray | None, margin: int) -> None:
        """No window holds a dead symbol, with margin words beside it; end None: no window starts there."""
        lo, hi = (start, start + 1) if end is None else (np.maximum(0, end + margin - WINDOW), start - margin + 1)
        some = lo < hi
        np.add.at(self.dead, lo[some], 1)
        np.add.at(self.dead, hi[some], -1)

    def _possible(self) -> np.ndarray:
        """Whether a window may still start at each word."""
        return np.cumsum(self.dead)[: self.n] == 0

    def _within(self, start: np.ndarray, end: np.ndarray, margin: int) -> np.ndarray:
        """Whether each symbol lies in a window that may be repeated, with margin words beside it."""
        total = np.concatenate([[0], np.cumsum(self._possible())])
        lo, hi = np.clip(end + margin - WINDOW, 0, self.n), np.clip(start - margin + 1, 0, self.n)
        return total[np.maximum(lo, hi)] > total[lo]

    def round1(self) -> tuple[np.ndarray, np.ndarray]:
        """Contents of round 1: pairs and runs of words."""
        at = np.arange(self.n)
        pairs, runs = joined(self.w, at, self.opens, 1), in_runs(self.w, self.opens)
        self.pairs, self.runs = (x[self._within(x, x + 2, 0)] for x in (pairs, runs))
        both = np.concatenate([self.pairs, self.runs])
        found, many, self.index = distinct(self.w[both], self.w[both + 1])
        return found, many

    def round2(self, reply) -> tuple[np.ndarray, np.ndarray]:
        """Contents of round 2, from the names of the pairs and runs."""
        names = _names(reply, int(self.index.max(initial=-1)) + 1)[self.index]
        at = np.concatenate([self.pairs, self.runs])[names == 0]
        self._forbid(at, at + 2, 0)
        self.s1, self.at1 = merge(self.w, np.arange(self.n), self.pairs, names[: len(self.pairs)])
        ends = np.append(self.at1[1:], self.n)
        pairs = joined(self.s1, self.at1, self.opens, 2)
        self.pairs2 = pairs[self._within(self.at1[pairs], ends[pairs + 1], 1)]
        found, many, self.index2 = distinct(self.s1[self.pairs2], self.s1[self.pairs2 + 1])
        return found, many

    def round3(self, reply) -> np.ndarray:
        """Sorted high-level symbols of the windows that may be repeated."""
        names = _names(reply, int(self.index2.max(initial=-1)) + 1)[self.index2]
        ends1 = np.append(self.at1[1:], self.n)
        gone = self.pairs2[names == 0]
        self._forbid(self.at1[gone], ends1[gone + 1], 1)
        s2, at2 = merge(self.s1, self.at1, self.pairs2, names)
        ends2 = np.append(at2[1:], self.n)
        row = np.searchsorted(self.bounds, at2, side="right") - 1
        k = np.flatnonzero((at2 - EDGE >= self.bounds[row]) & (at2 + EDGE <= self.bounds[row + 1]))
        before = np.searchsorted(self.at1, at2[k - 1]) - 1
        after = np.searchsorted(self.at1, ends2[k])
        parts = [self.w[self.at1[before] - 1], self.s1[before], s2[k - 1], s2[k], self.s1[after], self.w[ends1[after]]] if len(k) else [np.zeros(0, np.uint64)] * 6
        symbol = np.full(len(k), 0x8CB92BA72F3D8DD7, np.uint64)
        for p in parts:
            symbol = mix(symbol * np.uint64(0xD1342543DE82EF95) + p)
        symbol[symbol == NONE] = 0
        here = np.full(self.n + EDGE + 1, NONE)
        here[at2[k]] = symbol
        for step in (1, 2, 3):  # least of 7 places from each one on
            here[:-step] = np.minimum(here[:-step], here[step:])
        self.starts = np.flatnonzero(self._possible())
        self.symbol = here[self.starts + EDGE]
        found, many = np.unique(symbol, return_counts=True)
        self.found = np.unique(self.symbol)
        self.twice = many[np.searchsorted(found, self.found)] > 1 if len(found) else np.zeros(0, bool)
        return self.found

    def round4(self, reply) -> tuple[np.ndarray, np.ndarray]:
        """128-bit names of the distinct candidate windows, in order."""
        shared = _bits(reply, len(self.found)) | self.twice
        self.starts = self.starts[shared[np.searchsorted(self.found, self.symbol)]]
        lanes = []
        for key in self.keys[1:3]:
            factors = np.random.default_rng(key).integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            w, total = self.words.hashes(key), np.zeros(len(self.starts), np.uint64)
            for k, f in enumerate(factors):
                total += w[self.starts + k] * f
            lanes.append(mix(total))
        n1, n2 = lanes
        order = np.lexsort((n2, n1))
        new = np.ones(len(order), bool)
        new[1:] = (n1[order][1:] != n1[order][:-1]) | (n2[order][1:] != n2[order][:-1])
        self.index4 = np.empty(len(order), np.int64)
        self.index4[order] = np.cumsum(new) - 1
        return n1[order][new], n2[order][new]

    def gone(self, reply) -> np.ndarray:
        """Words under a window that starts earlier elsewhere."""
        index = self.index4
        first = np.zeros(len(index), bool)
        first[np.unique(index, return_index=True)[1]] = True
        earlier = _bits(reply, int(index.max(initial=-1)) + 1)
        at = self.starts[earlier[index] | ~first]
        delta = np.zeros(self.n + 1, np.int64)
        delta[at] += 1
        delta[at + WINDOW] -= 1
        return np.cumsum(delta)[: self.n] > 0


# Blocks -----------------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Byte plane by byte plane: the high planes compress well in the shuffle."""
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).reshape(-1).view("<u8")


BLOCK = pa.schema([("bucket", pa.int64()), ("page", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("twice", pa.binary())])
BLOCK_DDL = "bucket long, page long, x binary, y binary, twice binary"
REPLY = "page long, bucket long, data binary"


def _blocks(page: int, x: np.ndarray, y: np.ndarray | None, twice: np.ndarray | None, shift: int) -> pa.RecordBatch:
    """Contents, sorted by x, cut into blocks by its high bits."""
    bucket = (x >> np.uint64(shift)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(x) else np.zeros(0, np.int64)
    spans = list(zip(edges, [*edges[1:], len(x)]))
    xs = [_planes(x[a:b]) for a, b in spans]
    ys = [b"" if y is None else _planes(y[a:b]) for a, b in spans]
    ts = [b"" if twice is None else np.packbits(twice[a:b]).tobytes() for a, b in spans]
    return pa.record_batch([pa.array(bucket[edges]), pa.array([page] * len(spans), pa.int64()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary()), pa.array(ts, pa.binary())], schema=BLOCK)


def _joined_reply(reply) -> list[bytes]:
    return [r["data"] for r in sorted(reply or (), key=lambda r: r["bucket"])]


def _names(reply, count: int) -> np.ndarray:
    """The names that came back, in the order of the contents sent."""
    parts = [_unplanes(b) for b in _joined_reply(reply)]
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(out) != count:
        raise ValueError(f"{len(out)} names for {count} contents")
    return out


def _bits(reply, count: int) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(b[4:], np.uint8), count=int.from_bytes(b[:4], "little")) for b in _joined_reply(reply)]
    out = np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
    if len(out) != count:
        raise ValueError(f"{len(out)} bits for {count} contents")
    return out


def _gathered(table: pa.Table, column: str) -> tuple[np.ndarray, list[int]]:
    parts = [_unplanes(b.as_py()) for b in table.column(column)]
    return np.concatenate(parts), [len(p) for p in parts]


def _answers(table: pa.Table, data: list[bytes]) -> pa.Table:
    return pa.table({"page": table.column("page"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})


def _name(level: int):
    """The reducer of a naming round: numbers the contents that occur twice at least."""

    def run(key, table):
        x, sizes = _gathered(table, "x")
        twice = np.concatenate([np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n) for b, n in zip(table.column("twice"), sizes)])
        _, content, n = np.unique(x, return_inverse=True, return_counts=True)
        live = (n > 1) | (np.bincount(content, twice) > 0)
        names = (np.uint64(key[0].as_py()) << np.uint64(32) | np.cumsum(live).astype(np.uint64)) << np.uint64(2) | np.uint64(level)
        names[~live] = 0
        out, ends = names[content], np.cumsum(sizes)
        return _answers(table, [_planes(out[e - n : e]) for e, n in zip(ends, sizes)])

    return run


def _share(first_only: bool):
    """The reducer of a comparing round: does another page (first_only: an earlier one) have the content?"""

    def run(key, table):
        table = table.sort_by("page")
        x, sizes = _gathered(table, "x")
        y = _gathered(table, "y")[0] if first_only else np.zeros(0, np.uint64)
        order = np.lexsort((y, x)) if first_only else np.argsort(x, kind="stable")  # stable: of equal contents the earliest page comes first
        same = x[order][1:] == x[order][:-1]
        if first_only:
            same &= y[order][1:] == y[order][:-1]
        bit = np.zeros(len(x), bool)
        bit[order[1:]] |= same
        if not first_only:
            bit[order[:-1]] |= same
        ends = np.cumsum(sizes)
        return _answers(table, [int(n).to_bytes(4, "little") + np.packbits(bit[e - n : e]).tobytes() for e, n in zip(ends, sizes)])

    return run


def _at_round(k: int, row: dict, keys: tuple[int, ...]) -> tuple[Page, np.ndarray, np.ndarray | None, np.ndarray | None]:
    """A page as far as round k, and what it sends then."""
    page = Page(row["blob"], keys)
    x, many = page.round1()
    if k > 1:
        x, many = page.round2(row["r1"])
    if k <= 2:
        return page, x, None, many
    x, y = page.round3(row["r2"]), None
    if k > 3:
        x, y = page.round4(row["r3"])
    return page, x, y, None


def _rows(batch: pa.RecordBatch):
    """The rows one at a time."""
    for k in range(batch.num_rows):
        yield {n: batch.column(n)[k].as_py() for n in batch.schema.names}


def _send(k: int, shift: int, keys: tuple[int, ...]):
    """Blocks of round k from pages and the replies of all rounds before."""

    def run(batches):
        take_worker("substring")
        for batch in batches:
            for row in _rows(batch):
                _, x, y, many = _at_round(k, row, keys)
                yield _blocks(row["page"], x, y, many, shift)

    return run


def _finish(keys: tuple[int, ...], rewrite: bool):
    def run(batches):
        take_worker("substring")
        for batch in batches:
            for row in _rows(batch):
                page = _at_round(4, row, keys)[0]
                gone, table, words = page.gone(row["r4"]), page.table, page.words
                lost = np.diff(np.concatenate([[0], np.cumsum(gone)])[page.bounds]).tolist()
                kept, data = [], words.data.tobytes()
                for k in range(words.rows):
                    left = data[words.offsets[k] : words.offsets[k + 1]].split()
                    kept.append(b" ".join(compress(left, ~gone[words.bounds[k] : words.bounds[k + 1]]) if lost[k] else left))
                if rewrite:
                    texts = [k.decode() if n else t.as_py() for k, n, t in zip(kept, lost, table.column("text"))]
                    out = {n: table.column(n).combine_chunks() for n in table.column_names} | {"text": pa.array(texts, pa.string())}
                else:
                    shas = [hashlib.sha256(k).hexdigest() for k in kept]
                    out = {"doc_id": table.column("doc_id").combine_chunks(), "n_words": pa.array(words.counts, pa.int64()), "n_removed": pa.array(lost, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
                yield pa.record_batch(out)

    return run


def _power(names: float) -> int:
    """Bits of the bucket number for so many names."""
    bits = 1
    while (1 << bits) * BLOCK_NAMES < names or (1 << bits) < LEAST_BUCKETS and (1 << bits) * BLOCK_NAMES < 32 * names:
        bits += 1
    return bits


def remove_repeats(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    rewrite: instead all columns of docs; where words were removed, text is the
    kept words joined by one space, else it is unchanged.
    """
    columns, spark = docs.columns if rewrite else ["doc_id", "text"], docs.sparkSession
    docs = docs.select(*[F.col(f"`{c}`").cast({"doc_id": "long", "text": "string"}[c]).alias(c) if c in ("doc_id", "text") else F.col(f"`{c}`") for c in columns])
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = tuple(secrets.randbits(64) for _ in range(3))
    few = min(4 * spark.sparkContext.defaultParallelism, 1 + size // PAGE_BYTES)
    ranges = min(MOST_BUCKETS, max(few, size // RANGE_BYTES))
    # documents of one id are dealt by how their texts begin
    ordered = docs.repartitionByRange(ranges, "doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    pages = bucketed(ordered.mapInArrow(_page_rows(ranges), "page long, n_words long, blob binary"), "pages", "page", ranges)
    words = pages.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    # about so many contents are sent: a fourth of the neighbours merge; a window's least cut; windows in passages
    rounds = [(words * 0.25, _name(1)), (words * 0.2, _name(2)), (words * 0.25, _share(False)), (words * 0.5, _share(True))]
    known = pages.select("page", "blob")
    for k, (names, reducer) in enumerate(rounds, 1):
        sent = known.mapInArrow(_send(k, 64 - _power(names), keys), BLOCK_DDL)
        answers = sent.groupBy("bucket").applyInArrow(reducer, REPLY).repartition(ranges, "page")
        reply = bucketed(answers.groupBy("page").agg(F.collect_list(F.struct("bucket", "data")).alias(f"r{k}")), f"names{k}", "page", ranges)
        known = known.join(reply.hint("shuffle_hash"), "page", "left")
    schema = docs.schema if rewrite else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return known.mapInArrow(_finish(keys, rewrite), schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
