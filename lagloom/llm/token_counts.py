"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text of up to ``CHUNK`` bytes or characters is encoded at once.  A longer one is
encoded in chunks that overlap, with offsets, and two neighbours are spliced at
a stable common boundary: an offset at which both have a boundary, with the
same token before it and the same token after it.  A BPE encoding is valid if
and only if every pair of adjacent tokens is, so joining the left chunk's
tokens up to there with the right chunk's tokens from there gives the encoding
of the whole text.  Byte tokens and a chunk's first token (which carries the
added word start) never count as evidence.  Where no such offset exists, the
overlap is doubled and the chunk encoded again, in the extreme from where the
text before it is settled.

Null and empty texts have zero tokens.  Memory is that of one chunk, unless a
text has no stable boundary for longer.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import documents, slices, spread, take_worker, worker_cache

CHUNK, OVERLAP, LIMIT = 1 << 15, 512, 4096


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@worker_cache()
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _with_offsets(sp, text: bytes, base: int) -> list[tuple[int, int, int]]:
    return [(base + p.begin, base + p.end, p.id) for p in sp.encode(text, return_type="proto", num_threads=1).pieces]


def _letter(text: bytes, at: int) -> int:
    """The start of the letter at a byte offset, within the text."""
    at = max(0, min(at, len(text)))
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _splice(sp, left: list, right: list) -> tuple[int, int] | None:
    """Indexes of the last (left) token to keep and the first (right) token to go on with."""
    begins = {t[0]: k for k, t in enumerate(right)}
    for i in range(len(left) - 2, 0, -1):
        if left[i][1] <= right[0][1]:
            return None
        j = begins.get(left[i + 1][0])
        if j is not None and j > 1 and left[i + 1] == right[j] and left[i] == right[j - 1] and not (sp.is_byte(left[i][2]) or sp.is_byte(right[j][2])) and right[j][0] < right[j][1] and left[i][0] < left[i][1]:
            return i, j
    return None


def resync_ids(sp, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Token ids of the whole text; chunk and overlap count bytes."""
    if len(text) <= chunk:
        return sp.encode(text, num_threads=1)
    text = text.encode()
    ids: list[int] = []
    end = _letter(text, chunk)
    left = _with_offsets(sp, text[:end], 0)
    start = 0  # where the current, not yet settled tokens begin
    while end < len(text):
        width = overlap
        while True:
            at = max(start, _letter(text, end - width))
            stop = _letter(text, end + chunk)
            right = _with_offsets(sp, text[at:stop], at)
            if at == start:  # nothing to splice: the tokens so far are encoded again together with what follows
                if start == 0:
                    left, end = right, stop
                    break
                right = _again(sp, text, start, stop, left)
                left, end = right, stop
                break
            if cut := _splice(sp, left, right):
                ids += [t[2] for t in left[: cut[0]]]
                left, end = [left[cut[0]], *right[cut[1] :]], stop
                start = left[0][0]
                break
            width *= 2
    return ids + [t[2] for t in left]


def _again(sp, text: bytes, start: int, stop: int, left: list) -> list[tuple[int, int, int]]:
    """Tokens of text[start:stop], where left[0], which is settled, begins at start.

    The chunk is encoded with text before it, further and further back, until a
    token begins at start and is the settled one.
    """
    back = 64
    while True:
        at = _letter(text, start - back)
        got = _with_offsets(sp, text[at:stop], at)
        for k, t in enumerate(got):
            if t[0] == start and (k > 1 or at == 0) and t == left[0]:
                return got[k:]
        if at == 0:
            raise AssertionError("a settled token changed")
        back *= 2


def _count_batches(path, chunk, overlap, limit):
    def run(batches):
        take_worker("token_counts")
        sp = _pieces(path)
        for batch in batches:
            for x in slices(batch):
                texts = [t or "" for t in x.column("text").to_pylist()]
                n = [0] * len(texts)
                short = [k for k, t in enumerate(texts) if 0 < len(t) <= chunk]
                for k, ids in zip(short, sp.encode([texts[k] for k in short], num_threads=1) if short else ()):
                    n[k] = len(ids)
                for k, t in enumerate(texts):
                    if len(t) > chunk:
                        n[k] = len(resync_ids(sp, t, chunk, overlap))
                yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([k > limit for k in n], pa.bool_())})

    return run


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document, for the sentencepiece model at ``path``."""
    return spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_count_batches(path, chunk, overlap, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
