"""Operators 1, 4 and 9 against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagloom.llm import bpe_transducer, token_counts, token_files
from lagloom.llm.token_counts import tokenizer_path

from .conftest import ODD

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
WORD = tokenizer_path("word_bpe_49k.json")
library = tokenizers.Tokenizer.from_file(WORD)
pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
encoder, decoder = bpe_transducer.Encoder(WORD), bpe_transducer.Decoder(WORD)


def ids_of(text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(odd, none):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, tokenizer_path("piece_bpe_32k.model")).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(pieces.encode(t or "")), len(pieces.encode(t or "")) > 4096) for i, t in ODD), key=str)
    assert got == want
    assert token_counts.count_tokens(none, tokenizer_path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("kind", ["aeiouthns", "aeiou thns\n", "日本é a ", "x", " ", "ab1 "])
def test_resync_is_exact(kind):
    rng = random.Random(3)
    for n in (999, 1001, 9000):
        text = "".join(rng.choice(kind) for _ in range(n))
        assert token_counts.resync_ids(pieces, text, chunk=300, overlap=16) == pieces.encode(text)


def test_round_trip_digests(odd, none):
    want = []
    for i, t in ODD:
        ids = ids_of(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe_transducer.round_trip(odd, WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert bpe_transducer.round_trip(none, WORD).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    mine = [k for p in text.encode().split() for k in encoder.piece(p.decode())]
    assert mine == ids_of(text)
    assert decoder.decode(mine) == library.decode(mine, skip_special_tokens=False)
    assert decoder.decode_written(" ".join(map(str, mine)).encode()).decode() == library.decode(mine, skip_special_tokens=False)


def test_long_pretokens_stream_in_bounded_state():
    rng = random.Random(5)
    for kind in ("ab", "aeiouthns", "aaab", "x"):
        word = "".join(rng.choice(kind) for _ in range(3000))
        assert encoder.transducer.encode(word) == ids_of(word)
    given_out, read = [], 0

    def letters():
        nonlocal read
        for c in encoder.transducer._marked("the" * 2000):
            read += 1
            yield c

    behind = 0
    for _ in encoder.transducer.stream(letters()):
        given_out.append(read)
    behind = max(b - a for a, b in zip(given_out, given_out[1:]))
    assert given_out[0] < 400 and behind < 400  # tokens come out while the word is still being read


def test_byte_level_decoding_step_by_step():
    path = tokenizer_path("byte_bpe_50k.json")
    other = tokenizers.Tokenizer.from_file(path)
    machine, rng = bpe_transducer.Decoder(path), random.Random(1)
    for text in ("naïve 日本語 \U0001f600 end", "plain"):
        ids = other.encode(text, add_special_tokens=False).ids
        assert machine.decode(ids) == other.decode(ids, skip_special_tokens=False) == text
    for _ in range(50):
        ids = [rng.randrange(50257) for _ in range(20)]
        assert machine.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_files(spark, odd, none, tmp_path):
    folder = token_files.write_tokens(odd, WORD, f"file://{tmp_path}/a")
    got = {}
    for r in token_files.read_tokens(spark, folder, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted((r for v in got.values() for r in v), key=lambda r: r.start)
    assert [r.doc_id is None for r in rows][:1] == [True] and [r.doc_id for r in rows[1:]] == sorted(i for i, _ in ODD if i is not None)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    for i, t in ODD:
        ids = [*ids_of(t), 1]
        raw = np.array(ids, "<u4").tobytes()
        assert any(bytes(r.ids) == raw and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(raw) for r in got[i])
    folder = token_files.write_tokens(none, WORD, f"file://{tmp_path}/b")
    assert token_files.read_tokens(spark, folder).count() == 0


def test_one_document_by_the_index(spark, odd, tmp_path):
    folder = token_files.write_tokens(odd, WORD, f"file://{tmp_path}/c")
    dictionary = next(p for p in (tmp_path / "c/dict").glob("*.txt") if p.stat().st_size).read_bytes()[:-1]
    found = [f for p in (tmp_path / "c/data").glob("*.txt") if (f := token_files.fetch(p.read_bytes(), dictionary, 4)) is not None]
    assert len(found) == 1 and found[0].tolist() == [*ids_of(dict(ODD)[4]), 1]
    assert folder


def test_files_are_in_order_of_their_numbers():
    names = [f"x/part-{p:05d}-8a1e-c0de-c{c:03d}.txt" for p, c in ((99_999, 0), (100_000, 0), (100_001, 999), (100_001, 1000), (7, 0))]
    assert sorted(map(token_files.file_place, names)) == [(7, 0), (99_999, 0), (100_000, 0), (100_001, 999), (100_001, 1000)]
    with pytest.raises(ValueError):
        token_files.file_place("x/_SUCCESS")


def test_datasets_of_many_files(spark, docs, tmp_path, monkeypatch):
    """Several files a task: starts go on over all of them."""
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(token_files, "FILE_BLOCKS", 2)
    folder = token_files.write_tokens(docs, tokenizer_path("word_bpe_49k.json"), f"file://{tmp_path}/many")
    assert len(list((tmp_path / "many" / "data").glob("part-*.txt"))) > 20
    at = 0
    for r in sorted(token_files.read_tokens(spark, folder).collect()):
        assert r.start == at
        at += r.n_tokens
