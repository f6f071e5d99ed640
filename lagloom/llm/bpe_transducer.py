"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoder.  A pre-token's symbols are read one by one.  For every prefix the last
token of its encoding is kept: the one token that ends there and forms a valid
pair with the last token of the prefix before it (an encoding is valid if and
only if all adjacent pairs are).  A later token starts at most ``lookahead``
symbols before the read head, ``lookahead`` being the longest token the merge
list can build less one, so only that many prefixes stay alive; once the chains
of all live prefixes run through the same boundary, the tokens before it are
final, are emitted, and their state is dropped.  Live state does not grow with
the length of the pre-token.

Normalisation and pre-tokenisation are the library's own.  Texts are cut at
ASCII white space, which no token of such a tokenizer crosses and which its
pre-tokenizer drops, and the output of repeated pieces is kept in a table of
bounded size.

Decoder.  ``Decoder`` takes ids one by one and gives out text as soon as it is
certain: byte-level tokens go through an incremental UTF-8 machine (undecodable
bytes become U+FFFD), tokenizers without a decoder join tokens by a space.

Null and empty texts give no tokens and decode to the empty text.
"""

from __future__ import annotations

import codecs
import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.common import binary, documents, slices, spread, take_worker, without_gc, worker_cache
from lagloom.llm.pretokens import PIECE, Pretokenizer, Table, byte_letters
from lagloom.llm.token_counts import tokenizer_path

#: Entries of a generation of a worker's tables of pre-tokens and of pieces.
WORDS, TABLE = 400_000, 150_000


class Transducer:
    """Encodes pre-tokens (strings over the vocabulary's letters) with the merges of a tokenizers BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        #: Tokens by their symbols; the last symbol of a pre-token, which carries the suffix, is a letter of its own.
        self.tokens: dict[str, tuple[int, str]] = {}
        for text, k in self.vocab.items():
            body, last = (text[: -len(self.suffix)], True) if self.suffix and text.endswith(self.suffix) and text != self.suffix else (text, False)
            if body:
                self.tokens[self._marked(body) if last else body] = (k, text)
        self.built = {a + b for a, b in merges}
        self.lookahead = max((len(t) for t, (_, s) in self.tokens.items() if s in self.built), default=1) - 1
        #: Trie of the tokens read from their ends; a token's node holds it under 0 and, under 1, which tokens may come before it.
        self.trie: dict = {}
        for t in self.tokens:
            node = self.trie
            for c in reversed(t):
                node = node.setdefault(c, {})
            node[0], node[1] = t, {}
        self._known = 0

    @staticmethod
    def _marked(body: str) -> str:
        return body[:-1] + chr(0xF0000 + ord(body[-1]))

    def _merge(self, marked: str) -> list[str]:
        """Encoding by the definition, merge after merge; for pairs of tokens only."""
        parts = [chr(ord(c) - 0xF0000) + self.suffix if ord(c) >= 0xF0000 else c for c in marked]
        while len(parts) > 1:
            ranks = [self.rank.get(x, 1 << 60) for x in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            pair, out, k = (parts[(i := ranks.index(best))], parts[i + 1]), [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == pair:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _valid(self, a: str, node: dict) -> bool:
        """Whether token a (may be empty) and the node's token stay as they are next to each other."""
        b = node[0]
        if self._known > 2_000_000:  # the table of pairs stays bounded
            for t in self.tokens:
                at = self.trie
                for c in reversed(t):
                    at = at[c]
                at[1].clear()
            self._known = 0
        self._known += 1
        found = node[1][a] = self._merge(a + b) == [self.tokens[x][1] for x in (a, b) if x]
        return found

    def _advance(self, window: str, last: list, ends) -> None:
        """Appends the last token of each prefix window[:end], found from those of the shorter prefixes."""
        trie, valid = self.trie, self._valid
        for end in ends:
            node, start, out = trie, end, None
            while start:
                start -= 1
                node = node.get(window[start])
                if node is None:
                    break
                if 0 in node:
                    before = last[start]
                    if before is not None:
                        ok = node[1].get(before)
                        if valid(before, node) if ok is None else ok:
                            out = node[0]
                            break
            last.append(out)

    def stream(self, letters):
        """Token ids of one pre-token, from an iterator of its symbols, emitted once stable.

        Letters that no token has are left out, as the library does without an unknown token.
        """
        most = self.lookahead + 1
        window, last = "", [""]  # last[i]: last token of the prefix of i symbols; what is before the window is settled
        for c in letters:
            window += c
            self._advance(window, last, (len(window),))
            if len(window) >= 4 * most:
                ids, cut = self._settle(window, last, len(window), most)
                if cut:
                    yield from ids
                    window, last = window[cut:], last[cut:]
        yield from self._chain(window, last)

    def _chain(self, window: str, last: list) -> list[int]:
        ids, at = [], len(window)
        while at:
            token = last[at]
            if token is None:
                raise KeyError(window[at - 1])
            ids.append(self.tokens[token][0])
            at -= len(token)
        return ids[::-1]

    def _settle(self, window: str, last: list, n: int, most: int) -> tuple[list[int], int]:
        """Tokens up to the last boundary that the chains of all live prefixes share, and that boundary.

        """
        live = {i for i in range(n - most + 1, n + 1) if last[i] is not None}
        while len(live) > 1:
            i = max(live)
            live.discard(i)
            live.add(i - len(last[i]) if i else 0)
        cut = live.pop() if live else 0
        return (self._chain(window[:cut], last[: cut + 1]), cut) if cut else ([], 0)

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        tokens = self.tokens
        if any(c not in tokens for c in word) or self.suffix and self._marked(word[-1]) not in tokens:
            known = [c for c in word[:-1] if c in tokens]
            end = self._marked(word[-1]) if self.suffix else word[-1]
            if end in tokens:
                known.append(end)
            return list(self.stream(iter(known)))
        word = self._marked(word) if self.suffix else word
        if len(word) > 4 * self.lookahead:
            return list(self.stream(iter(word)))
        last = [""]  # too short to settle anything before its end
        self._advance(word, last, range(1, len(word) + 1))
        return self._chain(word, last)


class Encoder(Pretokenizer):
    """Whole texts to ids: special tokens, normaliser and pre-tokenizer of the library, merges by the transducer."""

    def __init__(self, path: str):
        super().__init__(path)
        self.transducer = Transducer(path)

    def piece(self, text: str) -> list[int]:
        """Ids of a text without white space, or of any short text."""
        out: list[int] = []
        for w in self.pretokens(text):
            if isinstance(w, int):
                out.append(w)
            else:
                out += self.transducer.encode(w)
        return out


class Decoder:
    """Ids to text, step by step: ``feed`` returns what has become certain, ``end`` the rest."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.letters = {k: s for s, k in spec["model"]["vocab"].items()}
        self.special = {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.byte_level = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.bytes = {c: b for b, c in byte_letters().items()}
        #: What each id stands for, by its decimal digits, where tokens are joined by spaces.
        self.written = {} if self.byte_level else {b"%d" % k: s.encode() for k, s in {**self.letters, **self.special}.items()}
        self.reset()

    def reset(self) -> None:
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.first = True

    def feed(self, token: int) -> str:
        text = self.special.get(token) or self.letters.get(token)
        if text is None:
            return ""
        if not self.byte_level:
            text, self.first = text if self.first else " " + text, False
            return text
        return self.machine.decode(bytes(self.bytes[c] for c in text)) if token not in self.special else self.machine.decode(b"", True) + text

    def end(self) -> str:
        out = self.machine.decode(b"", True) if self.byte_level else ""
        self.reset()
        return out

    def decode(self, ids) -> str:
        return "".join(map(self.feed, ids)) + self.end()

    def decode_written(self, ids: bytes) -> bytes:
        """The text of ids that are written in decimal digits, with spaces between."""
        if self.byte_level:
            return self.decode(map(int, ids.split())).encode()
        return b" ".join(map(self.written.__getitem__, ids.split()))


@worker_cache(1)
def _tools(path: str, words: int, pieces: int) -> tuple[Encoder, Decoder, Table, Table]:
    return Encoder(path), Decoder(path), Table(pieces), Table(words)


def _round_trip(path, n_words=WORDS, n_pieces=TABLE):
    @without_gc
    def run(batches):
        take_worker("bpe_transducer")
        encoder, decoder, table, words = _tools(path, n_words, n_pieces)

        def word(w: str | int) -> bytes:
            out = b"%d" % w if isinstance(w, int) else " ".join(map(str, encoder.transducer.encode(w))).encode()
            return out if isinstance(w, str) and len(w) > PIECE else words.put(w, out)

        def made(piece: bytes) -> bytes:
            return b" ".join(filter(None, [words.get(w) or word(w) for w in encoder.of_piece(piece)]))

        for batch in batches:
            for x in slices(batch):
                n, sha, back = [], [], []
                for text in binary(x.column("text")):
                    pieces = text.as_py().split()
                    got = list(map(table.young.get, pieces))
                    if None in got:
                        for k, g in enumerate(got):
                            if g is None:
                                p = pieces[k]
                                found = table.get(p)
                                got[k] = found if found is not None else made(p) if len(p) > PIECE else table.put(p, made(p))
                    ids = b" ".join(filter(None, got))
                    n.append(ids.count(b" ") + 1 if ids else 0)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(decoder.decode_written(ids)).hexdigest())
                yield pa.record_batch({"doc_id": x.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())})

    return run


def round_trip(docs: DataFrame, path: str, words: int = WORDS, pieces: int = TABLE) -> DataFrame:
    """Digests of the ids of every whole text and of the text they decode to.

    words, pieces: entries of a generation of a worker's tables; fewer take less memory and more time.

    For tokenizers whose pre-tokenizer drops white space: pieces between ASCII
    white space are encoded on their own.  Decoding starts from the ids of the
    whole text.
    """
    return spread(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(_round_trip(path, words, pieces), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
