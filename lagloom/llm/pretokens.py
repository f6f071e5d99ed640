"""Pre-tokens of word-wise tokenizers, and bounded tables of results."""

from __future__ import annotations

import functools
import json
import os
import re

#: The pre-tokens of a lower-cased, printable Latin-1 piece under the pattern of the files served here.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = {b".", b",", b";", b":", b"!", b"?"}
#: Longest entry (bytes or letters) of the tables.
PIECE = 64


@functools.lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: bytes that print stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return out


class Table:
    """Results of bounded number: two generations, of which the older one is dropped when the younger is full."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value):
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value


class Pretokenizer:
    """Cuts texts as the tokenizers library does: special tokens, then its normaliser and pre-tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.plain = _PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") and "Lowercase" in json.dumps(spec["normalizer"])
        self.any_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.marks = {t[0] for t in self.special}
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}

    def of_piece(self, piece: bytes) -> list[str | int]:
        """Pre-tokens of a piece without ASCII white space; most are letters, with at most one mark at the end."""
        if self.plain:
            low = piece.lower()
            if low.isalpha():
                return [low.decode()]
            if low[-1:] in _MARKS and low[:-1].isalpha():
                return [low[:-1].decode(), chr(low[-1])]
        return self.pretokens(piece.decode())

    def pretokens(self, text: str) -> list[str | int]:
        """Pre-tokens (in byte letters) of a text, and the ids of special tokens in it.

        A printable Latin-1 piece without white space is the same in every
        Unicode version, needs no normal form, and is cut here; all else goes
        through the library.
        """
        for mark in self.marks:
            if mark in text:
                break
        else:
            return self._cut(text)
        out: list[str | int] = []
        at = 0
        for found in self.any_special.finditer(text):
            out += self._cut(text[at : found.start()])
            out.append(self.special[found[0]])
            at = found.end()
        return out + self._cut(text[at:])

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain and text.isprintable() and " " not in text:
            if text.isascii():
                return _PLAIN.findall(text.lower())
            if max(text) <= "\xff":
                return [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in _PLAIN.findall(text.lower())]
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
