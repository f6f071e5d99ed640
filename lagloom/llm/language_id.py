"""Language identification by cross-parsing entropy over suffix automata.

For every language a suffix automaton is built over a sample of labelled text,
the documented bound of this operator: at most ``SAMPLES`` documents that have a
letter (in each of as many hash buckets the one with the smallest hash of doc_id)
and ``TRAIN`` letters; over all languages ``ALL_LETTERS`` and ``MOST_TEXTS``.  Each
document gives letters from a hashed place of its whole text on; short ones give
all they have, and the others fill what is left.  Every letter of the sample
counts, and tables grow with the sample only, not with the alphabets.

A text is parsed greedily into the longest phrases that occur in the sample:
each phrase is a longest match of the automaton; a letter the sample has not is
a phrase of its own.  A phrase costs log2 of the sample's length in bits, a letter
the sample has not ``LETTER_BITS`` besides; the
language with the fewest bits, so the fewest normalised phrases, wins, ties by
name.  The score is the winner's share when each language weighs 2**-bits.

Texts are lower-cased, letters kept, all else is one space.  A whole text is
parsed in sections of ``SECTION`` letters, all sections of a slice at once and
all languages together.  Texts that are null or have no letter get ``und`` and
score 0, as do all texts where nothing can be learned.  Labels are read from
rows whose crc32(doc_id) mod 4 is not 2 only.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagloom.llm.common import documents, driver_rows, held_out, materialize, slices, spread, take_worker

SAMPLES, TRAIN, SECTION = 64, 16_384, 512
#: Bounds over all languages: letters of sample and texts they come from; many languages get smaller samples each.
ALL_LETTERS, MOST_TEXTS = 1 << 20, 1 << 14
#: What a letter costs that the sample has not: one of all code points.
LETTER_BITS = np.log2(0x110000)
UND = "und"
_SPACE, _OTHER = 0, 1


@functools.lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, non-letters as 32 and never twice in a row, and each text's offsets."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, np.uint32(32))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in lowered])]).astype(np.int64)
    keep = points != 32
    if len(points):
        keep[1:] |= points[:-1] != 32
        starts = offsets[:-1][offsets[:-1] < len(points)]
        keep[starts] = points[starts] != 32
    total = np.concatenate([[0], np.cumsum(keep)])
    return points[keep], total[offsets]


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in text:
        cur = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p != -1:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return moves


def displaced(moves: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Transitions as one table: that of state s by class c is at base[s] + c, as s << 32 | next; other entries belong to other states.

    States with several transitions are put where all of them are free, one
    after the other; those with one fill the places between.  So the table is
    about as long as there are transitions, however many classes there are.
    """
    several = sorted((s for s, row in enumerate(moves) if len(row) > 1), key=lambda s: -len(moves[s]))
    base, taken, first = np.zeros(len(moves), np.int64), bytearray(4 * sum(map(len, moves)) + 64), 0
    for s in several:
        classes = sorted(moves[s])
        low, high = classes[0], classes[-1]
        at, tries = max(first, low), 0
        while True:
            at = taken.find(0, at)
            if at < 0 or at - low + high >= len(taken):
                at = len(taken) if at < 0 else at
                taken.extend(bytes(len(taken) + high))
                continue
            if not any(taken[at - low + c] for c in classes):
                break
            at, tries = at + 1, tries + 1
        if tries > 6:  # crowded: later ones begin here; states with one transition fill what is left
            first = at
        base[s] = at - low
        for c in classes:
            taken[at - low + c] = 1
    single = np.array([s for s, row in enumerate(moves) if len(row) == 1], np.int64)
    width = 2 + max((c for row in moves for c in row), default=0)
    free = np.flatnonzero(np.frombuffer(taken, np.uint8) == 0)
    free = free[free >= width]
    if len(free) < len(single):
        end = max(len(taken), width)
        free = np.concatenate([free, np.arange(end, end + len(single) - len(free))])
    base[single] = free[: len(single)] - np.array([next(iter(moves[s])) for s in single.tolist()], np.int64)
    state = np.repeat(np.arange(len(moves)), [len(row) for row in moves])
    classes = np.array([c for row in moves for c in row], np.int64)
    to = np.array([t for row in moves for t in row.values()], np.int64)
    table = np.full(int(base.max(initial=0)) + width + 1, -1, np.int64)
    table[base[state] + classes] = state << 32 | to
    return base, table


def shares(sizes: list[int], total: int) -> list[int]:
    """How much each gives to a total: short ones all they have, the others alike."""
    out, left = [0] * len(sizes), total
    for n, k in enumerate(sorted(range(len(sizes)), key=lambda k: (sizes[k], k))):
        out[k] = min(sizes[k], -(-left // (len(sizes) - n)))
        left -= out[k]
    return out


class Model:
    """Automata of all languages in one table of transitions; its size follows the sample, not the alphabets."""

    def __init__(self, samples: list[tuple[str, list[str]]]):
        self.langs = sorted(k for k, _ in samples)
        by, train = dict(samples), train_letters(len(samples))
        texts = []
        for k in self.langs:
            points, off = letters(by[k])
            texts.append(np.concatenate([points[a : a + n] for a, n in zip(off, shares(np.diff(off).tolist(), train))] or [np.zeros(0, np.uint32)]))
        seen, count = np.unique(np.concatenate(texts or [np.zeros(0, np.uint32)]), return_counts=True)
        seen = [c for c in seen[np.argsort(-count, kind="stable")].tolist() if c != 32]
        self.classes = np.full(0x110000, _OTHER, np.int32)
        self.classes[32] = _SPACE
        self.classes[seen] = np.arange(2, 2 + len(seen))
        moves, roots, dead = [], [], []
        for t in texts:
            base = len(moves)
            moves += [{c: to + base for c, to in row.items()} for row in automaton(self.classes[t].tolist())]
            roots.append(base)
            # the last state is where a letter leads that the sample has not: a phrase of its own
            moves.append({})
            dead.append(len(moves) - 1)
        self.base, self.table = displaced(moves)
        self.roots, self.dead = np.array(roots, np.int64), np.array(dead, np.int64)
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def _next(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and whether there is one; a class beyond the table belongs to no state."""
        entry = self.table.take(self.base.take(state) + c, mode="clip")
        return entry & 0xFFFFFFFF, entry >> 32 == state

    def _first(self, lang: np.ndarray, c: np.ndarray) -> np.ndarray:
        to, there = self._next(self.roots[lang], c)
        return np.where(there, to, self.dead[lang])

    def phrases(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of every text (rows) in every language (columns)."""
        return self.parse(points, offsets)[0]

    def parse(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and letters the sample has not, of every text (rows) in every language (columns)."""
        classes, n = self.classes[points], np.diff(offsets)
        sections = -(-n // SECTION)
        row = np.repeat(np.arange(len(n)), sections)
        start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(sections) - sections, sections)) * SECTION
        size = np.minimum(SECTION, offsets[1:][row] - start)
        order = np.argsort(-size, kind="stable")
        row, start, size = row[order], start[order], size[order]
        langs = np.arange(len(self.langs))[:, None]
        state = self._first(langs, classes[start][None, :])
        count = np.ones((len(self.langs), len(row)), np.int32)
        strange = (state == self.dead[langs]).astype(np.int32)
        live = np.searchsorted(-size, -np.arange(SECTION), side="left")  # sections longer than t
        for t in range(1, int(size[0]) if len(size) else 0):
            m = live[t]
            c = classes[start[:m] + t]
            to, there = self._next(state[:, :m], c)
            lang, at = np.nonzero(~there)
            to[lang, at] = new = self._first(lang, c[at])
            count[lang, at] += 1
            strange[lang, at] += new == self.dead[lang]
            state = to
        out = np.zeros((2, len(n), len(self.langs)), np.int64)
        np.add.at(out[0], row, count.T)
        np.add.at(out[1], row, strange.T)
        return out[0], out[1]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        points, offsets = letters(texts)
        has = np.array([points[a:b].max(initial=32) != 32 or points[a:b].min(initial=32) != 32 for a, b in zip(offsets, offsets[1:])], bool)
        if not self.langs:
            return [UND] * len(texts), np.zeros(len(texts))
        phrases, strange = self.parse(points, offsets)
        cost = phrases * self.bits + strange * LETTER_BITS
        best = cost.argmin(1)
        score = 1 / np.exp2(-np.minimum(1000.0, cost - cost.min(1)[:, None])).sum(1)
        return [self.langs[k] if h else UND for k, h in zip(best.tolist(), has)], np.where(has, score, 0.0)


def train_letters(langs: int) -> int:
    """Letters of sample a language."""
    return max(1, min(TRAIN, ALL_LETTERS // max(1, langs)))


def _parts(batches):
    """Of each text the letters from a hashed place on, round to the start; the whole text is read."""
    for batch in batches:
        parts = []
        for h, text, most in zip(*(batch.column(c).to_pylist() for c in ("h", "text", "most"))):
            points = letters([text])[0]
            at = h % len(points) if len(points) > most else 0
            parts.append(np.concatenate([points[at:], [np.uint32(32)], points[:at]] if at else [points])[:most].astype("<u4").tobytes().decode("utf-32-le"))
        yield pa.record_batch({"lang": batch.column("lang"), "h": batch.column("h"), "part": pa.array(parts, pa.string())})


def learn(docs: DataFrame) -> tuple:
    """Sample letters by language from rows (doc_id, text, lang) that are not held out and have a letter; bounded by SAMPLES, TRAIN and ALL_LETTERS."""
    usable = docs.where(~held_out() & F.col("text").rlike(r"\p{L}") & F.col("lang").isNotNull())
    h = F.xxhash64("doc_id")
    least = usable.select(F.col("lang").cast("string").alias("lang"), h.alias("h")).groupBy("lang", F.pmod("h", F.lit(SAMPLES)).alias("bucket")).agg(F.min("h").alias("h"))
    least = materialize(least, "language-samples")
    langs = least.select("lang").distinct().count()
    each = max(1, min(SAMPLES, MOST_TEXTS // max(1, langs)))
    picked = driver_rows(least.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("bucket"))).where(F.col("n") <= each).select("lang", "h"), max(MOST_TEXTS, langs), "language samples")
    if not picked:
        return ()
    texts = Counter(r.lang for r in picked)
    # four times the share, for texts that have fewer letters
    keys = docs.sparkSession.createDataFrame([(r.lang, r.h, -(-4 * train_letters(langs) // texts[r.lang])) for r in picked], "lang string, h long, most int")
    rows = usable.select(F.col("lang").cast("string").alias("lang"), h.alias("h"), "text").join(F.broadcast(keys), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"), F.first("most").alias("most"))
    found: dict[str, list[str]] = {}
    for r in sorted(driver_rows(rows.mapInArrow(_parts, "lang string, h long, part string"), len(picked), "language samples"), key=lambda r: (r.lang, r.h)):
        found.setdefault(r.lang, []).append(r.part)
    return tuple((k, tuple(v)) for k, v in sorted(found.items()))


def _predict(shared, pred, score_name):
    def run(batches):
        take_worker("language_id")
        model = shared.value
        for batch in batches:
            for x in slices(batch, limit=1 << 20):
                langs, score = model.predict([t or "" for t in x.column("text").to_pylist()])
                kept = {n: x.column(n) for n in x.schema.names}
                yield pa.record_batch(kept | {pred: pa.array(langs, pa.string()), score_name: pa.array(score, pa.float64())})

    return run


def identify(docs: DataFrame, samples: tuple, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows with two columns added (or replaced): the language of the column text, and the score."""
    docs = docs.drop(pred, score)
    shared = docs.sparkSession.sparkContext.broadcast(Model([(k, list(v)) for k, v in samples]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return spread(docs).mapInArrow(_predict(shared, pred, score), f"{fields}, `{pred}` string, `{score}` double")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text", held_out().alias("held_out")), learn(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")
