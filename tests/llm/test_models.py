"""Operators 2, 6 and 7: held-out accuracy, planted cases, and odd rows."""

import random
import zlib

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.llm import decontaminate, language_id, toxicity

from .conftest import ODD

LARGER = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = toxicity.op2_toxicity_ftrl(spark, LARGER).collect()
    assert len(rows) == 10_000 and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    mine = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y in mine if y], [s for s, y in mine if not y]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / len(bad) / len(good) > 0.95


def test_toxicity_reads_no_held_out_label(spark, docs):
    labels = spark.createDataFrame([(i, 1) for i in range(200) if held(i)], "doc_id long, toxic int")
    at, w = toxicity.learn(docs.select("doc_id", "text"), labels)
    assert len(at) == 0


def test_toxicity_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, None), (None, 1), (13, 0), (11, 1)], "doc_id long, toxic int")
    model = toxicity.learn(odd, labels)
    replaced = toxicity.score(odd.withColumn("predicted", F.lit("x")), model)
    assert replaced.columns.count("score") == 1 and {r.predicted for r in replaced.collect()} <= {0, 1}
    rows = toxicity.score(odd.select("doc_id", "text"), model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    empty = toxicity.learn(odd, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd.select("doc_id", "text"), empty).collect()} == {0}
    assert toxicity.score(none.select("doc_id", "text"), model).count() == 0


def test_language_on_held_out_rows(spark, sf_dir, docs):
    true = {r.doc_id: r.lang for r in docs.collect()}
    rows = language_id.op6_language_id(spark, sf_dir).collect()
    mine = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == true[r.doc_id] for r in mine) / len(mine) > 0.97


def test_phrases_are_greedy_longest_matches():
    model = language_id.Model([("a", ["abcabd"]), ("b", ["zzzz"])])

    def greedy(text, sample):
        n = at = 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            n, at = n + 1, at + k
        return n

    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("abcdz") for _ in range(rng.randrange(1, 60)))
        got = model.phrases(*language_id.letters([text]))[0].tolist()
        assert got == [greedy(text, "abcabd"), greedy(text, "zzzz")]


def test_language_on_odd_rows(spark, odd, none, docs):
    samples = language_id.learn(docs)
    clash = language_id.identify(odd, samples)  # a column named score is there already: it is replaced
    assert clash.columns.count("score") == 1 and clash.where("score = 1.5").count() == 0
    rows = {r.doc_id: r for r in language_id.identify(odd.drop("score"), samples).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 13))
    assert {rows[4].lang_pred, rows[8].lang_pred} <= {"de", "en", "es", "fr"}
    assert language_id.identify(none.drop("score"), samples).count() == 0
    assert language_id.learn(none) == ()
    assert {r.lang_pred for r in language_id.identify(odd.drop("score"), ()).collect()} == {"und"}


ITEMS = [(0, " ".join(f"item{k}" for k in range(30))), (1, "short items must match as a whole"), (2, None), (3, ""), (4, " ".join(f"other{k}" for k in range(13)))]


def brute_overlap(text, item):
    words = lambda t: "".join(chr(c).lower() if chr(c).isalnum() or c >= 128 else " " for c in (t or "").encode()).split()
    d, q = words(text), words(item)
    if not q:
        return False
    width = min(len(q), 13)
    need = 11 if width == 13 else -(-8 * width // 10) if width >= 9 else width
    return any(sum(a == b for a, b in zip(d[s : s + width], q[o : o + width])) >= need for o in range(len(q) - width + 1) for s in range(len(d) - width + 1))


def test_overlaps_with_substitutions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        item = (ITEMS[0][1] if i % 3 else ITEMS[4][1] if i % 2 else ITEMS[1][1]).split()
        a = rng.randrange(len(item))
        part = item[a : a + rng.randrange(5, 31)] if i % 5 else list(item)
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "changed"
        around = [rng.choice(["item3", "other2", "filler", "Item7!"]) for _ in range(rng.randrange(20))]
        rows.append((i, " ".join([*around, *part, *around]).title() if i % 2 else ", ".join([*around, *part, *around])))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    want = {(i, k) for i, t in rows for k, q in ITEMS if brute_overlap(t, q)}
    assert got == want and 40 < len(want) < 240


def test_masks_find_every_pair_of_substitutions():
    from itertools import combinations

    for gone in combinations(range(decontaminate.OVERLAP), decontaminate.OVERLAP - decontaminate.MATCH):
        assert any(all(o + k not in gone for k in m) for m in decontaminate.MASKS for o in range(decontaminate.OVERLAP - m[-1]))


def test_overlaps_on_odd_rows_and_in_blocks(spark, odd, none, monkeypatch):
    bench = spark.createDataFrame([*ITEMS, (9, ODD[4][1]), (10, "na " * 40)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, bench).collect()}
    assert got == {(4, 9), (5, 9), (6, 9), (7, 10)}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(odd, bench).collect()} == got
    assert decontaminate.overlaps(none, bench).count() == 0 == decontaminate.overlaps(odd, bench.limit(0)).count()


def test_alphabets_of_any_size():
    """Two languages of 2,000 letters each, none in common, many texts of a few letters: all letters count."""
    rng = random.Random(5)
    alphabets = {"a": [chr(0x4E00 + k) for k in range(2000)], "b": [chr(0x4E00 + 2000 + k) for k in range(2000)]}
    sample = [(k, ["".join(rng.choices(v, k=256)) for _ in range(64)]) for k, v in alphabets.items()]
    model = language_id.Model(sample)
    texts = [("".join(rng.choices(alphabets[k], k=20)), k) for k in "ab" for _ in range(100)]
    langs, score = model.predict([t for t, _ in texts])
    assert sum(a == b for a, (_, b) in zip(langs, texts)) == 200 and min(score) > 0.9
    assert len(model.table) < 3 * sum(len(t) for _, v in sample for t in v) + 5000


def test_sample_comes_from_whole_texts(spark):
    rows = [(i, "1" * 1200 + " the quick brown fox jumps over it" if i % 2 else "2" * 1200 + " der flinke braune Fuchs springt", "en" if i % 2 else "de") for i in range(100)]
    rows += [(200 + i, "123 456", "en") for i in range(100)] + [(400, "x", "rare")]
    samples = dict(language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert set(samples) == {"en", "de", "rare"}
    assert sum(map(len, samples["en"])) > 500 and "quick" in "".join(samples["en"]) and "1" not in "".join(samples["en"])


def test_more_languages_than_the_bounds(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_TEXTS", 8)
    monkeypatch.setattr(language_id, "ALL_LETTERS", 400)
    rows = [(i, f"{chr(97 + i % 20)} " * 50, f"l{i % 20}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language_id.learn(docs)
    assert len(samples) == 20 and all(len(v) == 1 for _, v in samples)
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, samples).collect()}
    assert all(got[i] == k for i, _, k in rows)


@pytest.mark.parametrize("n", range(1, 5))
def test_items_below_five_words_are_found_and_marked(spark, n):
    item = " ".join(f"s{k}" for k in range(n))
    rows = [(1, f"x {item} y"), (2, item), (3, item.upper() + "!"), (4, " ".join(["s0", "z", *[f"s{k}" for k in range(1, n)]]) if n > 1 else "z"), (5, "nothing"), (6, None)]
    bench = spark.createDataFrame([(7, item), (None, item + " and more words than five")], "item_id long, text string")
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id, r.item_words) for r in got} == {(k, 7, n) for k in (1, 2, 3)}


def test_word_hashes_tell_long_words_apart():
    import numpy as np

    from lagloom.llm.common import Words

    signs = [bin(k).count("1") % 2 for k in range(1024)]
    words = ["".join("ab"[s] for s in signs), "".join("ba"[s] for s in signs), "a", "a\0", "aaaaaaaa", "aaaaaaaaa", "a" * 512, "a" * 513, "b" * 70_000, "a"]
    data = " ".join(words).encode()
    h = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hashes()
    assert len(set(h.tolist())) == len(words) - 1 and h[2] == h[-1]


def test_training_is_ftrl_proximal_coordinate_by_coordinate():
    """Against a plain dictionary of coordinates."""
    rng = random.Random(3)
    rows = []
    for _ in range(60):
        label = rng.randrange(2)
        words = {rng.randrange(30) + 30 * label * (rng.random() < 0.8) for _ in range(12)}
        rows.append((sorted(words) + [toxicity.BIAS], label))
    z, n = {}, {}

    def weight(i):
        if i not in z:
            return 0.0
        rate = (toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA
        if i == toxicity.BIAS:
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= toxicity.L1 else -(z[i] - math.copysign(toxicity.L1, z[i])) / (rate + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, label in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in x:
                sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / toxicity.ALPHA
                z[i] = z.get(i, 0) + g - sigma * w[i]
                n[i] = n.get(i, 0) + g * g
    want = {i: weight(i) for i in z if weight(i) != 0}
    at, w = toxicity.train([(np.array(x), label) for x, label in rows])
    got = dict(zip(at.tolist(), w.tolist()))
    assert set(got) == set(want) and 5 < len(want) < 61 and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_labelled_sample_is_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 5_000)
    monkeypatch.setattr(toxicity, "train", lambda rows: seen.append(len(rows)) or (np.zeros(0, np.int64), np.zeros(0)))
    docs = spark.createDataFrame([(i, f"word{i} " * 100) for i in range(200)], "doc_id long, text string")
    toxicity.learn(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    assert 3 <= seen[0] <= 8
