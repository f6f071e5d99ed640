"""Near copies and the pipeline's near-duplicate stage against brute force."""

import random

import corpus_pipeline
from lagloom.llm import near_copies

from .test_duplicates import components


def shingles(text):
    w = bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode()).split()
    return frozenset(b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(texts):
    s = [shingles(t) for t in texts]
    near = [(a, b) for b in range(len(s)) for a in range(b) if s[a] == s[b] or 9 * len(s[a] & s[b]) >= 4 * (len(s[a]) + len(s[b]))]
    return components(range(len(s)), near), near


def partition(named):
    out = {}
    for i, c in named.items():
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def corpus():
    """Chains of edits, texts around the threshold, one group of many members, and a common passage in unlike texts."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choices(vocabulary, k=25)
    texts = ["", None, " \n", "one two", "One  two", "one two three", "a b c d e", "a b c d e f"]
    for n in [6, 9, 12, 30, 60, 120, 400]:
        for _ in range(8):
            base = rng.choices(vocabulary, k=n)
            for _ in range(6):
                words = list(base)
                for _ in range(rng.randrange(1 + n // 25)):
                    words[rng.randrange(n)] = rng.choice(vocabulary)
                words = words[: n - rng.randrange(1 + n // 8)]
                texts.append(" ".join(words))
                base = words if rng.random() < 0.3 else base
                n = len(base)
    base = rng.choices(vocabulary, k=100)
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices(vocabulary, k=rng.randrange(2, 60)) + passage) for _ in range(100)]
    return texts


def test_groups_equal_brute_force(spark, none, monkeypatch):
    monkeypatch.setattr(near_copies, "PIVOT_ROWS", 20)
    texts = corpus()
    want, near = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group for r in near_copies.groups(df).collect()}
    assert len(near) > 1000 and partition(got) == partition(want)
    assert near_copies.groups(none).count() == 0


def test_nothing_depends_on_pivots(spark, monkeypatch):
    """A path of links: both pivots of a key are unlike most of its members."""
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words[k : k + 60]) for k in range(0, 120, 4)]
    want, near = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group for r in near_copies.groups(df).collect()}
    assert near and partition(got) == partition(want)


def test_stage_keeps_one_of_near_copies(spark, sf_dir):
    words = [f"w{k}" for k in range(120)]
    near, unlike = list(words), list(words)
    near[3] = near[60] = "x"
    unlike[10::20] = ["y"] * 6
    rows = [(5, " ".join(words)), (2, " ".join(near)), (7, " ".join(words)), (9, " ".join(unlike)), (1, " ".join(words[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, sf_dir).collect()) == [1, 2, 9]


def family(n=260, edits=(1, 9), words=120):
    """Edits of one text, many of them just below the threshold to most others, and texts that share a few of these edits."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(words)]
    texts = [" ".join(base)]
    while len(texts) < n:
        x = texts[rng.randrange(len(texts))].split() if rng.random() < 0.1 else list(base)
        for _ in range(rng.randrange(*edits)):
            k, what = rng.randrange(len(x)), rng.randrange(4)
            x[k : k + 1] = [[f"x{rng.randrange(10**6)}"], ["w0"], [], [x[k], "w1"]][what]
        texts.append(" ".join(x[: len(x) - rng.choice([0, 0, 0, rng.randrange(20)])]))
    return texts


def test_pairs_of_a_family_do_not_grow_with_its_square(spark, monkeypatch):
    texts = family()
    want, near = brute(texts)
    made, write = {}, near_copies.materialize

    def counted(df, tag, *args):
        out = write(df, tag, *args)
        made.setdefault(tag, []).append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.group for r in near_copies.groups(df).collect()}
    assert len(set(want.values())) > 40 and partition(got) == partition(want)
    assert made["cross"][0] <= 2 * len(texts), made


def test_edits_lose_no_link(spark):
    """Whatever node is the hub: every similar pair of members that are not both linked to it is found."""
    texts = [t for t in dict.fromkeys(family(90, (1, 7), 60) + corpus()[8:150:3]) if shingles(t)]
    sets = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    prints = near_copies.materialize(near_copies._texts(df).mapInArrow(near_copies._print_batches, "doc_id long, text_key long, node long, fp long, keys array<long>"), "prints")
    for r in prints.select("doc_id", "node").collect():
        sets[r.node] = shingles(texts[r.doc_id])
    similar = lambda a, b: 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    nodes, rng = sorted(sets), random.Random(2)
    rows, want = [], set()
    for hub in [prints.where("doc_id = 0").first().node, *rng.sample(nodes, 3)]:
        root = {x: hub if similar(x, hub) else x for x in nodes}
        rows += [(hub, x, root[x]) for x in nodes]
        want |= {(a, b) for a in nodes for b in nodes if a > b and root[a] != root[b] and similar(a, b)}
    members = spark.createDataFrame(rows, "hub long, node long, root long")
    found = {(r.u, r.v) for r in near_copies._by_edits(df, prints, members).collect()}
    assert len(want) > 20 and want <= found
