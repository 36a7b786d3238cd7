import random
import re

import numpy as np
import pyarrow as pa
import pytest
from strandloom.llm import components, jaccard, shingles


def word_sets(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def brute(rows, width=3, percent=90):
    sets = [word_sets(t, width) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, *_) in enumerate(rows)), key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["the", "ing", "wh", "tion", "ou", "er", "an"], k=rng.randrange(1, 4)))
    passage = [word() for _ in range(60)]
    rows = []
    for size in (0, 1, 2, 3, 4, 11, 12, 13, 20, 21, 22, 30, 31, 60, 61, 100, 250, 600):
        for _ in range(4):
            base = [word() for _ in range(size)] + passage * (rng.random() < 0.4)
            for _ in range(rng.randrange(1, 7)):
                own = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                    if own:
                        at = rng.randrange(len(own))
                        own[at : at + rng.randrange(2)] = [word()]
                rows.append((len(rows) * 3 + 1, rng.choice([" ", "  ", "\n"]).join(own).title() if rng.random() < 0.3 else " ".join(own), "x"))
    rows += [(None, rows[-1][1], "x"), (5000, None, "x"), (5001, " \n", "x"), (7, rows[-2][1], "x"), (7, "one two", None), (5002, "ONE  two", "x"), (5003, "é É K", "x"), (5003, "é É K", "x")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 4])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.join_groups(df).collect()), key=str)
    assert got == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_groups(df).count() == 0
    df = spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join_groups(df).collect())) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_shingles():
    texts = ["a b c d", "A  B\tC\nd", None, "", "x", "x y", "a b c a b c", "w" * 5000 + " b c", " ", "x y z w"]
    out = list(shingles.sets(pa.array(texts, pa.string()), 3))
    assert [len(o) for o in out] == [len(word_sets(t)) for t in texts]
    assert (out[0] == out[1]).all() and out[4][0] != out[5][0]
    parts = list(shingles.sets(pa.array(texts, pa.string()).slice(3, 4), 3))
    assert all((a == b).all() for a, b in zip(parts, out[3:7]))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 200)] + [(1000 - i, 1001 - i) for i in range(100)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root if any(find(y) == find(x) for y in root if y != x)}
    assert got == want


def test_boundary():
    assert jaccard.boundary({2: 10, 50: 10}, 3.0) == 2
    assert jaccard.boundary({2: 10, 5: 10}, 30.0) == 5
    assert np.all(jaccard.slack(np.array([1, 9, 10, 19, 20])) == [0, 0, 1, 1, 2])


def test_one_of_each_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(30))
    rows = [(1, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (None, None), (2, text("d")), (3, text("d")), (3, text("e")), (3, text("f")), (None, text("g")), (None, text("g"))]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    gone = [(None, text("a")), (3, text("d"))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(r) for r in rows if r not in gone)


def inverted_brute(rows, width=3, percent=90):
    """As brute, comparing only rows that share a shingle which few have, besides those of equal sets and of few shingles."""
    sets = [frozenset(word_sets(t, width)) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    distinct = {}
    for i, s in enumerate(sets):
        if s:
            root[find(i)] = find(distinct.setdefault(s, i))
    nodes = sorted(distinct.values())
    for a, i in enumerate(nodes):
        for j in nodes[:a]:
            x, y = sets[i], sets[j]
            if find(i) != find(j) and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, *_) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, *_) in enumerate(rows)}


def test_large_families(spark):
    """A shingle that all documents share, near copies of one document, a long chain of candidates that don't link, and one of those that do."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    origin = [word() for _ in range(120)]
    texts = ["one two three " + " ".join(origin)]
    for _ in range(699):  # each near the origin, most not near each other
        own = list(origin)
        for _ in range(rng.choice([1, 2])):
            own[rng.randrange(len(own))] = word()
        texts.append("one two three " + " ".join(own))
    chain = [word() for _ in range(8 * 700)]
    texts += ["one two three " + " ".join(chain[8 * i : 8 * i + 13]) for i in range(690)]
    step = [word() for _ in range(60)]
    for i in range(150):
        step[i % 60] = word()
        if i % 2 == 0:
            texts.append("one two three " + " ".join(step))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.join_groups(df).collect()}
    want = inverted_brute(rows)
    assert got == want and len({want[i] for i in range(700)}) == 1 and len({want[i] for i in range(700, 1390)}) == 690


def test_frequent_shingles_and_parts_change_nothing(monkeypatch):
    """The first shared shingles of nodes, from the flushes of one task or several, with frequent shingles apart and ranges read by parts."""
    import pandas as pd

    rng = np.random.default_rng(5)
    names = [rng.bytes(16) for _ in range(300)]
    common = np.sort(rng.integers(0, 1 << jaccard.KEPT, 3)).astype(np.uint64)
    pool = rng.integers(0, 1 << jaccard.KEPT, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.choice(pool, 12)])) for _ in names]
    cut = lambda s: jaccard.slack(len(s), 60) + jaccard.SHARED - len(s)

    def first(flushes, ranges=3):
        blobs = pd.DataFrame([x for f in flushes for x in jaccard.flushed([sets[i] for i in f], [names[i] for i in f], [cut(sets[i]) for i in f], ranges)], columns=["part", "blob"])
        rows = pd.concat([jaccard.shared_of(g) for _, g in blobs.groupby("part")])
        found = pd.concat([jaccard.first_shared(g) for _, g in rows.groupby("flush")])
        return sorted((r.node, r.m, tuple(r.tokens)) for r in found.itertuples())

    def brute(hot):
        counts = {}
        for s in sets:
            for t in s.tolist():
                counts[t] = counts.get(t, 0) + 1
        out = []
        for name, s in zip(names, sets):
            own = sorted((min(counts[t], hot), t) for t in s.tolist() if counts[t] > 1)
            m = cut(s) + len(own)
            if m >= jaccard.SHARED:
                out.append((name, m, tuple(t for _, t in own[:m])))
        return sorted(out)

    everyone = list(range(len(names)))
    halves = [everyone[:140], everyone[140:]]
    assert first([everyone]) == first(halves) == brute(jaccard.HOT) and len(brute(jaccard.HOT)) > 200
    monkeypatch.setattr(jaccard, "HOT", 100)  # the common ones are frequent in each flush, and known to be
    assert first([everyone]) == first(halves) == first(halves, 1) == brute(100)
    monkeypatch.setattr(jaccard, "RANGE", 40)
    assert first(halves) == first(halves, 1) == brute(100)


def test_thresholds_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, "q", "z")], "doc_id long, text string, gone_id string")
    with pytest.raises(ValueError):
        jaccard.join_groups(df, percent=50)
    assert sorted(map(tuple, jaccard.one_of_each(df).collect())) == [(1, "a b c d e f", "x"), (3, "q", "z")]


def test_long_texts_are_taken_by_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000)) + " " + "v" * 9000 + " end of it"
    whole = list(shingles.sets(pa.array([text, "a b"]), 3))
    monkeypatch.setattr(shingles, "PART", 1 << 10)
    parts = list(shingles.sets(pa.array([text, "a b"]), 3))
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == len(word_sets(text))
