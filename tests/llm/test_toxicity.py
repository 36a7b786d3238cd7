import random

import numpy as np
from strandloom.llm import toxicity


def test_shared_backoff_is_a_distribution():
    keys, _ = toxicity.ngrams(["abc", "abd", "xbc", "b"])
    keys = np.unique(keys)
    p = toxicity.shared(keys)
    assert ((p > 0) & (p <= 1)).all()


def test_ngrams():
    keys, word = toxicity.ngrams(["ab", "c"])
    spell = [[(k >> (9 * i)) & 511 for i in range(4, -1, -1)] for k in keys.tolist()]
    assert spell == [[1, 1, 1, 1, 97], [1, 1, 1, 97, 98], [1, 1, 97, 98, 2], [1, 1, 1, 1, 99], [1, 1, 1, 99, 2]]
    assert word.tolist() == [0, 0, 0, 1, 1]


def test_accuracy_and_edges(spark):
    rng = random.Random(3)
    parts = ["the", "ing", "wh", "tion", "ou", "er", "an"]
    word = lambda: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = [word() for _ in range(rng.randrange(5, 60))]
        for _ in range(toxic * rng.randrange(1, 4)):
            text.insert(rng.randrange(len(text)), rng.choice(["vequ", "moron"]) + rng.choice(parts + [""]))
        docs.append((i, " ".join(text), 0.5))
        labels.append((i, 1, int(toxic)))
    docs += [(9000, None, 1.0), (9001, "", 1.0), (9002, "1 2", 1.0), (9002, "1 2", 1.0)]
    labels += [(3, 1, None), (9000, 0, 0), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, l)
    out = toxicity.score(d, model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 for r in out)
    right = sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in out if r.doc_id < 9000)
    assert right / 900 > 0.97
    assert all(r.score < 0.5 for r in out if r.doc_id >= 9000)
    assert toxicity.score(d, toxicity.fit(d, l.limit(0))).head().score == 0
    assert toxicity.score(d.limit(0), model).count() == 0


def brute_evidence(toxic, ordinary):
    """Difference of the class models' log-probabilities of each seven-letter expression, from tuples and dictionaries."""
    import math
    from collections import Counter

    def grams(counts):
        out = Counter()
        for w, n in counts.items():
            letters = [toxicity.BEFORE] * 6 + list(map(ord, w)) + [toxicity.AFTER]
            for i in range(6, len(letters)):
                out[tuple(letters[i - 6 : i + 1])] += n
        return out

    classes = [grams(toxic), grams(ordinary)]
    levels = [set(classes[0]) | set(classes[1])]
    counts = []
    for order in range(6, 0, -1):
        counts.append(Counter(g[-order:] for g in levels[-1]))  # distinct left neighbours
        levels.append(set(counts[-1]))
    counts = dict(zip(range(6, 0, -1), counts))

    def shared(g):
        if not g:
            return 1 / len(counts[1])
        own = {x: n for x, n in counts[len(g)].items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        return max(own[g] - 0.75, 0) / total + 0.75 * len(own) / total * shared(g[1:])

    def p(c, g):
        own = {x: n for x, n in c.items() if x[:-1] == g[:-1]}
        total = sum(own.values())
        left = 0.75 * len(own) / total if total else 1.0
        return max(c.get(g, 0) - 0.75, 0) / max(total, 1) + left * shared(g[1:])

    def conditional(c, context):
        """The probabilities of all that may follow a context."""
        return sum(p(c, context + (a,)) for (a,) in counts[1] if context[1:] + (a,) in counts[6])

    return {g: math.log(p(classes[0], g)) - math.log(p(classes[1], g)) for g in levels[0]}, classes, conditional


def test_evidence_against_brute_force():
    toxic = {"moron": 3, "more": 1, "the": 5, "trash": 2}
    ordinary = {"more": 4, "the": 20, "there": 3, "moral": 2}
    want, classes, conditional = brute_evidence(toxic, ordinary)
    tables = []
    for c in (toxic, ordinary):
        key, word = toxicity.ngrams(list(c))
        tables.append(dict())
        for k, w in zip(key.tolist(), word):
            tables[-1][k] = tables[-1].get(k, 0) + list(c.values())[w]
    keys = np.array(sorted({*tables[0], *tables[1]}), np.int64)
    model = toxicity.Model(keys, *(np.array([t.get(k, 0) for k in keys.tolist()]) for t in tables))
    spelt = [tuple((k >> (9 * i)) & 511 for i in range(6, -1, -1)) for k in model.keys.tolist()]
    assert np.allclose(model.evidence, [want[g] for g in spelt])
    word = model.judged(["moron"])[0]
    letters = [toxicity.BEFORE] * 6 + list(map(ord, "moron")) + [toxicity.AFTER]
    assert np.isclose(word, sum(want[tuple(letters[i - 6 : i + 1])] for i in range(6, len(letters))) / 6)
    assert model.strongest(["the moron", "the", "", None]).tolist() == [word, model.judged(["the"])[0], 0, 0]
    # What a class leaves goes to the shared model, which gives out no more than all of it
    for c in classes:
        for context in {g[:-1] for g in classes[0]} | {g[:-1] for g in classes[1]}:
            assert 0 < conditional(c, context) <= 1 + 1e-9


def test_letters_beyond_the_alphabet_are_one():
    alphabet = np.array(sorted(map(ord, "abё一")))
    spell = lambda w: [k & 511 for k in toxicity.ngrams([w], alphabet)[0].tolist()]
    assert spell("abё一丁") == [4, 5, 6, 7, toxicity.OTHER, toxicity.AFTER] and spell("Q") == [toxicity.OTHER, toxicity.AFTER]
    assert len(toxicity.words("a" * 5000 + " b")) == 2
