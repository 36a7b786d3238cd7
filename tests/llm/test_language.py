import random

from strandloom.llm import language


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "wh", "tion", "ou"], "bb": ["sch", "ung", "ä", "keit", "ei"], "cc": ["ción", "ar", "ñ", "illo", "que"]}
    rows = []
    for i in range(n):
        k = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[k], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 80))), k, "s", 0))
    return rows, parts


def test_accuracy_and_edges(spark):
    rows, parts = corpus()
    mixed = " ".join(parts["aa"] * 30 + parts["bb"] * 25)
    rows += [(1000, None, "aa", None, 1), (1001, "", "bb", None, 1), (1002, "12 . 3", None, None, 1), (1003, mixed, None, None, 1), (1003, mixed, None, None, 1), (1004, "a", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    model = language.fit(df)
    out = language.identify(df, model).collect()
    assert len(out) == len(rows)
    plain = [r for r in out if r.doc_id < 1000]
    assert sum(r.lang_pred == r.lang for r in plain) / len(plain) > 0.97
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert {x.lang for x in by[1003].languages} == {"aa", "bb"} and 0.4 < by[1003].score < 0.7
    assert by[1004].lang_pred in parts and all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.fit(df)).head().lang_pred == "und"
    assert language.identify(df.limit(0), language.fit(df)).count() == 0


def slow(model, text):
    """Expectation-maximisation trigram by trigram, and the nested sets one after the other."""
    import math

    found = language.trigrams(text).tolist()
    r = [model.p[t].tolist() for t in found]

    def em(rows):
        pi = [1 / len(rows[0])] * len(rows[0])
        for _ in range(language.ROUNDS):
            new = [0.0] * len(pi)
            for row in rows:
                whole = sum(a * b for a, b in zip(pi, row))
                for i, x in enumerate(row):
                    new[i] += pi[i] * x / whole / len(rows)
            done = max(abs(a - b) for a, b in zip(pi, new)) < 1e-4
            pi = new
            if done:
                break
        return [x / sum(pi) for x in pi]

    shares = em(r)
    order = sorted(range(len(shares)), key=lambda i: -shares[i])
    best, fit = [1.0], sum(math.log(row[order[0]]) for row in r)
    cost = language.PENALTY * math.log(len(r) + 1)
    for k in range(2, len(order) + 1):
        if shares[order[k - 1]] < 1e-3:
            break
        own = [[row[i] for i in order[:k]] for row in r]
        pi = em(own)
        new = sum(math.log(sum(a * b for a, b in zip(pi, row))) for row in own)
        if new - cost * (k - 1) <= fit - cost * (len(best) - 1):
            break
        best, fit = pi, new
    return sorted(((model.languages[i], p) for i, p in zip(order, best)), key=lambda x: (-x[1], x[0])), fit / len(r)


def test_mixtures_against_brute_force(monkeypatch):
    import numpy as np

    rows, parts = corpus(150)
    languages = sorted(parts)
    counts = np.zeros((len(languages), language.BUCKETS))
    for _, text, lang, *_ in rows:
        counts[languages.index(lang)] += np.bincount(language.trigrams(text), minlength=language.BUCKETS)
    model = language.Model(languages, counts)
    texts = [rows[0][1], rows[1][1] + " " + rows[2][1] + " " + rows[5][1], " ".join(r[1] for r in rows[:12]), "a"]
    for text in texts:
        chosen, fit = model.mixture(text)
        want, want_fit = slow(model, text)
        assert [k for k, _ in chosen] == [k for k, _ in want] and np.allclose([s for _, s in chosen], [s for _, s in want]) and np.isclose(fit, want_fit)
    sorted_at, sorted_n = language.counts(texts[2])
    monkeypatch.setattr(language, "SHORT", 0)
    monkeypatch.setattr(language, "PIECE", 50)
    at, n = language.counts(texts[2])
    want = np.bincount(language.trigrams(texts[2]), minlength=language.BUCKETS)
    assert (at == np.flatnonzero(want)).all() and (n == want[at]).all() and (at == sorted_at).all() and (n == sorted_n).all()
