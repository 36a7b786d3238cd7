import re

from strandloom.llm import mixing


def water(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what stands above a stop is shared again among the rest."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > most * sizes[s]}
        for s in over or free:
            out[s] = float(most * sizes[s]) if over else unit * w[s]
        left -= sum(out[s] for s in over)
        free -= over or free
    return out


def test_plan_and_mix(spark):
    rows = []
    for s, n in (("a", 3), ("b", 40), ("c", 400), (None, 7), ("d", 1), ("é", 5)):
        rows += [(len(rows) + i, " ".join(f"w{j}" for j in range(1 + i % 9)) + " \n", s, 0, "x") for i in range(n)]
    rows += [(9000, None, "b", 0, "x"), (9001, "", "c", 0, None), (9002, "r r", "c", 0, "x"), (9002, "r r", "c", 0, "x"), (None, "n", "c", 0, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, size string")
    got = mixing.plan(df).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    want = water(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(3)).collect()))
    mixed = mixing.mix(df).collect()
    words = {}
    for r in mixed:
        words[r.source] = words.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text) or r.n_chars == 0
    assert words == {s: n for s, n in taken.items() if n}
    assert mixing.mix(df).columns == df.columns


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(df).count() == 0 and mixing.mix(df).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.plan(df).collect()] == [(0.0, 0)] * 2


def test_helper_names_as_columns(spark):
    rows = [(1, "a b c", "s", 7, 8, 9, 10, 11, 12), (2, "d e", "s", 1, 2, 3, 4, 5, 6), (2, "d e", "s", 1, 2, 3, 4, 5, 7), (3, None, None, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, words_ int, key_ int, take_ int, id_ int, size_ int, row_ int")
    got = sorted(map(tuple, mixing.mix(df).collect()))
    assert got == rows[:3] and mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_ranges_grow_with_the_rows():
    assert [mixing.range_digits(n) for n in (0, 10**6, 10**8, 10**9, 10**12)] == [2, 2, 3, 3, 6]


def test_very_long_text(spark):
    long = " ".join(["word"] * 300_000)
    df = spark.createDataFrame([(1, long, "a"), (2, "b c", "a"), (3, "d", "b")], "doc_id long, text string, source string")
    plan = {r.doc_id: r for r in mixing.plan(df).collect()}
    assert plan[1].size == 300_000 and plan[3].taken <= 3
    assert sum(r.taken for r in plan.values()) == sum(len(r.text.split()) for r in mixing.mix(df).collect())
