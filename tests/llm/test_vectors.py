import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandloom.llm import neighbours, topk


def vectors(n=900, dim=24, seed=5):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    x = (centres[rng.integers(0, 8, n)] + 0.7 * rng.standard_normal((n, dim))) * rng.lognormal(0, 0.4, (n, 1))
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(n)]
    rows[60] = (60, rows[61][1], 1)  # equal vectors tie
    bad = [(1000, None, 0), (1050, [], 0), (1100, [1.0, None], 0), (1101, [float("nan")] * dim, 0), (1102, [float("inf")] * dim, 0), (1150, [0.0] * dim, 0), (1200, [1.0, 2.0], 0), (1201, [2.0, 1.0], 0)]
    return rows + bad


def brute(rows, score, k, zero):
    use = [(i, v) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for i, v in use:
        if i % 50 == 0:
            own = sorted((-score(v, w), j) for j, w in use if j != i and len(w) == len(v))[:k]
            out[i] = [(j, -s) for s, j in own]
    return out


@pytest.fixture
def frame(spark):
    rows = vectors()
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)


def test_top_k(frame, monkeypatch):
    rows, df = frame
    whole = lambda v: np.floor(256 * np.array(v)).astype(int)
    want = brute(rows, lambda v, w: int(whole(v) @ whole(w)), 5, True)
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {i: v for i, v in want.items() if v}
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest(frame):
    rows, df = frame
    cosine = lambda v, w: float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w)))
    want = brute(rows, cosine, 5, False)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert abs(r.score - cosine(dict((i, v) for i, v, _ in rows)[r.query_id], dict((i, v) for i, v, _ in rows)[r.vec_id])) < 1e-12
    hits = [len({j for j, _ in got.get(i, [])} & {j for j, _ in v}) for i, v in want.items()]
    assert all(len(got.get(i, [])) == len(v) for i, v in want.items())
    assert sum(hits) / sum(map(len, want.values())) >= 0.9
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_and_bound():
    p = np.random.default_rng(1).standard_normal((1000, neighbours.PROJECTED))
    leaves = neighbours.tree(p)
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= neighbours.LEAF
    x = neighbours.bound(0.95)
    sample = (np.random.default_rng(2).standard_normal((200_000, neighbours.PROJECTED)) ** 2).sum(1)
    assert abs((sample < x).mean() - 0.95) < 0.01


def test_recall_over_many_blocks(spark):
    rng = np.random.default_rng(11)
    n, dim = 45_000, 32
    centres = rng.standard_normal((60, dim))
    x = centres[rng.integers(0, 60, n)] + 0.6 * rng.standard_normal((n, dim))
    x[:6000] = x[0]  # a hot cell
    x[:6000] += 1e-3 * rng.standard_normal((6000, dim))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    unit = x / np.sqrt((x**2).sum(1, keepdims=True))
    whole = np.floor(256 * x)
    asks = F.col("vec_id") % 100 == 0
    got, exact = {}, {}
    for r in neighbours.nearest(df, asks).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for r in topk.top_k(df, asks).collect():
        exact.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for q in range(0, n, 100):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(got[q] & set(np.argsort(-near, kind="stable")[:5].tolist()))
        score = whole @ whole[q]
        score[q] = -np.inf
        top = np.lexsort((np.arange(n), -score))[:5]
        assert [exact[q][k] for k in range(1, 6)] == [(int(i), int(score[i])) for i in top]
    recall = hits / (5 * len(got))
    print(f"recall over {-(-n // 2048)} blocks: {recall:.4f}")
    assert len(got) == 450 and recall >= 0.95


def test_repeated_queries_and_long_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (None, [5.0, 5.0]), *[(i, [float(i), 10.0 - i]) for i in range(1, 10)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for search in (topk.top_k, neighbours.nearest):
        found = sorted((r.rank, r.vec_id) for r in search(df, F.col("vec_id") == 0).collect())
        # two queries of id 0, each with five of its own
        assert [r for r, _ in found] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] and all(i for _, i in found)
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e18]), (1, [1e18])], "vec_id long, embedding array<double>"), F.lit(True))
