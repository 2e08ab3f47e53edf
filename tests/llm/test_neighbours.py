import math

import numpy as np
import pytest
from quire.llm import neighbours as N


def brute(rows, nearest=5, every=50):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok[(i, tuple(0.0 if c == 0 else float(c) for c in v))] = 1
    items = list(ok)
    out = {}
    for i, v in items:
        if i % every == 0:
            scored = sorted(((-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), j) for j, w in items if j != i and len(w) == len(v)))
            out[i] = [(j, -s) for s, j in scored[:nearest]]
    return out


def test_within_is_exact():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    index = N.Index(codes)
    words = codes.view(np.uint64).reshape(-1)
    for radius in (0, 3, 7, 8, 20, 27, 64):
        for q in range(5):
            assert set(index.within(codes[q], radius)) == set(np.flatnonzero(np.bitwise_count(words ^ words[q]) <= radius))


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_recall_against_brute_force(spark, sf):
    vectors = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in N.search(vectors).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    hit = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hit / sum(map(len, want.values())) >= 0.9
    for q in got:
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        exact = dict(want[q])
        assert all(abs(s - exact[v]) < 1e-12 for v, s in got[q].values() if v in exact)


def test_great_and_small_components_and_clusters(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(c) for c in (centres[i % 12] + 0.1 * rng.normal(size=16)) * 10.0 ** rng.integers(-200, 200)]) for i in range(1500)]
    want = brute([(i, [c / max(map(abs, v)) for c in v]) for i, v in rows])
    got = {}
    for r in N.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        assert abs(r.score) <= 1 + 1e-12
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, -0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [0.0, 1.0]), (9, [0.0, 1.0]), (100, [1.0, 2.0, 3.0]), (10, [3.0, 2.0, 1.0])]
    rows += [(1000 + i * 7, [1.0, 1.0]) for i in range(40)]
    vectors = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, v int, ids int")
    want = brute(rows)
    got = {}
    for r in N.search(vectors).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: [v for _, v, _ in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items() if x}
    assert N.search(vectors.limit(0)).collect() == []
