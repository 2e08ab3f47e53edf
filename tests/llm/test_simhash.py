import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.components import connected_components

DATA = "/root/testdata/sf0.001"


def brute_fp(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_edges(spark):
    rows = [(3, None, "x"), (1, "", "x"), (None, "", None), (2, "a", "y"), (2, "a", "y"), (9, "A", "z"), (4, "a b", None), (5, "w " * 50_000, "q"), (6, "W " * 50_000, "q"), (None, "lonely words here now", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == brute([r[:2] for r in rows])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[0] for r in kept.collect()), key=repr) == sorted([1, 2, 4, 5, None], key=repr)
    none = docs.limit(0)
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_one(none).collect() == []


@pytest.mark.parametrize("wide", [2, 64])
def test_links_connect_what_brute_force_links(wide):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 4), dtype=np.uint64)
    fps = np.unique(base[rng.integers(0, 5, 400)] ^ np.bitwise_xor.reduce(flips, axis=1))
    a, b = simhash.links_within(np.zeros(len(fps), dtype=np.int64), fps.view(np.int64), wide=wide) if wide < len(fps) else ([], [])

    def groups(pairs):
        parent = {int(x): int(x) for x in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            parent[find(int(x))] = find(int(y))
        return {x: min(y for y in parent if find(y) == find(x)) for x in parent}

    true = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if int(x ^ y).bit_count() <= 3]
    assert groups(zip(np.asarray(a).view(np.uint64), np.asarray(b).view(np.uint64))) == groups(true)


def test_every_pair_meets_at_an_anchor():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    keys, index = simhash.anchors_of(np.concatenate([x, y]))
    at = [set() for _ in range(600)]
    for k, i in zip(keys, index):
        at[i].add(int(k))
    assert all(at[i] & at[i + 300] for i in range(300))


def test_heavy_anchor_is_split(spark):
    fps = [(i << 60) ^ (1 << b) for i in range(2) for b in range(20)]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = connected_components(simhash.fingerprint_links(nodes, block=4))
    assert roots.groupBy("root").agg(F.count("node").alias("n")).collect()[0]["n"] >= 20


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
