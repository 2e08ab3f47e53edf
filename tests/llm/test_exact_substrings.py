import hashlib

import numpy as np
from quire.llm import exact_substrings as S

DATA = "/root/testdata/sf0.001"


def brute(rows, length=100):
    """rows: (doc_id, text) in the order that counts."""
    seen, out = set(), []
    for i, (d, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            else:
                seen.add(w)
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_merge_against_sorting():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 99, int(rng.integers(1, 30)), dtype=np.uint8)) for _ in range(60)]
    shards = [S.Shard(texts[i : i + 13]) for i in range(0, 60, 13)]
    rows, block = S.merge(shards, depth=6)
    suffixes = []
    for s, at in zip(shards, range(0, 60, 13)):
        joined = [t[i:] for t in texts[at : at + 13] for i in range(len(t) + 1)]
        suffixes += [joined[p] for p in s.order]
    keys = [suffixes[r][:6] if len(suffixes[r]) >= 6 else None for r in rows]
    from collections import Counter

    count = Counter(x[:6] for x in suffixes if len(x) >= 6)
    assert sorted(rows) == [r for r, x in enumerate(suffixes) if len(x) >= 6 and count[x[:6]] > 1]
    assert keys == sorted(keys)
    assert all((block[i] == block[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(rows)))


def test_anchors_stand_for_every_window():
    rng = np.random.default_rng(7)
    texts = [bytes(rng.integers(97, 100, int(n), dtype=np.uint8)) for n in (0, 99, 100, 101, 500, 3000)] + [b"a" * 700]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    a = S.anchors(data, offsets)
    windows = sorted((d, p) for d, f, l in zip(a["doc"], a["first"], a["last"]) for p in range(f, l + 1))
    assert windows == [(d, p) for d, t in enumerate(texts) for p in range(len(t) - 99)]
    assert all(f <= at <= f + 68 and l <= at <= l + 68 for f, l, at in zip(a["first"], a["last"], a["at"]))


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted((tuple(r) for r in S.remove_repeats(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges_and_heavy_grams(spark, monkeypatch):
    rng = np.random.default_rng(8)
    line = "the line that many documents share, with more than thirty-two bytes in it; "
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, 6))
    rows = [(i, " ".join(word() for _ in range(9)) + line + " ".join(word() for _ in range(9))) for i in range(40)]
    rows += [(100, None), (101, ""), (None, "x" * 99), (102, "y" * 100), (103, "y" * 350), (104, "é" * 120), (105, "é" * 120), (105, "é" * 121), (None, "é" * 120)]
    rows += [(200 + i, rows[i][1][:150] + "#" + rows[i][1][20:]) for i in range(10)] + [(50, "ab" * 5000 + line * 3)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, uid string, ord int").coalesce(1)
    want = brute(rows)
    for heavy in (4000, 3):
        monkeypatch.setattr(S, "HEAVY", heavy)
        assert sorted((tuple(r) for r in S.remove_repeats(docs).collect()), key=repr) == want
    assert S.remove_repeats(docs.limit(0)).collect() == []
