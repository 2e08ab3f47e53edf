import numpy as np
import pyarrow as pa
from quire.llm import passages as P

DATA = "/root/testdata/sf0.001"


def brute_windows(v, least):
    out, todo = [], [(0, len(v))]
    while todo:
        s, e = todo.pop()
        if e - s < least:
            continue
        c = s + int(np.argmin(v[s:e]))
        out.append((s, c, e - 1))
        todo += [(s, c), (c + 1, e)]
    return sorted(out)


def test_windows_against_recursion():
    rng = np.random.default_rng(9)
    sizes = [0, 3, 60, 200, 7]
    v = rng.permutation(sum(sizes)).astype(np.uint64)
    offsets = np.cumsum([0, *sizes])
    got = sorted(zip(*map(lambda x: x.tolist(), P.compact_windows(v, offsets, 5))))
    want = sorted((l + o, c + o, r + o) for o, n in zip(offsets, sizes) for l, c, r in brute_windows(v[o : o + n], 5))
    assert got == want
    # every passage of the least length or more has its minimum named by exactly one window that holds it
    o, n = offsets[2], 60
    for i in range(n):
        for j in range(i + 4, n):
            c = o + i + int(np.argmin(v[o + i : o + j + 1]))
            assert sum(l <= o + i and o + j <= r and k == c for l, k, r in got) == 1
    assert len(P.compact_windows(np.zeros(10_000, dtype=np.uint64), np.array([0, 10_000]), 5)[0]) == 1


def words(rng, n):
    return ["".join(chr(c) for c in rng.integers(97, 123, 5)) for _ in range(n)]


def test_planted_passages_and_edges(spark):
    rng = np.random.default_rng(10)
    shared, near = words(rng, 60), words(rng, 90)
    changed = list(near)
    changed[30], changed[31] = "other", "words"
    rows = [(i, " ".join(words(rng, 80) + shared + words(rng, 40)), "x") for i in range(12)]
    rows += [(20, " ".join(words(rng, 70) + near + words(rng, 30)), "x"), (21, " ".join(words(rng, 5) + changed + words(rng, 66)), "x")]
    rows += [(30 + i, " ".join(words(rng, 150)), "x") for i in range(10)]
    rows += [(50, None, "x"), (51, "", "x"), (None, rows[20][1], "x"), (52, " ".join(shared[:40]), None), (53, "spam " * 30_000, "y"), (54, "spam " * 30_000, "y"), (54, "spam " * 30_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string")
    got = P.near_duplicate_passages(docs).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert all(comp[i] == 0 for i in range(12)) and comp[20] == comp[21] == 20
    assert all(comp[i] == i for i in [*range(30, 40), 50, 51, 52]) and comp[53] == comp[54] == 53
    assert [r.component_id for r in got if r.doc_id is None] == [rows[20][0]]
    assert all(r.n_links >= 1 for r in got if r.doc_id in range(12)) and all(r.n_links == 0 for r in got if r.doc_id in range(30, 40))
    assert P.near_duplicate_passages(docs.limit(0)).collect() == []


def test_links_of_real_texts_are_true(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {}
    for d, t in texts.items():
        v, _ = P.shingles(pa.array([t]))
        sets[d] = [frozenset(v[i : i + P.LEAST].tolist()) for i in range(len(v) - P.LEAST + 1)]
    whole = {}
    for d, stretches in sets.items():
        for s in stretches:
            whole.setdefault(s, set()).add(d)
    comp = {r.doc_id: r.component_id for r in P.near_duplicate_passages(docs).collect()}
    for group in whole.values():  # equal passages are never missed
        assert len({comp[d] for d in group}) == 1


def components(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return {r.doc_id: r.component_id for r in P.near_duplicate_passages(docs).collect()}


def test_passages_whose_shingles_the_first_text_has_elsewhere(spark):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(40):
        shared = words(rng, 50)
        quotes = [w for i in range(0, 50, 8) for w in shared[i : i + 12] + words(rng, 30)]  # every shingle, never the passage
        texts += [" ".join(x) for x in (quotes, words(rng, 60) + shared + words(rng, 20), words(rng, 20) + shared + words(rng, 70))]
    comp = components(spark, texts)
    assert sum(comp[i + 1] == comp[i + 2] for i in range(0, 120, 3)) == 40
    assert all(comp[i] == i and comp[i + 1] == i + 1 for i in range(0, 120, 3))


def test_passages_of_repeated_lines_against_brute_force(spark):
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(40):
        lines = [words(rng, 10) for _ in range(5)]
        passage = [w for line in lines for w in line]
        pair = []
        for _ in range(2):
            early = [w for k in rng.permutation(5) for w in lines[k] + words(rng, 12)]
            pair.append(" ".join(early + words(rng, 60) + passage + words(rng, 30)))
        texts += pair
    texts += ["tick tock " * 40 + " ".join(words(rng, 70)), " ".join(words(rng, 70)) + " tick tock" * 30]
    whole = {}
    for d, text in enumerate(texts):
        w = text.split()
        for i in range(len(w) - 49):
            whole.setdefault(tuple(w[i : i + 50]), set()).add(d)
    comp = components(spark, texts)
    groups = {tuple(sorted(g)) for g in whole.values() if len(g) > 1}
    assert len(groups) == 41 and all(len({comp[d] for d in g}) == 1 for g in groups)


def test_recall_of_near_passages(spark):
    rng = np.random.default_rng(13)
    texts = []
    for _ in range(600):  # one word of 50 differs: 41 of 51 shingles are shared
        shared = words(rng, 50)
        changed = [*shared]
        changed[int(rng.integers(4, 46))] = "other"
        texts += [" ".join(words(rng, 20) + shared + words(rng, 20)), " ".join(words(rng, 25) + changed + words(rng, 15))]
    comp = components(spark, texts)
    found = sum(comp[i] == comp[i + 1] for i in range(0, 1200, 2))
    assert found >= 598, found
    assert len(set(comp.values())) == 1200 - found


def test_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rng = np.random.default_rng(14)
    line, shared = words(rng, 20), words(rng, 55)
    near = [[*shared] for _ in range(30)]
    for i, w in enumerate(near):
        w[10] = f"other{i % 3}"
    texts = [" ".join(words(rng, 60) + line + words(rng, 60)) for _ in range(30)] + [" ".join(words(rng, 60) + w + words(rng, 60)) for w in near]
    comp = components(spark, texts)
    assert all(comp[i] == i for i in range(30)) and {comp[i] for i in range(30, 60)} == {30}


def test_short_equal_texts_are_copies(spark):
    texts = ["short text", "short text", "another one", "", "", "a b " * 24, "a b " * 24]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.component_id, r.is_copy) for r in P.near_duplicate_passages(docs).collect()}
    assert got == {0: (0, False), 1: (0, True), 2: (2, False), 3: (3, False), 4: (4, False), 5: (5, False), 6: (5, True)}


def test_pairs_judged_together_agree_with_every_stretch_against_every_other():
    rng = np.random.default_rng(12)
    parts = []
    for kind in range(240):
        a = rng.integers(0, 1 << 31, 91)
        b = a.copy() if kind % 3 else rng.integers(0, 1 << 31, 91)
        if kind % 3 == 2:  # words changed, moved or repeated
            b[rng.integers(0, 91, int(rng.integers(1, 14)))] = rng.integers(0, 1 << 31)
        if kind % 5 == 0:
            b = np.roll(b, int(rng.integers(1, 91)))
        if kind % 7 == 0:
            cut = int(rng.integers(20, 70))
            b = np.concatenate([b[cut:], rng.integers(0, 1 << 31, int(rng.integers(0, 9))), b[:cut]])[:91]
        if kind % 11 == 0:
            b[5:25] = b[30:50]
        parts += [a[: int(rng.integers(46, 92))], b[int(rng.integers(0, 40)) :]]
    sizes = np.array([len(x) for x in parts])
    data, ends = np.concatenate(parts).astype(np.int32), np.cumsum(sizes)
    p, q = np.arange(0, len(parts), 2), np.arange(1, len(parts), 2)
    verdict = P.near_pairs(data, ends - sizes, ends, p, q)
    want = [P.similar(parts[i].astype(np.int32), parts[j].astype(np.int32)) for i, j in zip(p, q)]
    assert [bool(v) for v, w in zip(verdict, want) if v < 2] == [w for v, w in zip(verdict, want) if v < 2]
    assert set(verdict.tolist()) == {0, 1, 2} and 20 < sum(want) < 220
    for i, j, w in zip(p, q, want):
        x, y = parts[i].astype(np.int32), parts[j].astype(np.int32)
        if len(np.unique(x)) == len(x) and len(np.unique(y)) == len(y):
            assert P.boxed(x, y) == w if len(x) >= 46 and len(y) >= 46 else not w
        assert bool(P.group_links([x, y], [0, 0], np.zeros(2, dtype=np.int64))) == w


def variants(rng):
    """A line of many texts, passages of many texts that differ in a word, and texts that only one stretch of a later text ties to the others."""
    line, shared, tail = words(rng, 20), words(rng, 55), words(rng, 30)
    texts = [" ".join(words(rng, 60) + line + words(rng, 60)) for _ in range(20)]
    for i in range(24):
        w = [*shared]
        w[10 + i % 6] = f"other{i % 3}"
        texts.append(" ".join(words(rng, 60) + w + words(rng, 60)))
    texts.append(" ".join(words(rng, 40) + shared + words(rng, 40)))  # the first text with the passage
    texts += [" ".join(words(rng, 40) + shared + tail + words(rng, 40)) for _ in range(2)]  # it goes on only in later ones
    w = shared[25:] + tail
    for k in (8, 17, 26, 35):
        c = [*w]
        c[k] = f"change{k}"
        texts.append(" ".join(words(rng, 40) + c + words(rng, 40)))
    return [*texts, "tick tock " * 40 + " ".join(line), " ".join(line) + " tick tock" * 30]


def test_no_result_depends_on_the_size_of_a_group(spark, monkeypatch):
    texts = variants(np.random.default_rng(15))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = []
    for most in (1024, 8, 2):
        monkeypatch.setattr(P, "BLOCK", most)
        rows.append(sorted(map(tuple, P.near_duplicate_passages(docs).collect())))
    assert rows[0] == rows[1] == rows[2]
    comp = {r[0]: r[1] for r in rows[0]}
    assert all(comp[i] == i for i in range(20)) and {comp[i] for i in range(44, 51)} == {comp[44]}


def test_parts_of_a_common_line_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rng, met, save = np.random.default_rng(16), [], P.save

    def counted(df, label):
        out = save(df, label)
        met.extend([out.count()] if label in ("large-groups-left", "open-groups") else [])
        return out

    monkeypatch.setattr(P, "save", counted)
    line = words(rng, 20)
    comp = components(spark, [" ".join(words(rng, 60) + line + words(rng, 60)) for _ in range(60)])
    assert all(comp[i] == i for i in range(60)) and met and sum(met) == 0


def test_undominated_stretches_are_as_near_to_any_other_part():
    rng = np.random.default_rng(17)
    for _ in range(300):
        pool = np.arange(60)
        a = np.concatenate([1000 + np.arange(int(rng.integers(0, 30))), pool[int(rng.integers(0, 10)) :][:50], 2000 + np.arange(int(rng.integers(0, 30)))])
        b = np.concatenate([3000 + np.arange(int(rng.integers(0, 20))), pool, 4000 + np.arange(9)])
        hit = rng.integers(0, len(a), int(rng.integers(0, 8)))
        a[hit] = np.where(rng.random(len(hit)) < 0.5, 5000 + hit, rng.integers(0, 60, len(hit)))
        values, times = np.unique(a, return_counts=True)
        alone = ~np.isin(a, b) & (times[np.searchsorted(values, a)] == 1)
        many = len(a) - P.LEAST + 1
        if many < 1:
            continue
        keep = P.undominated(alone, np.arange(many), np.full(many, many), np.arange(many))
        near = [P.similar(a[s : s + P.LEAST], b) for s in range(many)]
        assert any(near) == any(n for n, k in zip(near, keep) if k)


def test_minima_against_every_stretch():
    rng = np.random.default_rng(18)
    for least in (1, 2, 5, 46):
        sizes = [0, 3, least, 120, 0, 45, least + 1]
        v = rng.integers(0, 40, sum(sizes)).astype(np.uint64)
        offsets = np.cumsum([0, *sizes])
        want = set()
        for o, e in zip(offsets[:-1], offsets[1:]):
            for s in range(o, e - least + 1):
                want |= {s + int(k) for k in np.flatnonzero(v[s : s + least] == v[s : s + least].min())}
        assert P.minima(v, offsets, least).tolist() == sorted(want)


def test_stretches_of_the_same_shingles_go_on_once():
    line, n = np.arange(100, 113), 91  # a repeated line: its stretches are turns of one another
    raw = np.tile(line, 7).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    value = np.array([5, 5])
    key = P._shingle_keys(np.full(13, 5), line)
    known = [[{"key": int(k), "n": 2} for k in key]] * 2
    kind = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(value), pa.array([raw, raw[: 3 * n - 12]]), pa.array(known, type=kind)], names=["w", "value", "part", "known"])
    rows = pa.Table.from_batches(P._stretches(iter([batch])))
    assert rows.column("w").to_pylist() == [1, 2] and len(set(rows.column("key").to_pylist())) == 1
    assert rows.column("d").to_pylist() == [13, 13]


def test_parts_need_four_fifths_of_a_stretch():
    parts = [np.arange(91), np.tile(np.arange(13), 7), np.concatenate([np.arange(50), np.arange(10)])]
    raw = [x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() for x in parts]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 5, 5]), pa.array([0, 1, 2]), pa.array(raw)], names=["value", "w", "part"])
    rows = pa.Table.from_batches(P._kinds(iter([batch]))).to_pylist()
    for w, x in enumerate(parts):
        need = {r["need"] for r in rows if r["w"] == w}
        least = min(-(-4 * len(set(x[s : s + P.LEAST])) // 5) for s in range(len(x) - P.LEAST + 1))
        assert len(need) == 1 and 1 <= need.pop() <= least
    assert {r["need"] for r in rows if r["w"] == 0} == {37}


def test_equal_parts_go_on_once(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    rng, rows, save = np.random.default_rng(19), {}, P.save

    def counted(df, label):
        out = save(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(P, "save", counted)
    core = words(rng, 160)
    comp = components(spark, [" ".join(words(rng, 60) + core + words(rng, 60)) for _ in range(30)])
    assert set(comp.values()) == {0}
    assert rows["different-parts"] < rows["large-parts"]
