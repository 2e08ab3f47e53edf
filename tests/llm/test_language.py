import zlib

import numpy as np
import pyarrow as pa
from quire.llm import language as L

DATA = "/root/testdata/sf0.01"


def brute_viterbi(scores, penalty):
    n, k = scores.shape
    best = scores[0].astype(float)
    back = []
    for t in range(1, n):
        total = best[:, None] - penalty * (1 - np.eye(k))
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + scores[t]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best.max()


def path_score(scores, path, penalty):
    return sum(scores[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_against_one_sequence_at_a_time():
    rng = np.random.default_rng(3)
    sizes = np.array([5, 0, 1, 30, 2, 17])
    scores = rng.normal(size=(sizes.sum(), 3)) * 3
    labels = L.viterbi(scores, sizes, 2.0)
    at = 0
    for n in sizes:
        if n:
            part = scores[at : at + n]
            assert np.isclose(path_score(part, labels[at : at + n], 2.0), brute_viterbi(part, 2.0)[1])
        at += n


def test_viterbi_with_more_languages_than_a_byte_holds():
    scores = np.zeros((6, 300))
    scores[np.arange(6), [299, 299, 128, 128, 128, 200]] = 9
    assert L.viterbi(scores, np.array([5, 1]), 2.0).tolist() == [299, 299, 128, 128, 128, 200]


def test_mixed_text_is_labelled_in_spans():
    model = L.train([("aa", "kalo mano telo rano " * 200), ("bb", "wusch pfung dritz schur " * 200), ("ru", "привет как дела мир " * 100)])
    text = "kalo telo mano rano kalo mano wusch pfung schur dritz wusch pfung привет мир"
    _, _, _, labels = L.tag(model, pa.array([text]))
    assert [model.languages[x] for x in labels] == ["aa"] * 6 + ["bb"] * 6 + ["ru"] * 2
    names, scores = L.predict(model, pa.array(["", None, "12 34", "мир", "kalo"]))
    assert names == ["und", "und", "und", "ru", "aa"] and list(scores[:3]) == [0, 0, 0]


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = L.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    rows = [(None, "le de la", "fr", "x"), (1, None, "en", "x"), (1, "", None, "y"), (2, "the and of " * 90_000, "en", "z"), (2, "the and", None, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string")
    names = sorted((str(r.doc_id), r.lang_pred) for r in L.identify(odd).collect())
    assert len(names) == 5 and names.count(("1", "und")) == 2
    assert L.identify(odd.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(odd.withColumn("lang", odd.lang.substr(9, 1)).where("false")).collect()} == set()
