import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F
from tests.llm.test_simhash import brute

import corpus_pipeline
from quire.llm import decontaminate, mixing, toxicity

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def windows(text, n):
    w = WORD.findall(low(text))
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def test_stages_against_brute_force(spark):
    docs, labels, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = docs.collect()
    model = toxicity.learn(docs, labels)
    left = [r for r in rows if toxicity.judge(model, pa.array([r.text]))[0][0] < 0.3]
    component = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in left])}
    left = [r for r in left if component[r.doc_id] == r.doc_id]
    bad = {w for b in bench.collect() for w in windows(b.text, 10)} | {tuple(WORD.findall(low(b.text))) for b in bench.collect() if 0 < len(WORD.findall(low(b.text))) < 10}
    left = [r for r in left if not any(w in bad for n in {len(x) for x in bad} for w in windows(r.text, n))]
    kept = spark.createDataFrame(left, docs.schema)
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix(kept).collect()}
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == [*docs.columns, "shard_id", "shard_row_bytes"]
    got = out.collect()
    want = Counter({d: -(-t // s) if s else 1 for d, (t, s) in taken.items()})
    assert Counter(r.doc_id for r in got) == +want
    texts = {r.doc_id: r.text for r in left}
    words = Counter()
    for r in got:
        full = re.split(r"[\x20\x09-\x0D]+", texts[r.doc_id].strip(" \t\n\x0b\x0c\r"))
        mine = re.split(r"[\x20\x09-\x0D]+", r.text.strip(" \t\n\x0b\x0c\r"))
        assert full[: len(mine)] == mine and r.n_chars == len(r.text) and r.shard_row_bytes == len(r.text.encode())
        words[r.doc_id] += len(mine) if mine != [""] else 0
    assert all(words[d] == t for d, (t, _) in taken.items())


def test_stages_pass_odd_rows(spark):
    rows = [(None, "lonely words stay here", None, "en", 3, 9), (1, None, "a", None, None, 9), (1, "", "a", "en", 0, 9), (2, "x y z " * 20_000, "b", "fr", 1, 9), (2, "x y z " * 20_000, "b", "fr", 1, 9), (3, "one two three four", "b", "de", 4, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, `shard.key` int").withColumn("uid", F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        assert out.count() >= 2, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
