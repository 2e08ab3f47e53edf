import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, mixing, sharding
from quire.llm.sharding import Run, ShardStore

DATA = "/root/testdata/sf0.001"


def same(spark_rows, sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    want = sorted((tuple(r) for r in got.fetchall()), key=repr)
    mine = sorted((tuple(r[c] for c in cols) for r in spark_rows), key=repr)
    assert len(mine) == len(want)
    for a, b in zip(mine, want):
        assert a == pytest.approx(b) if any(isinstance(x, float) for x in a) and None not in a else a == b


ODD = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "a"), (3, "ÉAÉ x " * 3000, "é"), (3, "other", "Z"), (4, "-- ..", None), (5, "tiny item", "c"), (None, "W1 w2 w3 W4 w5 w6 w7 w8 w9 w10 tail", "c")]
ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10"), (2, "Tiny, ITEM"), (2, "tiny item"), (3, None), (4, ""), (None, "other"), (5, "ÉaÉ x ÉaÉ x ÉaÉ x ÉaÉ x ÉaÉ x ÉaÉ x"), (10, "tiny item")]


def odd(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id long, text string, source string, n_words int")
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_decontamination(spark):
    docs, items = odd(spark)
    same(decontaminate.decontaminate(docs, items).collect(), decontaminate.SQL, documents=docs, benchmark=items)
    same(decontaminate.decontaminate(docs, items.limit(0)).collect(), decontaminate.SQL, documents=docs, benchmark=items.limit(0))
    assert decontaminate.decontaminate(docs.limit(0), items).collect() == []
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == decontaminate.decontaminate(docs, items).where("not contaminated").count()


def test_every_shared_span_of_ten_words_is_found(spark):
    words = [f"q{i * 7919 % 1009}" for i in range(400)]
    docs = spark.createDataFrame([(i, f"pad{i} " * (i % 13) + " ".join(words[i : i + 10]) + f" end{i}") for i in range(390)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert decontaminate.decontaminate(docs, items).where("n_hit >= 10").count() == 390
    short = docs.select("doc_id", F.regexp_replace("text", r"q\d+ end", "end").alias("text"))
    assert decontaminate.decontaminate(short, items).where("contaminated").count() == 0


def test_mixing(spark):
    docs, _ = odd(spark)
    same(mixing.mix(docs).collect(), mixing.SQL, documents=docs)
    assert mixing.mix(docs.limit(0)).collect() == []
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(real, keep=("source",)).collect()
    total = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        total[r.source] = total.get(r.source, 0) + r.taken
    assert all(abs(total[r.source] - r.target) <= 1 for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-3


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1], [1, 1, 1000], [0, 5, 5], [0, 0, 0], [7]])
def test_targets_against_repeated_resharing(spark, sizes):
    rows = spark.createDataFrame([(False, f"s{i}", s) for i, s in enumerate(sizes)], "s_null boolean, s_name string, source_size long")
    got = {r.s_name: r.target for r in mixing.source_targets(rows).collect()}
    weights, caps = [(3, 1, 2)[i % 3] for i in range(len(sizes))], [2 * s for s in sizes]
    left, open_, want = 1.5 * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] >= caps[i]}
        for i in over or open_:
            want[i] = min(share[i], caps[i])
        left -= sum(want[i] for i in over or open_)
        open_ -= over or open_
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_store_versions_and_tiers(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=50_000, fan_in=3)
    for i in range(3):
        store.append(docs.where(F.pmod("doc_id", F.lit(3)) == i), "doc_id", "text")
    assert store.versions() == [1, 2, 3] and len(store.manifest()["runs"]) == 3
    before = store.read(3)
    assert store.compact() == 4
    assert before.count() == docs.count()  # an older version reads the same while its files are there
    after = store.read()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in docs.collect())
    sizes = [r.b for r in after.groupBy("shard_id").agg(F.sum("shard_row_bytes").alias("b")).collect()]
    assert len(sizes) > 3 and max(sizes) < 50_000 + after.agg(F.max("shard_row_bytes")).first()[0] * 2
    assert len(store.manifest()["runs"]) == 1 and store.compact() is None
    store.vacuum()
    assert store.read().count() == docs.count()
    # of two writers of one version one wins
    old = store.manifest()
    assert store._publish(old, [], None) and not store._publish(old, [], None)
    assert re.fullmatch(r"v5\.json", max(p.name for p in (tmp_path / "store/manifest").iterdir() if p.name.endswith("json")))


def test_shards_of_a_small_target_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.shard(docs, target_bytes=1 << 15)
    mine = rows.select("doc_id", F.col("shard_row_bytes").alias("n_bytes"), "shard_id", F.md5("text").alias("text_md5")).collect()
    assert len({r.shard_id for r in mine}) > 5
    same(mine, sharding.SQL.replace("67108864", str(1 << 15)), documents=docs)


def test_vacuum_spares_what_is_not_committed_and_runs_share_no_shard(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    store = ShardStore(spark, f"file://{tmp_path}/store", target_bytes=50_000, fan_in=2)
    third = lambda i: docs.where(F.pmod("doc_id", F.lit(3)) == i)
    store.append(third(0), "doc_id", "text")
    store.compact(final=True)
    third(1).write.parquet(f"file://{tmp_path}/store/runs/other/arrival=0")  # of a writer that has not committed
    store.vacuum()
    assert list((tmp_path / "store/runs/other/arrival=0").glob("*.parquet")) and store.read().count() == third(0).count()
    other = ShardStore(spark, f"file://{tmp_path}/other", target_bytes=50_000, fan_in=9)
    for i in (0, 1):
        other.append(third(i), "doc_id", "text")
        other._merge([Run(**r) for r in other.manifest()["runs"] if "shard=" not in r["files"][0]])
    sizes = [r["n"] for r in other.read().withColumn("f", F.input_file_name()).groupBy("shard_id").agg(F.countDistinct(F.regexp_extract("f", "runs/([0-9a-f]+)/", 1)).alias("n")).collect()]
    assert len(other.manifest()["runs"]) == 2 and set(sizes) == {1}


def test_sharding(spark):
    docs, _ = odd(spark)
    clash = docs.withColumn("shard", F.lit("x")).withColumn("arrival", F.lit("y"))
    rows = sharding.shard(clash)
    assert rows.columns == [*clash.columns, "shard_id", "shard_row_bytes"] and set(r.shard for r in rows.collect()) == {"x"}
    mine = rows.select("doc_id", F.col("shard_row_bytes").alias("n_bytes"), "shard_id", F.md5("text").alias("text_md5")).collect()
    same(mine, sharding.SQL, documents=docs)
    assert sharding.shard(docs.limit(0)).count() == 0
