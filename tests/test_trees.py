from pyspark.sql import functions as F

from quire.operators import trees


def test_trees_of_any_number_of_rows_and_levels(spark):
    """Recursive SQL stops at a bound on its rows and at 100 levels; joins have neither. Doubled keys count twice, cycles aloof don't count."""
    chain = spark.range(1, 121).select(F.col("id").alias("k"), (F.col("id") - 1).alias("up"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("size"))
    odd = spark.createDataFrame([(3, 2, None), (500, 501, 1), (501, 500, 1), (900, 899, 1)], "k long, up long, size long")
    got = trees.descend(chain.union(odd), "k", "up", F.col("up") == 0, ["size"]).collect()
    assert len(got) == 2 + 2 * 118 and {r.k for r in got} == set(range(1, 121))
    assert all(r.depth == r.k - 1 and r["size"] == (r.k // 50 * 50 or None) for r in got)
    spark.conf.set("spark.sql.cteRecursionRowLimit", 50)
    try:
        import __spark_entry__ as entry

        for name in ("page_tree", "actual_text", "role_maps"):
            assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 5
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_chains_end_or_stop(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, None), (10, 1), (10, 4)], "a long, b long")
    assert sorted(map(tuple, trees.follow(links, "a", "b", 5).collect())) == [(1, 4, 3), (2, 4, 2), (3, 4, 1), (7, 8, 5), (8, 7, 5), (9, None, 1), (10, 4, 4)]
