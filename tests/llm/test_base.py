"""Joins that spread hot keys, and components of long and wide graphs, against plain Python."""

from pyspark.sql import functions as F

from tidemark.llm import base, graph


def test_spread_join_equals_a_join(spark, monkeypatch):
    monkeypatch.setattr(base, "LEAST_HOT", 20)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 500 == 1, None).otherwise(F.col("id") % 700).alias("k"), "id")
    lookup = spark.range(0, 600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = base.spread_join(rows, lookup, "k")
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, rows.join(lookup, "k").select("k", "id", "v").collect()))
    assert base.spread_join(rows.limit(0), lookup, "k").count() == 0


def test_components_of_a_long_path_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(base, "LEAST_HOT", 50)
    path = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(5001, 7000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    loops = spark.createDataFrame([(9000, 9000), (None, 3), (9001, 9002), (9002, 9001)], "a long, b long")
    got = {r.node: r.root for r in graph.components(path.unionByName(star).unionByName(loops)).collect()}
    assert got == {i: 0 for i in range(1, 3001)} | {i: 5000 for i in range(5001, 7000)} | {9002: 9001}
    assert graph.components(path.limit(0)).count() == 0


def test_left_joins_keep_rows_without_a_partner(spark, monkeypatch):
    monkeypatch.setattr(base, "LEAST_HOT", 5)
    monkeypatch.setattr(base, "HOT_KEYS", 4)
    rows = base.checkpoint(spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 40 + ["cold"] * 3 + ["lost"] * 20 + ["rare", None])], "k string, n int"))
    lookup = spark.createDataFrame([("hot", 1), ("cold", 2), ("other", 3)], "k string, v int")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(lookup, ["k"], how).collect()))
        assert sorted(map(str, base.spread_join(rows, lookup, "k", how=how).collect())) == want
        assert len(want) == (43 if how == "inner" else 65)
