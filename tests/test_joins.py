"""Size-checked and split joins, eager aggregation and posting clean-up against plain joins."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.operators.eager import eager_join_aggregate
from spindrift.operators.postings import valid_postings
from spindrift.plans import hot_words, runtime
from spindrift.plans.runtime import hot_keys, join_checked, join_split, shared_dir


@pytest.fixture(scope="module")
def skewed(spark):
    left = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("key"), F.col("id").alias("x"))
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5), ("zz", 6)], "key string, y int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join(spark, skewed, how):
    left, right = skewed
    plain = sorted(map(str, left.join(right, "key", how).collect()))
    assert [r[0] for r in hot_keys(left, ["key"], 0.05).collect()] == ["hot"]
    assert sorted(map(str, join_split(left, right, ["key"], how, share=0.05, splits=5).select(*left.join(right, "key", how).columns).collect())) == plain
    assert sorted(map(str, join_checked(left, right, ["key"], how, rows=0).select(*left.join(right, "key", how).columns).collect())) == plain
    assert sorted(map(str, join_checked(left, right, ["key"], how).select(*left.join(right, "key", how).columns).collect())) == plain


def test_eager_aggregation_equals_join_then_group(spark, skewed):
    left, right = skewed
    left = left.withColumn("g", F.col("x") % 4).withColumn("y", F.lit("clash"))
    right = right.unionByName(right)
    got = eager_join_aggregate(left, right, "key", ["g"], sums={"sx": F.col("x")}, right_sums={"sy": F.col("y")}, best={"b": F.struct("x", "key")})
    plain = left.drop("y").join(right, "key").groupBy("g").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.max(F.struct("x", "key")).alias("b"))
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert eager_join_aggregate(left.limit(0), right, "key", ["g"]).collect() == []
    once = eager_join_aggregate(left, right, "key", ["key"], unique_right=True)
    assert {r["key"]: r["n_rows"] for r in once.collect()}["hot"] == left.where("key = 'hot'").count()


T = dt.datetime(2024, 1, 1)
ROWS = [
    ("Tea ", 1, 3, T), ("tea", 1, 5, T + dt.timedelta(1)), ("TEA ", 1, None, T + dt.timedelta(2)), ("tea", 1, -1, T + dt.timedelta(3)), ("tea", 1, 5, T + dt.timedelta(1)),
    (None, 1, 1, T), (" \t", 1, 1, T), ("tea", None, 1, T), ("tea", 99, 1, T), ("leaf", 2, 1, None), ("tea", 2, 5, T), ("x" * 100_000, 2, 1, T),
]


def _index(spark, rows=ROWS):
    return spark.createDataFrame(rows, "word string, page_id long, frequency int, indexed_at timestamp").withColumn("idf", F.lit("clash"))


def _ids(spark):
    return spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "id long, word string")


def test_valid_postings(spark):
    got = sorted((r["word"][:5], r["page_id"], r["frequency"]) for r in valid_postings(_index(spark), _ids(spark)).collect())
    assert got == [("leaf", 2, 1), ("tea", 1, 5), ("tea", 2, 5), ("xxxxx", 2, 1)]


def test_hot_words(spark):
    got = sorted((r["word"][:5], r["page_id"]) for r in hot_words.leading_pages(_index(spark), _ids(spark)).collect())
    assert got == [("leaf", 2), ("tea", 1), ("xxxxx", 2)]
    assert hot_words.leading_pages(_index(spark), _ids(spark), share=0.4).collect()[0]["word"] == "tea"
    assert hot_words.leading_pages(_index(spark, []), _ids(spark)).collect() == []
    idf = spark.createDataFrame([("TEA", 2.0), ("tea", None), ("none", 1.0)], "word string, idf double")
    assert [tuple(r) for r in hot_words.weighted_totals(_index(spark).drop("idf"), _ids(spark), idf).collect()] == [("tea", 2, 10, 4.0)]


def test_shared_dir_needs_a_setting_on_a_cluster(spark):
    assert shared_dir(spark)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_one_row_a_page(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", broadcast_rows)
    rows = [(1, "a", None), (1, "a", None), (2, "b", "x"), (3, None, None), (4, "c", "y"), (4, "b", "z"), (None, "d", "d"), (None, "d", "d")]
    pages = spark.createDataFrame(rows, "id long, url string, content string").withColumn("extra", F.lit(1))
    got = sorted(map(tuple, runtime.distinct_pages(pages, "url", "content").collect()), key=str)
    assert got == sorted([(1, "a", None), (2, "b", "x"), (3, None, None), (4, "b", "z")], key=str)
    assert runtime.distinct_pages(pages.limit(0), "url").collect() == []


def test_hot_words_beyond_the_broadcast_limit(spark, monkeypatch):
    index = spark.createDataFrame([("page", k, k % 5 + 1) for k in range(40)] + [("tea", 3, 9), ("cup", 99, 9)], "word string, page_id long, frequency int").withColumn("indexed_at", F.expr("timestamp '2024-01-01'"))
    pages = spark.createDataFrame([(k,) for k in range(50)], "id long")
    plain = sorted(map(tuple, hot_words.leading_pages(index, pages).collect()))
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, hot_words.leading_pages(index, pages).collect())) == plain == [("page", 4), ("tea", 3)]
