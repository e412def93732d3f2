"""Skew-proof ranks and running totals against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlens.operators import joins
from fieldlens.operators.ordering import global_rank, hash_bucket, hash_order, ranked, running_sums, suffix_max


def _skewed(spark):
    # one key holds most rows, one score most of those
    data = [(i, "hot" if i % 3 else f"k{i % 7}", 0.9 if i % 2 else (i * 37 % 100) / 100, i % 5 == 0) for i in range(4000)]
    return spark.createDataFrame(data, "id long, k string, score double, hit boolean")


def test_ranked_equals_window(spark):
    df = _skewed(spark).withColumn("h", hash_order(1, "id"))
    got = ranked(df, ["k"], [F.col("h")], hash_bucket(F.col("h"), 1), "r", "n")
    w = Window.partitionBy("k")
    want = df.select("id", F.row_number().over(w.orderBy("h")).cast("long").alias("r"), F.count("*").over(w).alias("n"))
    assert got.select("id", "r", "n").exceptAll(want).isEmpty() and got.count() == 4000


def test_running_amount(spark):
    df = _skewed(spark).withColumn("h", hash_order(1, "id"))
    got = ranked(df, [], [F.col("h")], hash_bucket(F.col("h"), 2), "run", amount=F.col("id"))
    want = df.select("id", F.sum("id").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert got.select("id", "run").exceptAll(want).isEmpty()


def test_global_rank_and_running_sums(spark):
    df = _skewed(spark)
    order = [F.desc("score"), F.col("id")]
    got = global_rank(df, order, "r").select("id", "r")
    want = df.select("id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("r"))
    assert got.exceptAll(want).isEmpty()
    sums = running_sums(df, ["k"], order, {"tp": F.col("hit").cast("int")})
    w = Window.partitionBy("k").orderBy(*order)
    want = df.select("id", F.sum(F.col("hit").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("tp"))
    assert sums.select("id", "tp").exceptAll(want).isEmpty()
    peaks = suffix_max(sums, ["k"], "score", "m").select("id", "m")
    want = df.select("id", F.max("score").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("m"))
    assert peaks.exceptAll(want).isEmpty()


def test_cumcount_hot_and_ordinary_keys_agree(spark):
    random.seed(3)
    data = [(1 if i % 3 else i, hash((i, 7)) % 1000003, i) for i in range(900)]
    media = spark.createDataFrame(data, "coreid long, o long, n long").withColumn("ord", F.md5(F.concat_ws("|", "o", "n")))
    occ = media.select(F.col("coreid").alias("id")).distinct().withColumn("datasetKey", F.lit("d"))
    want = media.select("coreid", "ord", (F.row_number().over(Window.partitionBy("coreid").orderBy("ord")) - 1).cast("long").alias("cnt"))
    for hot_rows in (5, 1_000_000):
        args = dict(order=[F.col("ord")], bucket=hash_bucket(F.col("ord"), 1), hot_rows=hot_rows)
        assert joins.cumcount(media, **args).select("coreid", "ord", "cnt").exceptAll(want).isEmpty()
        both = joins.indexed_images(media, occ, **args)
        assert both.count() == 900 and both.select("coreid", "ord", "cnt").exceptAll(want).isEmpty()


def test_no_branch_for_hot_keys_without_any(spark, tmp_path):
    path = str(tmp_path / "media")
    spark.range(300).select((F.col("id") % 90).alias("coreid"), F.md5(F.col("id").cast("string")).alias("ord")).write.parquet(path)
    media = spark.read.parquet(path)
    occ = media.select(F.col("coreid").alias("id")).distinct()
    args = dict(order=[F.col("ord")], bucket=hash_bucket(F.col("ord"), 1))
    for df, scans in ((joins.indexed_images(media, occ, **args), 2), (joins.cumcount(media, **args), 1)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation") == scans and "LeftAnti" not in plan and "LeftSemi" not in plan and df.count() == 300
