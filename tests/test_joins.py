import random

import pytest
from pyspark.sql import functions as F

from loomlog.operators.joins import frequent_keys, spread_left_join
from loomlog.plans import relations as plans
from loomlog.sources.scratch import stored


def rows_of(df):
    return sorted(map(str, df.select("k", "i", "v").collect()))


@pytest.fixture
def sides(spark):
    rng = random.Random(2)
    keys = [None if x < 0.6 else "hot" if x < 0.9 else f"k{rng.randrange(400)}" for x in (rng.random() for _ in range(8000))]
    left = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), *[(f"k{j}", j) for j in range(0, 400, 2)]], "k string, v int")
    return left, right


def test_spread_join_equals_join(spark, sides):
    left, right = sides
    want = rows_of(left.join(right, "k", "left"))
    assert rows_of(spread_left_join(left, right, "k", ["i"])) == want
    assert rows_of(spread_left_join(left, right, "k", ["i"], counted=left)) == want
    assert rows_of(spread_left_join(left.filter("false"), right, "k", ["i"], counted=left.filter("false"))) == []
    assert rows_of(spread_left_join(left, right.filter("false"), "k", ["i"], counted=left)) == rows_of(left.withColumn("v", F.lit(None)))


def test_null_and_frequent_keys_spread_over_tasks(spark, sides):
    left, right = sides
    held = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(held, ("16", "false", "-1")):
            spark.conf.set(c, v)
        assert [r.k for r in frequent_keys(left, "k", 16).collect()] == ["hot"]

        def sizes(df):
            return sorted(r[0] for r in df.filter("v is null or v <> 2").groupBy(F.spark_partition_id()).count().select("count").collect())

        plain = sizes(left.join(right, "k", "left").select("v"))
        spread = sizes(spread_left_join(left, right, "k", ["i"], counted=left).select("v"))
        assert plain[-1] > 10 * plain[len(plain) // 2] and spread[-1] < 2 * spread[len(spread) // 2]
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)


def test_right_side_is_shuffled_however_small_its_estimate(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 100_000)
        log = stored(spark.range(20_000).select("id", F.expr("parse_json('[{\"k\":\"k' || id || '\"}]')").alias("content")))
        blocks = log.select("id", F.explode(F.try_variant_get("content", "$", "array<variant>")).alias("block"))
        # Over 100,000 bytes; a VARIANT counts as 2 kB, so Spark takes the keys for a hundredth of the file.
        keys = blocks.select(F.try_variant_get("block", "$.k", "string").alias("k"), F.col("id").alias("v"))
        left = stored(spark.range(0, 40_000, 2).select(F.col("id").alias("i"), F.concat(F.lit("k"), "id").alias("k")))
        joined = spread_left_join(left, keys, "k", ["i"])
        assert sum(r.v is not None for r in joined.collect()) == 10_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_ad_hoc_runs_queries_alone(spark):
    spark.range(3).selectExpr("id", "repeat('x', 1000) AS t").createOrReplaceTempView("adhoc_t")
    got = plans.ad_hoc(spark, "WITH a AS (SELECT * FROM adhoc_t) SELECT id, t, t FROM a ORDER BY id DESC -- last first\n;", limit=2)
    assert got.columns == ["id", "t", "t"] and [tuple(r) for r in got.collect()] == [(i, "x" * 200 + "…", "x" * 200 + "…") for i in (2, 1)]
    assert plans.ad_hoc(spark, "SELECT * FROM range(900)", limit=10_000).count() == 500
    for sql in ("DROP VIEW adhoc_t", "SET a.b=1", "CREATE TABLE nope AS SELECT 1", "SELECT 1; DROP VIEW adhoc_t", "SELECT 1); DROP VIEW adhoc_t; SELECT (1", "INSERT INTO adhoc_t SELECT 1, 'a'", "CACHE TABLE adhoc_t"):
        with pytest.raises(Exception, match="PARSE"):
            plans.ad_hoc(spark, sql)
    assert spark.table("adhoc_t").count() == 3
