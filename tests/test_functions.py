"""Array, sequence and join helpers against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codelake.functions.arrays import block_minima, blocks, first_at_most, running_sum
from codelake.functions.columns import glob_regex, repo_scope
from codelake.functions.sequences import carry_last
from codelake.functions.skew import first_rows, hot_keys, lookup_join, request_join


def test_running_sum_and_first_at_most(spark):
    rnd = random.Random(7)
    rows = []
    for n in (0, 1, 63, 64, 65, 128, 400):
        values = [rnd.randint(-3, 3) for _ in range(n)]
        for start, limit in ((1, -4), (max(1, n // 2), 0), (max(1, n), 100), (2, -1000)):
            rows.append((values, start, limit))
    df = spark.createDataFrame(rows, "a array<int>, s int, l int")
    out = (
        df.withColumn("sum", running_sum(blocks(F.col("a"))))
        .withColumn("hit", first_at_most(F.col("a"), block_minima(F.col("a")), F.col("s"), F.col("l")))
        .collect()
    )
    for r in out:
        assert r.sum == list(itertools.accumulate(r.a))
        want = next((i for i in range(r.s, len(r.a) + 1) if r.a[i - 1] <= r.l), None)
        assert r.hit == want


def test_carry_last_in_small_chunks(spark):
    rnd = random.Random(3)
    rows = []
    for key in ("a", "b"):
        order = sorted(rnd.sample(range(2000), 300))
        rows += [(key, o, f"v{o}" if rnd.random() < 0.05 else None) for o in order]
    df = spark.createDataFrame(rows, "k string, o long, v string")
    for chunk in (3, 50, 10_000):
        got = {(r.k, r.o): r.c for r in carry_last(df, ["k"], "o", "v", "c", chunk).collect()}
        for key in ("a", "b"):
            last = None
            for k, o, v in rows:
                if k == key:
                    last = v or last
                    assert got[(k, o)] == last


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_join_with_hot_keys(spark, no_broadcast):
    left = spark.range(1000).select(
        F.when(F.col("id") < 400, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id"
    )
    right = spark.createDataFrame(
        [("hot", 1), ("500", 2), ("none", 3)], "k string, v int"
    )
    assert [r.k for r in hot_keys(left, ["k"], 100).collect()] == ["hot"]
    for how in ("left", "inner"):
        want = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=repr)
        got = sorted(map(tuple, lookup_join(left, right, ["k"], how, hot_rows=100).collect()), key=repr)
        assert got == want


def test_lookup_join_spreads_the_hot_key(spark, no_broadcast):
    left = spark.range(1000).select(F.lit("hot").alias("k"), "id")
    right = spark.createDataFrame([("hot", 1)], "k string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = lookup_join(left, right, ["k"], hot_rows=10)
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_small_lookup_is_not_shuffled(spark):
    left = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    joined = lookup_join(left, spark.range(5).select(F.col("id").alias("k")), ["k"], "inner")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_request_join_beyond_the_bound(spark, monkeypatch):
    from codelake.functions import skew

    left = spark.range(100).select((F.col("id") % 10).alias("k"), "id")
    wanted = spark.range(5).select(F.col("id").alias("k"))
    small = sorted(map(tuple, request_join(left, wanted, ["k"]).collect()))
    monkeypatch.setattr(skew, "REQUEST_ROWS", 2)
    assert sorted(map(tuple, request_join(left, wanted, ["k"]).collect())) == small
    assert len(small) == 50


def test_first_rows_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = first_rows(df, ["k"], ["id"], 2)
    assert sorted((r.k, r.id) for r in top.collect()) == [(0, 0), (0, 3), (1, 1), (1, 4), (2, 2), (2, 5)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


def test_repo_scope(spark):
    roots = {
        "C:\\repos\\MyProject": "myproject", "/home/me/My Cool.Project/": "my-cool-project",
        "solo": "solo", "/a/--x--": "x",
    }
    df = spark.createDataFrame([(r,) for r in roots], "root string")
    for r in df.select("root", repo_scope().alias("s")).collect():
        assert r.s == roots[r.root]


def test_glob_regex_quotes(spark):
    df = spark.createDataFrame([("a+b/c.py",), ("aab/c.py",)], "p string")
    assert [r.p for r in df.filter(F.col("p").rlike(glob_regex("A+B/*.PY"))).collect()] == ["a+b/c.py"]


def test_null_keys_are_spread(spark, no_broadcast):
    left = spark.range(2000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"), "id")
    right = spark.range(0, 2000, 20).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    joined = lookup_join(left, right, ["k"], hot_rows=100)
    assert joined.count() == 2000 and joined.where("v is not null").count() == 100
    assert lookup_join(left, right, ["k"], "inner", hot_rows=100).count() == 100
    assert hot_keys(left, ["k"], 100).isEmpty()


def test_long_requests_are_not_broadcast(spark, monkeypatch):
    left = spark.range(500).select((F.col("id") % 50).cast("string").alias("k"), "id")
    wanted = spark.range(20).select(F.col("id").cast("string").alias("k"))
    small = sorted(map(tuple, request_join(left, wanted, ["k"]).collect()))
    monkeypatch.setattr("codelake.functions.skew.REQUEST_BYTES", 10)
    assert sorted(map(tuple, request_join(left, wanted, ["k"]).collect())) == small and len(small) == 200


def test_many_requests_are_never_broadcast(spark, monkeypatch):
    from codelake.functions import skew

    monkeypatch.setattr(skew, "REQUEST_ROWS", 10)
    left = spark.range(500).select((F.col("id") % 100).alias("k"), "id")
    requests = spark.range(0, 40, 2).select(F.col("id").alias("k"))
    joined = request_join(left, requests, ["k"])
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in joined.collect()) == [i for i in range(500) if i % 100 < 40 and i % 2 == 0]


def test_requests_are_repeated_for_hot_keys_only(spark, monkeypatch):
    from codelake.functions import skew

    monkeypatch.setattr(skew, "REQUEST_ROWS", 10)
    left = spark.range(500).select((F.col("id") % 100).alias("k"), "id")
    requests = spark.range(0, 40, 2).select(F.col("id").alias("k"))
    joined = request_join(left, requests, ["k"], counted=left)
    assert "sequence(0, 15" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.id for r in joined.collect()) == [i for i in range(500) if i % 100 < 40 and i % 2 == 0]
    plain = request_join(left, requests, ["k"])
    assert sorted(plain.collect()) == sorted(joined.collect())
