import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetloom.functions.ordered import as_of_join, first_per_key, with_global_number, with_previous
from tests.conftest import tuples


def hot_series(spark, n=4000):
    """One series has most rows, one a single row, one a NULL key; order values have gaps."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        rows.append((key, rng.randrange(100000), i))
    rows.append(("single", 5, n))
    return spark.createDataFrame(rows, "k STRING, t INT, id INT")


def test_previous_equals_plain_lag(spark):
    df = hot_series(spark)
    got = with_previous(df, ["k"], ["t", "id"], {"pt": "t", "pid": "id"})
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumns({"pt": F.lag("t").over(w), "pid": F.lag("id").over(w)})
    assert got.columns == want.columns
    assert tuples(got) == tuples(want)


@pytest.fixture()
def many_ranges(spark):
    """Ranges stay as small as they are dealt out."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_previous_does_not_depend_on_ranges_or_layout(spark, many_ranges):
    df = hot_series(spark, 1000)
    w = Window.partitionBy("k").orderBy("t", "id")
    want = tuples(df.withColumn("p", F.lag("id").over(w)))
    for n, ranges in ((1, 1), (7, 5), (3, 23), (2, 400)):
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        assert tuples(with_previous(df.repartition(n), ["k"], ["t", "id"], {"p": "id"})) == want


def test_previous_of_repeated_rows(spark, many_ranges):
    df = spark.createDataFrame([("a", 1)] * 300 + [("a", 2)] * 300 + [("b", 1)], "k STRING, t INT")
    got = with_previous(df, ["k"], ["t"], {"p": "t"}).groupBy("k", "t", "p").count()
    assert tuples(got) == tuples(spark.createDataFrame(
        [("a", 1, None, 1), ("a", 1, 1, 299), ("a", 2, 1, 1), ("a", 2, 2, 299), ("b", 1, None, 1)], "k STRING, t INT, p INT, count BIGINT"))


def test_previous_of_nothing(spark):
    assert with_previous(spark.createDataFrame([], "k STRING, t INT"), ["k"], ["t"], {"p": "t"}).count() == 0


def test_previous_with_null_order_value_and_value(spark):
    df = spark.createDataFrame([("a", None, 1, None), ("a", 1, 2, "x"), ("a", 9, 3, None), ("a", 10, 4, "y")],
                               "k STRING, t INT, id INT, v STRING")
    got = with_previous(df, ["k"], ["t", "id"], {"p": "v"})
    assert tuples(got, "id", "p") == [(1, None), (2, None), (3, "x"), (4, None)]


@pytest.mark.parametrize("moments", [20000, 1])
def test_one_hot_series_is_spread_over_tasks(spark, many_ranges, moments):
    df = spark.range(20000).select(F.lit("hot").alias("k"), (F.col("id") % moments).alias("t"))
    got = with_previous(df, ["k"], ["t"], {"p": "t"})
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 8000
    assert got.where(F.col("p").isNull()).count() == 1
    assert got.where(F.col("p") != F.col("t") - (1 if moments > 1 else 0)).count() == 0


def test_first_per_key_limits_before_the_shuffle(spark):
    df = hot_series(spark)
    got = first_per_key(df, ["k"], ["t", "id"], 2)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()
    assert got.groupBy("k").count().agg(F.max("count")).first()[0] == 2


def test_global_number(spark):
    rows = [(f"name{i % 50:03d}", i) for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "name STRING, id INT").repartition(13)
    got = {r["n"]: (r["name"], r["id"]) for r in with_global_number(df, ["name", "id"], "n").collect()}
    assert [got[i + 1] for i in range(1000)] == sorted(rows)


def test_global_number_of_nothing(spark):
    assert with_global_number(spark.createDataFrame([], "a INT"), ["a"], "n").count() == 0


def test_as_of_join_by_brute_force(spark):
    rng = random.Random(6)
    pick = lambda: (rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(40)]))
    left = [(*pick(), i, "x") for i in range(400)]
    right = [(*pick(), i % 7, f"v{i % 5}") for i in range(300)]
    want = []
    for k, t, i, x in left:
        held = [(rt is not None, rt or 0, a, b) for rk, rt, a, b in right if rk == k and (rt is None or (t is not None and rt <= t))]
        if held:
            *_, a, b = max(held)
            want.append((k, t, i, x, a, b))
    asked = spark.createDataFrame(left, "k INT, t INT, i INT, x STRING").repartition(3)
    facts = spark.createDataFrame(right, "k INT, t INT, a INT, b STRING").repartition(5)
    got = as_of_join(asked, facts, ["k"], "t", ["a", "b"])
    assert got.columns == ["k", "t", "i", "x", "a", "b"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_as_of_join_spreads_a_key_with_most_of_the_rows(spark):
    asked = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") % 10_000).alias("t"), "id")
    facts = spark.range(3).select(F.lit(1).alias("k"), (F.col("id") * 4_000).alias("t"), F.col("id").alias("v"))
    # So few rows would be put together to one range otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_of_join(asked, facts, ["k"], "t", ["v"])
        per_task = [r["count"] for r in got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(per_task) == 20_000 and max(per_task) < 16_000
    assert got.where(F.col("v") != F.floor(F.col("t") / 4_000)).count() == 0
