"""Ranks and orders agree with a plain sort, whatever the number of buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.ranks import (
    global_order, group_head, in_ranges, rank_average, rank_average_global, smallest_step,
)


def brute_ranks(values):
    ordered = sorted(values)
    return {v: ordered.index(v) + (ordered.count(v) + 1) / 2 for v in set(values)}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    # A third of the table is one value, the rest has ties and singles.
    data = [(i, "ab"[i % 2], 7.0 if i % 3 == 0 else float(rng.randrange(200)) / 4) for i in range(900)]
    return spark.createDataFrame(data, "i int, g string, v double").cache()


@pytest.mark.parametrize("ranges", [None, 10, 200])
def test_global_average_rank(rows, ranges):
    expected = brute_ranks([r.v for r in rows.collect()])
    ranked = rank_average_global(rows, "v", ranges=ranges).collect()
    assert len(ranked) == 900
    assert all(r["rank"] == expected[r.v] for r in ranked)


@pytest.mark.parametrize("ranges", [None, 10])
def test_average_rank_per_group(rows, ranges):
    data = rows.collect()
    expected = {g: brute_ranks([r.v for r in data if r.g == g]) for g in "ab"}
    for r in rank_average(rows, "v", ["g"], ranges=ranges).collect():
        assert r["rank"] == expected[r.g][r.v]


def test_missing_values_get_no_rank(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "i int, v double")
    assert {r.i: r["rank"] for r in rank_average_global(df, "v").collect()} == {1: 2.0, 2: None, 3: 1.0}


@pytest.mark.parametrize("ranges", [None, 5])
def test_global_order(spark, ranges):
    words = ["", "a", "ab", "abc", "äpfel", "b", "prefix-long-1", "prefix-long-2", "prefix-long-10", "Z"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in global_order(df, "w", ranges=ranges).orderBy("ord").collect()]
    assert got == sorted(words, key=lambda w: w.encode())
    df = spark.range(100).select(((F.col("id") * 37) % 11 - 5).alias("k"), "id")
    got = global_order(df, "k", "id", ranges=ranges).orderBy("ord").collect()
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    assert [r["ord"] for r in got] == list(range(1, 101))


def test_group_head_cuts_before_the_shuffle(rows):
    head = group_head(rows, ["g"], ["i"], 3)
    assert sorted(r.i for r in head.collect()) == [0, 1, 2, 3, 4, 5]
    assert "WindowGroupLimit" in head._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", ["same", "prefix"])
def test_tied_or_like_named_keys_spread_over_ranges(spark, keys):
    key = F.lit(7) if keys == "same" else F.concat(F.lit("zone_number_"), F.lpad(F.col("id").cast("string"), 6, "0"))
    df = spark.range(20_000).withColumn("k", key)
    sizes = [r["count"] for r in in_ranges(df, ["k"], 8).groupBy("_b").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 8000
    got = global_order(df, "k", "id", ranges=8)
    assert got.where((F.col("ord") - 1) != F.col("id")).isEmpty() and got.count() == 20_000


def test_smallest_step(spark):
    df = spark.createDataFrame([("2020-01-01 00:00:00",), ("2020-01-01 00:00:07",), ("2020-01-01 00:01:00",), ("2020-01-01 00:00:07",), (None,)], "s string")
    for ranges in (None, 3):
        assert smallest_step(df.select(F.to_timestamp("s").alias("dt")), "dt", ranges).first()[0] == 7_000_000
