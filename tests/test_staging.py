"""Staged tables are gone when the block that made them ends."""

import os

import pytest
from pyspark.sql import functions as F

from tidegrid.operators.quality import nullity_sort_columns
from tidegrid.operators.ranks import global_order, rank_average_global
from tidegrid.session import shared_folder, shuffle_partitions, stage, staging


def entries(spark):
    return set(os.listdir(os.path.dirname(shared_folder(spark, "x"))))


def test_nothing_is_left_behind(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("v"))
    before = entries(spark)
    with staging(spark):
        ranked = rank_average_global(df, "v").agg(F.sum("rank")).first()[0]
        ordered = global_order(df, "v", "id").agg(F.max("ord")).first()[0]
        sorted_rows = nullity_sort_columns(df.select("id", F.col("v").alias("n_present")), "id").count()
        assert entries(spark) > before
    assert (ranked, ordered, sorted_rows) == (200 * 201 / 2, 200, 200)
    assert entries(spark) == before


def test_an_error_does_not_keep_them(spark):
    before = entries(spark)
    with pytest.raises(RuntimeError), staging(spark):
        stage(spark.range(3))
        raise RuntimeError
    assert entries(spark) == before


def test_partitions_grow_with_the_input():
    assert shuffle_partitions(1) == 200
    assert shuffle_partitions(100 * 2**40) == 819_200
