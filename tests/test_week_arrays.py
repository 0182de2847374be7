"""Windows cut out of weeks against the windows of one rate and of two."""

import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidegrid.catalog.dataset_queries import _summary
from tidegrid.operators.regularize import resample_mean
from tidegrid.operators.week_arrays import dual_rate_windows, single_rate_windows, week_arrays, week_views
from tidegrid.operators.windows import xy_windows_dual_weekly, xy_windows_weekly
from tidegrid.panel import Panel
from tidegrid.plans.datasets import DatasetConf, build_dataset_single_rate
from tidegrid.session import stage_bucketed, staging

PANEL = Panel(("id",), "dt").bounded()


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(2)
    start = F.to_timestamp(F.lit("2020-01-29 05:00:00"))
    made = [(i, k, draw.random(), None if draw.random() < 0.1 else draw.random()) for i in "ab" for k in range(500) if draw.random() < 0.98]
    df = spark.createDataFrame(made, "id string, k int, a double, b double")
    return df.withColumn("dt", start + F.expr("interval 1 hour") * F.col("k")).drop("k").cache()


@pytest.mark.parametrize("n_tx,n_ty,h,least", [(1, 1, 1, 1), (4, 2, 1, 10), (3, 1, 3, 40), (30, 5, 2, 10)])
def test_single_rate(rows, n_tx, n_ty, h, least):
    weeks = week_arrays(rows, PANEL, ["a", "b"], ["b"])
    got = single_rate_windows(weeks, PANEL, 2, [({"of": 1}, [0, 1]), ({"of": 2}, [1])], n_tx, n_ty, h, least)
    for of, cols in ((1, ["a", "b"]), (2, ["b"])):
        want = xy_windows_weekly(rows, PANEL, cols, ["b"], n_tx=n_tx, n_ty=n_ty, h=h, nested=True, min_windows=least)
        same_rows(got.where(f"of = {of}").drop("of"), want)


@pytest.mark.parametrize("n_tx,n_ty,h,tail", itertools.product([6, 12], [1, 3], [1, 2], ["drop", "repeat"]))
def test_two_rates(rows, n_tx, n_ty, h, tail):
    coarse = resample_mean(rows, PANEL, ["a"], "6h")
    got = dual_rate_windows(
        week_arrays(rows, PANEL, ["a", "b"]), week_arrays(coarse, PANEL, [], ["a"]), PANEL, 2, [({}, [0, 1])],
        "1h", "6h", n_tx, n_ty, h, tail, 5,
    )
    want = xy_windows_dual_weekly(
        rows, coarse, PANEL, ["a", "b"], ["a"], "1h", "6h", n_tx=n_tx, n_ty=n_ty, h=h, tail=tail, nested=True, min_windows=5,
    )
    same_rows(got, want)


def test_bucketed_rows_are_not_exchanged_again(spark, rows):
    with staging(spark):
        staged = stage_bucketed(rows, ["id"], ["dt"])
        made = single_rate_windows(week_arrays(staged, PANEL, ["a"], ["b"]), PANEL, 1, [({}, [0])], 3, 1, 1, 1)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and made.count() > 100
        name = plan.split("spark_catalog.default.")[1].split("[")[0].split(" ")[0]
    assert not spark.catalog.tableExists(name)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_their_sums_are_not_interpreted(spark, rows):
    weeks = week_arrays(rows, PANEL, ["a", "b"], ["b"])
    made = single_rate_windows(weeks, PANEL, 2, [({"of": 1}, [0, 1]), ({"of": 2}, [1])], 3, 1, 1, 1)
    coarse = week_arrays(resample_mean(rows, PANEL, ["a"], "6h"), PANEL, [], ["a"])
    two = dual_rate_windows(weeks, coarse, PANEL, 2, [({"of": 1}, [0, 1])], "1h", "6h", 6, 1, 1, "drop", 1)
    for windows in (made, two):
        plan = _plan(windows)
        assert "slice(" in plan and not re.search(r"lambdafunction\([^\n]*slice\(", plan)
    x = [[[1.0, 2.0], [None, 4.0]], [[5.0, None], [7.0, 8.0]]]
    windows = spark.createDataFrame([("f", 1, 60, 1, w, [[v]]) for w, v in zip(x, (9.0, None))],
                                    "features string, n_vx int, n_agg int, id int, x array<array<double>>, y array<array<double>>")
    summed = _summary(windows)
    assert "lambda" not in _plan(summed)
    assert [*summed.first()] == ["f", 1, 60, 1, 2, 2, 2, 27.0, 6.0, 2.0, 7.0, 12.0, 9.0]


def test_views_of_a_week_are_the_weeks_of_their_rows(rows):
    some = F.col("b") > 0.3
    both = single_rate_windows(
        week_views(rows, PANEL, {"all": (None, ["a"], ["b"]), "some": (some, ["b", "a"], ["a"])}), PANEL, {"all": 1, "some": 2},
        [({"of": 1}, [0], "all"), ({"of": 2}, [1], "some")], 3, 1, 1, 12,
    )
    same_rows(both.where("of = 1").drop("of"), xy_windows_weekly(rows, PANEL, ["a"], ["b"], n_tx=3, nested=True, min_windows=12))
    same_rows(both.where("of = 2").drop("of"), xy_windows_weekly(rows.where(some), PANEL, ["a"], ["a"], n_tx=3, nested=True, min_windows=12))


def test_neighbourhoods_of_a_rate_share_one_pass(spark):
    meta = spark.createDataFrame([(i, "r", "N", i) for i in range(3)], "id int, road string, direction string, ord int")
    # The next series has no reading after the 14th.
    start = datetime.datetime(2024, 1, 1)
    made = [(i, start + datetime.timedelta(hours=h), float(h * (i + 1))) for i in range(3) for h in range(24 * (14 if i == 2 else 28))]
    readings = spark.createDataFrame(made, "id int, dt timestamp, speed double")
    conf = DatasetConf(n_tx=2, n_ty=1, base_freq="1h", n_aggs=(60,), column_sets=(("speed",),), features=("f", "sf"))
    with staging(spark):
        out = build_dataset_single_rate(meta, readings, conf)
        assert _plan(out).count("FileScan") <= 2
        found = {r.features: r for r in out.groupBy("features").agg(
            F.min(F.col("x")[0][0]).alias("least"), F.max(F.col("y")[0][0]).alias("most"), F.max("dt").alias("dt")).collect()}
    # Each neighbourhood is scaled by its own rows.
    assert all((r.least, r.most) == pytest.approx((0, 1)) for r in found.values())
    assert found["f"].dt.day > 20 and found["sf"].dt.day < 15
