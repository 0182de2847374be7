import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegrid.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[*]",
        spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def series(spark):
    """Build a panel (id, dt, value columns…) from lists; None is missing."""
    from pyspark.sql import functions as F

    def build(step="1 minute", ids=("a",), **columns):
        n = len(next(iter(columns.values())))
        rows = [
            (i, k, *[None if c[k] is None else float(c[k]) for c in columns.values()])
            for i in ids
            for k in range(n)
        ]
        schema = "id string, k int, " + ", ".join(f"{c} double" for c in columns)
        df = spark.createDataFrame(rows, schema)
        start = F.to_timestamp(F.lit("2020-01-01 00:00:00"))
        return df.withColumn("dt", start + F.expr(f"interval {step}") * F.col("k")).drop("k")

    return build


def same_rows(a, b):
    """Both frames hold the same rows, duplicates counted."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = a.select(cols), b.select(cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty()
    assert b.exceptAll(a).isEmpty()
