"""Registration of queries and helpers that give both engines the same output."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the operator's name, with the equivalent SQL."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, sf_dir: build(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def _off_tie(digits: int) -> float:
    """A shift far below the last digit kept.

    Means of two-decimal values often end exactly between two roundings, where the
    order of a sum would decide; shifted by the same amount on both sides they do
    not.
    """
    return 1.37 * 10.0 ** -(digits + 2)


def finish(df: DataFrame, digits: int = 9) -> DataFrame:
    """Naive timestamps and rounded doubles, as the SQL side writes them."""
    changed = {}
    for name, kind in df.dtypes:
        if kind == "timestamp":
            changed[name] = F.col(f"`{name}`").cast("timestamp_ntz")
        elif kind == "double":
            changed[name] = F.round(F.col(f"`{name}`") + F.lit(_off_tie(digits)), digits) + F.lit(0.0)
    return df.withColumns(changed) if changed else df


def rounded(sql: str, cols: Sequence[str], digits: int = 9) -> str:
    """The SQL twin of :func:`finish` for the named double columns."""
    shift = f"{_off_tie(digits)!r}::DOUBLE"
    changed = ", ".join(f'round("{c}" + {shift}, {digits}) + 0.0 AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({changed}) FROM ({sql})"
