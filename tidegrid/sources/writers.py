"""Sinks.  Directories are keyed by columns, so readers prune what they skip."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

# Directory keys.  The series id is not among them by default: millions of ids
# would be millions of small files.  Rows are sorted by id instead, so a reader
# of one series skips the row groups of the others; pass ``keys`` with the id for
# one directory per series.
SERIES_KEYS = ("road", "direction", "n_vx", "n_agg")
XY_KEYS = ("road", "direction", "n_vx", "n_agg", "features")


def _write_partitioned(df: DataFrame, path: str, keys: Sequence[str], mode: str) -> None:
    """Partitioned Parquet, sorted by id and time within each file.

    ``rebalance`` lets adaptive execution split a key that holds a large share of
    the rows over several files and merge small ones.
    """
    keys = [k for k in keys if k in df.columns]
    order = keys + [c for c in ("id", "dt") if c in df.columns and c not in keys]
    placed = df.hint("rebalance", *keys)
    if order:
        placed = placed.sortWithinPartitions(*order)
    _replacing(placed, mode).partitionBy(*keys).parquet(path)


def _replacing(df: DataFrame, mode: str) -> DataFrameWriter:
    """A writer; ``replace`` overwrites only the directories that the rows go to."""
    if mode == "replace":
        return df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    return df.write.mode(mode)


def write_series_parquet(
    df: DataFrame, path: str, keys: Sequence[str] = SERIES_KEYS, mode: str = "overwrite"
) -> None:
    _write_partitioned(df, path, keys, mode)


def write_xy(df: DataFrame, path: str, keys: Sequence[str] = XY_KEYS, mode: str = "overwrite") -> None:
    """Nested windows as Parquet arrays of floats."""
    arrays = {
        name: F.transform(name, lambda step: F.transform(step, lambda v: v.cast("float")))
        for name, kind in df.dtypes
        if kind == "array<array<double>>"
    }
    _write_partitioned(df.withColumns(arrays) if arrays else df, path, keys, mode)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """A folder for each trial.  ``mode="replace"`` replaces the trials that ``df`` has rows of
    and leaves all others, so that a trial that is run again stands once."""
    _write_partitioned(df, path, ("exptid",), mode)


def manifest(neighbors: DataFrame, by: Sequence[str] = ("road", "direction"), **dims) -> DataFrame:
    """One row per interior id of a road: the ids a study trains on, and the shape of
    their data sets (x_cols, y_cols, n_tx, n_ty, n_ty_step, months), lists as arrays."""
    shape = [
        (F.array(*[F.lit(v) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)).alias(name)
        for name, value in dims.items()
    ]
    return neighbors.select(*by, "id", "id_prev", "id_next", *shape)


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_trial_lists(spark: SparkSession, lists: Mapping[str, Sequence], path: str, mode: str = "overwrite") -> None:
    """The choices that a study combines, as one JSON record."""
    choices = [F.array(*[F.lit(v) for v in values]).alias(name) for name, values in lists.items()]
    spark.range(1).select(*choices).write.mode(mode).json(path)


def append_metrics(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, replace: str | None = None
) -> None:
    """Append rows to a folder of metric files, in the reader's order of columns unless told.

    ``replace`` names the column of the trial: rows lie in a folder for each trial then, and
    writing a trial again, or a retry of the write, replaces what it had.
    """
    from tidegrid.sources.readers import METRICS_SCHEMA

    known = [part.split()[0] for part in METRICS_SCHEMA.split(", ")]
    order = columns or [c for c in known if c in df.columns] + [c for c in df.columns if c not in known]
    if replace is None:
        df.select(*order).write.mode("append").option("header", True).csv(path)
        return
    # The trial's number stays in its files as well: readers match columns by name.
    placed = df.select(*order, F.col(replace).alias("trial")).hint("rebalance", "trial")
    _replacing(placed, "replace").option("header", True).partitionBy("trial").csv(path)
