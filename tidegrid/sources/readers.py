"""Detector tables, trial results and saved windows as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions.scalar import missing_to_null
from tidegrid.operators.clean import (
    drop_unnamed_columns,
    order_used,
    ordered_category_geo,
    replace_chars,
    std_colcodes,
    std_colnames,
)
from tidegrid.operators.split import tail_rows
from tidegrid.panel import Panel

# Declared types of the detector files' columns; other columns are text.
COLUMN_TYPES = {
    "latitude": "double",
    "longitude": "double",
    "default_speed": "double",
    "interval": "double",
    "length": "double",
    "speed": "double",
    "volume": "double",
    "occupancy": "double",
    "measurement_start": "timestamp",
}

# Kinds of detector files.
KINDS = ("meta", "zone", "lane", "event")


def detector_schema(names: Sequence[str]) -> str:
    """Schema of a detector CSV from its header names."""
    return ", ".join(f"`{n}` {COLUMN_TYPES.get(n, 'string')}" for n in names)


def read_csv_typed(
    spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options
) -> DataFrame:
    """CSV with a header and declared types.

    Without a schema only the header line is read to name the columns; values are
    never scanned to guess a type.
    """
    reader = spark.read.options(header=True, **options)
    if schema is None:
        schema = detector_schema(reader.csv(path, inferSchema=False).columns)
    return nulls_for_missing(reader.schema(schema).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; zone-less timestamps become instants of the session's UTC clock."""
    df = spark.read.parquet(path)
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def nulls_for_missing(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: missing_to_null(F.col(c)) for c in floating}) if floating else df


READERS = {"csv": read_csv_typed, "parquet": read_parquet}


def load_table(spark: SparkSession, path: str, filetype: str = "parquet") -> DataFrame:
    if filetype not in READERS:
        raise ValueError(f"{filetype} not supported")
    return drop_unnamed_columns(READERS[filetype](spark, path))


def standardize(df: DataFrame) -> DataFrame:
    """Standard names and codes, and ``-`` in road names replaced."""
    out = std_colcodes(std_colnames(df))
    return replace_chars(out, "road") if "road" in out.columns else out


def load_dataset(
    spark: SparkSession,
    folder: str,
    kinds: Sequence[str] = (),
    filetype: str = "parquet",
    id_col: str = "id",
) -> dict[str, DataFrame]:
    """Meta and the named reading tables, standardised, with ids in meta's order.

    Meta gets ``ord`` by location; readings take it from meta, and ids meta does
    not know keep a NULL order.
    """
    unknown = set(kinds) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    tables = {
        k: standardize(load_table(spark, f"{folder}/{k}.{filetype}", filetype))
        for k in ["meta", *kinds]
    }
    return order_dataset(tables, id_col)


def order_dataset(tables: Mapping[str, DataFrame], id_col: str = "id") -> dict[str, DataFrame]:
    meta = ordered_category_geo(tables["meta"], id_col).drop("dist")
    levels = meta.select(id_col, "ord")
    out = {"meta": meta}
    for kind, df in tables.items():
        if kind != "meta":
            out[kind] = order_used(df, id_col, levels) if id_col in df.columns else df
    return out


METRICS_SCHEMA = (
    "exptid bigint, id string, t_train double, t_autotune double, "
    "mse double, mae double, mape double, smape double"
)


def read_metrics_dir(spark: SparkSession, folder: str, schema: str = METRICS_SCHEMA) -> DataFrame:
    """All per-trial metric files of a folder as one table, columns matched by name.

    Each file has a header of its own, in an order of its own; columns of the schema that
    a file lacks are NULL, and others are left out.
    """
    kinds = T._parse_datatype_string(schema)
    # Files may lie in the folder itself or in a folder for each trial.
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    name = F.trim(F.col("value"))
    # A file's header is the line that names the key column; data lines start with a number.
    header = lines.where(name.rlike(rf"(^|,)\"?{kinds.fields[0].name}\"?(,|$)"))
    headers = header.groupBy("value").agg(F.collect_set("file").alias("files")).collect()
    out = None
    for row in headers:  # one read for each order of columns, not for each file
        names = [c.strip().strip('"') for c in row["value"].split(",")]
        typed = T.StructType([
            kinds[n] if n in kinds.names else T.StructField(n, T.StringType()) for n in names
        ])
        part = nulls_for_missing(spark.read.options(header=True).schema(typed).csv(row["files"]))
        part = part.select(*[
            F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields
        ])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kinds)


def read_trial_confs(
    spark: SparkSession,
    folder: str,
    schema: str | T.StructType | None = None,
    number_in_path: str = r"(\d+)\.json$",
    multi_line: bool = True,
) -> DataFrame:
    """Trial configurations from JSON; the trial number comes from the file's path."""
    reader = spark.read.option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), number_in_path, 1).cast("bigint")
    return reader.json(folder).select(number.alias("exptid"), "*")


MANIFEST_SCHEMA = (
    "road string, direction string, id bigint, id_prev bigint, id_next bigint, n_tx int, n_ty int, "
    "n_ty_step int, x_cols array<string>, y_cols array<string>, months array<int>"
)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_trial_lists(spark: SparkSession, path: str) -> dict[str, list]:
    """The choices of a study, one list for each setting."""
    row = spark.read.json(path).first()
    return {} if row is None else {name: list(values) for name, values in row.asDict().items()}


# Rows of a series that a trial uses, and that a test run uses.
TRIAL_ROWS = 14400
TEST_ROWS = 100


def read_xy_tail(spark: SparkSession, path: str, panel: Panel, n_rows: int) -> DataFrame:
    """Saved windows, the last ``n_rows`` rows of each series only."""
    return tail_rows(read_parquet(spark, path), panel, n_rows)
