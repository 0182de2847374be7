"""What the text operators share: session settings, written steps, column helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.session import shared_folder, stage

__all__ = ["ascii_lower", "fresh_name", "packed", "partitions", "settle", "shared_folder", "stage", "table", "unpacked"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII white space, fixed by the contracts of the word and line operators.
WHITE = " \t\n\x0b\x0c\r"

SETTINGS = {
    # A batch of very long texts must fit a Python worker beside its copy.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    # Grouping a union of bucketed tables would take each table's buckets for the
    # union's own partitions and leave equal keys apart.
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def settle(spark: SparkSession) -> SparkSession:
    """Apply the settings these operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def packed(names: list[str]) -> Column:
    """The named columns as one, ``row``, so that none of their names can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`") for c in names]


def fresh_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
