"""Session settings and the shared folder used for written tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on.  The time zone makes wall-clock
# arithmetic exact; co-partitioning on a subset of the join keys lets a join on
# (series, week, dt) reuse the partitioning a window on (series, week) made.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Grids grow after their shuffle; small inputs still get every core.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Merged partitions are sized by compressed shuffle bytes, of which a hash table of
    # small groups holds some twenty times as many.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Zone-less Parquet times read as instants of the UTC session, without a cast
    # that would keep time filters from reaching the scan.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Bytes one shuffle partition should hold before adaptive execution merges small ones.
PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for an input size, so that each fits an executor's memory."""
    return max(200, -(-input_bytes // PARTITION_BYTES))


def build_session(
    app: str = "tidegrid", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the settings above; extra settings use ``a__b`` for ``a.b``.

    ``input_bytes`` sizes the shuffles of a large job.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if input_bytes:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return tune(builder.getOrCreate())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by the keys over all shuffle partitions.

    For steps that multiply rows after a shuffle: adaptive execution sizes
    partitions by what was shuffled and would merge too many of them.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


# Folders and catalog tables that end with the staging block around them.
_STAGED: list[tuple[str, str | None]] = []
# Spark's own limit, spark.sql.sources.bucketing.maxBuckets.
MAX_BUCKETS = 100_000


def _base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets one folder of its own,
    which is deleted when Python ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    base = tempfile.mkdtemp(prefix="tidegrid-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def shared_folder(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A fresh folder under the cluster's checkpoint directory.

    What is written there, and the catalog table that lies there, stay until the
    :func:`staging` block around them ends.
    """
    path = f"{_base_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.append((path, table))
    return path


def stage(df: DataFrame) -> DataFrame:
    """Write a result once and continue from the written table.

    For results that several later jobs read.  The table lies in the shared
    folder, so the loss of an executor loses nothing, lineage is cut, and its
    file sizes tell the planner what a join with it really costs.  It stays until
    the :func:`staging` block around it ends, or :func:`drop_staged` is called.
    """
    path = shared_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def buckets(spark: SparkSession) -> int:
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)


def stage_bucketed(df: DataFrame, keys: Sequence[str], sort: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """:func:`stage` as a table bucketed and sorted by ``keys``, sorted by ``sort`` within.

    Groupings, windows and joins on columns that include the keys read it without an
    exchange.  ``dealt``: the rows are already hash-partitioned by the keys into
    :func:`buckets` parts; otherwise they are exchanged once.
    """
    spark = df.sparkSession
    number, name = buckets(spark), f"staged_{uuid.uuid4().hex[:12]}"
    path = shared_folder(spark, "bucketed", name)
    rows = df if dealt else df.repartition(number, *keys)
    rows.write.bucketBy(number, *keys).sortBy(*keys, *sort).option("path", path).saveAsTable(name)
    return spark.table(name)


def drop_staged(spark: SparkSession, since: int = 0) -> None:
    """Delete staged tables; what still reads them fails."""
    for path, table in _STAGED[since:]:
        if table is not None:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _STAGED[since:]


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are deleted at its end; write results in it."""
    since = len(_STAGED)
    try:
        yield
    finally:
        drop_staged(spark, since)
