"""Row positions and neighbouring rows in series of any length.

A window over ``partitionBy(id)`` puts a whole series into one task.  That is the
right plan while every series is known to be small, and the wrong one when a
single key holds a large share of the data.  :func:`fit_chunk` measures the
longest series (one scan of two columns, two numbers back) and either leaves the
series whole or settles on a time-chunk width that bounds every (series, chunk)
group.  Operators do so themselves unless their panel is already settled.  The helpers below then work inside chunks and exchange only

* one row per (series, chunk): the chunk's size, for global positions, and
* the first or last ``n`` rows of each chunk, for lags and leads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.panel import MEASURE, Panel
from tidegrid.session import stage

CHUNK = "_chunk"
OWN = "_own"
POS = "_pos"
SIZE = "_size"

MAX_ROWS = 4_000_000


def fit_chunk(df: DataFrame, panel: Panel, max_rows: int = MAX_ROWS) -> Panel:
    """Give the panel the chunk width its densest stretch needs.

    Returns an unchunked panel when the longest series has at most ``max_rows``
    rows.  Otherwise the width starts at the even share of the longest series'
    span and shrinks until the fullest (series, chunk) group fits.
    """
    times = df.select(*panel.ids, F.unix_micros(panel.dt).alias("_us"))
    longest = (
        times.groupBy(*panel.ids)
        .agg(F.count("*").alias("n"), (F.max("_us") - F.min("_us")).alias("span"))
        .agg(F.max("n").alias("n"), F.max("span").alias("span"))
        .first()
    )
    rows = longest["n"] or 0
    if rows <= max_rows:
        return panel.chunked(None)
    width = max(1, int(longest["span"] * max_rows / rows))
    while True:
        cell = F.floor(F.col("_us") / F.lit(width))
        fullest = times.groupBy(*panel.ids, cell).count().agg(F.max("count")).first()[0]
        # Rows of one timestamp cannot be cut by time.
        if fullest <= max_rows or width == 1:
            return panel.chunked(width)
        width = max(1, min(width // 2, int(width * max_rows / fullest)))


def measured(df: DataFrame, panel: Panel) -> Panel:
    """The panel with its chunking settled, measuring ``df`` if that is still due."""
    return fit_chunk(df, panel) if panel.chunk_us == MEASURE else panel


def chunk_number(panel: Panel) -> Column:
    if panel.chunk_us is None:
        return F.lit(0).cast("bigint")
    return F.floor(F.unix_micros(panel.dt) / F.lit(panel.chunk_us))


def with_chunk(df: DataFrame, panel: Panel) -> DataFrame:
    return df if panel.chunk_us is None else df.withColumn(CHUNK, chunk_number(panel))


def group_keys(panel: Panel) -> list[str]:
    """Keys of the groups that windows run in."""
    return [*panel.ids] if panel.chunk_us is None else [*panel.ids, CHUNK]


def in_order(panel: Panel, descending: bool = False):
    """Window over one group in time order."""
    order = F.desc(panel.dt) if descending else F.asc(panel.dt)
    return Window.partitionBy(*group_keys(panel)).orderBy(order)


def with_position(df: DataFrame, panel: Panel) -> DataFrame:
    """Add the zero-based position of a row in its series and the series' length."""
    panel = measured(df, panel)
    if panel.chunk_us is None:
        whole = Window.partitionBy(*panel.ids)
        return df.withColumns(
            {
                POS: F.row_number().over(in_order(panel)).cast("bigint") - 1,
                SIZE: F.count(F.lit(1)).over(whole),
            }
        )
    keys = group_keys(panel)
    cut = with_chunk(df, panel)
    series = Window.partitionBy(*panel.ids)
    before = series.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
            F.sum("_rows").over(series).alias(SIZE),
        )
    )
    return (
        cut.withColumn("_rn", F.row_number().over(in_order(panel)))
        .join(sizes, keys)
        .withColumn(POS, F.col("_base") + F.col("_rn") - 1)
        .drop("_rn", "_base", CHUNK)
    )


def with_halo(df: DataFrame, panel: Panel, behind: int = 0, ahead: int = 0) -> DataFrame:
    """Add to every chunk copies of the rows just outside it.

    ``behind`` rows before the chunk and ``ahead`` rows after it are marked
    ``_own = false``; drop them with :func:`own_rows` after the window ran.  An
    unchunked panel needs none.
    """
    if panel.chunk_us is None:
        return df
    cut = stage(with_chunk(df, panel))  # read again for every edge
    parts = [cut.withColumn(OWN, F.lit(True))]
    for count, descending in ((ahead, False), (behind, True)):
        if count:
            parts.append(_edges(cut, panel, count, descending))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _edges(cut: DataFrame, panel: Panel, count: int, descending: bool) -> DataFrame:
    """Rows just after (or, descending, just before) each chunk, re-keyed to it.

    Each chunk offers its first ``count`` rows.  Chunk sizes, summed along the series,
    tell which later chunks reach into a chunk's next ``count`` rows and how many rows of
    theirs it takes; these are joined to the offered rows, so a row is copied only to the
    chunks that need it.
    """
    keys = group_keys(panel)
    payload = [c for c in cut.columns if c not in keys]
    sign = -1 if descending else 1
    offered = cut.withColumn("_rn", F.row_number().over(in_order(panel, descending))).where(F.col("_rn") <= count)
    along = Window.partitionBy(*panel.ids).orderBy(F.col(CHUNK) * sign)
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_before", F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1))
    ).withColumn("_before", F.coalesce("_before", F.lit(0)))
    # Chunks whose end is fewer than ``count`` rows before this one's beginning.
    reach = F.struct(CHUNK, (F.col("_before") + F.col("_rows")).alias("end"))
    near = along.rowsBetween(-count, -1)
    takers = sizes.withColumn("_near", F.collect_list(reach).over(near)).select(
        *panel.ids, F.col(CHUNK).alias("_giver"), "_before",
        F.explode(F.filter("_near", lambda x: F.col("_before") - x["end"] < count)).alias("_to"),
    ).select(
        *[F.col(c).alias(f"_of_{c}") for c in panel.ids], "_giver", F.col(f"_to.{CHUNK}").alias("_taker"),
        (F.lit(count) - (F.col("_before") - F.col("_to.end"))).alias("_take"),
    )
    same = F.col(CHUNK) == F.col("_giver")
    for c in panel.ids:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    given = offered.join(takers, same).drop(CHUNK)
    return given.where(F.col("_rn") <= F.col("_take")).select(
        *panel.ids, F.col("_taker").alias(CHUNK), *payload, F.lit(False).alias(OWN)
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the copied rows and the helper columns."""
    if OWN not in df.columns:
        return df
    return df.where(OWN).drop(OWN, CHUNK)
