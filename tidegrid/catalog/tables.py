"""The benchmark tables seen as a panel, and the same views in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.regularize import interpolate_linear, resample_mean
from tidegrid.panel import Panel
from tidegrid.sources.readers import read_parquet

# Irregular readings: a series may hold any share of the rows.
RAW = Panel(("id",), "dt")
# Series on an hourly grid: their span bounds their rows.
SERIES = RAW.bounded()
VALUES = ["speed", "volume", "occupancy"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


# ------------------------------------------------------------------ readings


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Irregular readings with missing speeds: events by user."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("ts").alias("dt"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("speed"),
        (F.col("event_id") % 97).cast("double").alias("volume"),
        (F.col("event_id") % 13).cast("double").alias("occupancy"),
        F.col("event_type").alias("quality"),
    )


READINGS = """
    SELECT user_id AS id, ts AS dt,
           CASE WHEN event_type <> 'error' THEN value END AS speed,
           (event_id % 97)::DOUBLE AS volume, (event_id % 13)::DOUBLE AS occupancy,
           event_type AS quality
    FROM events
"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Mean per occupied hour and series."""
    return resample_mean(readings(spark, sf), SERIES, VALUES, "1h")


HOURLY = f"""
    SELECT id, date_trunc('hour', dt) AS dt, avg(speed) AS speed, avg(volume) AS volume,
           avg(occupancy) AS occupancy
    FROM ({READINGS}) GROUP BY 1, 2
"""


def grid(spark: SparkSession, sf: str, cols: Sequence[str] = ("speed",), freq: str = "1h") -> DataFrame:
    """Gap-free series: hourly means with gaps interpolated."""
    return interpolate_linear(readings(spark, sf), SERIES, list(cols), freq, snap="mean")


def sql_interpolated(
    source: str,
    cols: Sequence[str],
    width: str = "1 hour",
    keys: Sequence[str] = ("id",),
    snap: str = "mean",
) -> str:
    """Interpolated grid of a source relation, as SQL."""
    k = ", ".join(keys)
    cell = f"time_bucket(INTERVAL '{width}', dt, TIMESTAMP '1970-01-01')"
    pick = {
        c: f"avg({c})" if snap == "mean" else f"avg(CASE WHEN dt = {cell} THEN {c} END)" for c in cols
    }
    slot_cols = ", ".join(f"{pick[c]} AS {c}" for c in cols)
    known = ", ".join(f"s.{c}, CASE WHEN s.{c} IS NOT NULL THEN c.dt END AS t_{c}" for c in cols)
    near = ", ".join(
        f"last_value({c} IGNORE NULLS) OVER past AS pv_{c}, "
        f"last_value(t_{c} IGNORE NULLS) OVER past AS pt_{c}, "
        f"first_value({c} IGNORE NULLS) OVER ahead AS nv_{c}, "
        f"first_value(t_{c} IGNORE NULLS) OVER ahead AS nt_{c}"
        for c in cols
    )
    made = ", ".join(
        f"CASE WHEN dt = pt_{c} OR pv_{c} IS NULL OR nv_{c} IS NULL THEN pv_{c} "
        f"ELSE pv_{c} + (nv_{c} - pv_{c}) * (epoch_us(dt) - epoch_us(pt_{c})) "
        f"/ (epoch_us(nt_{c}) - epoch_us(pt_{c})) END AS {c}"
        for c in cols
    )
    return f"""
    WITH slots AS (
        SELECT {k}, cell AS dt, {slot_cols.replace(cell, 'cell')}
        FROM (SELECT *, {cell} AS cell FROM ({source})) GROUP BY {k}, cell),
    span AS (SELECT {k}, min(dt) AS lo, max(dt) AS hi FROM slots GROUP BY {k}),
    cells AS (SELECT {k}, unnest(generate_series(lo, hi, INTERVAL '{width}')) AS dt FROM span),
    placed AS (SELECT {', '.join(f'c.{x}' for x in keys)}, c.dt, {known}
               FROM cells c LEFT JOIN slots s USING ({k}, dt)),
    near AS (SELECT {k}, dt, {near} FROM placed WINDOW
        past AS (PARTITION BY {k} ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        ahead AS (PARTITION BY {k} ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT {k}, dt, {made} FROM near
    """


GRID = sql_interpolated(READINGS, ["speed"])
GRID3 = sql_interpolated(READINGS, VALUES)


# ---------------------------------------------------------------------- meta


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """Detectors: customers on roads named by region, placed by nation and balance."""
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    heading = F.array(*[F.lit(d) for d in ("North", "East", "West", "South")])
    return c.join(places, c.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.concat("r_name", F.lit("-"), (F.col("c_nationkey") % 3).cast("string")).alias("road"),
        F.element_at(heading, (F.col("c_custkey") % 4 + 1).cast("int")).alias("direction"),
        (F.col("c_nationkey") * 1.0).alias("lon"),
        (F.col("c_acctbal") / 1000).alias("lat"),
    )


META = """
    SELECT c_custkey AS id, r_name || '-' || (c_nationkey % 3) AS road,
           (['North', 'East', 'West', 'South'])[(c_custkey % 4 + 1)::INT] AS direction,
           c_nationkey * 1.0::DOUBLE AS lon, c_acctbal / 1000 AS lat
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey
"""


# -------------------------------------------------------------------- trials

TYPES = ["click", "error", "purchase", "signup", "view"]
VARIANTS = ["f", "sf", "tf", "stf", "f3"]


def trials(spark: SparkSession, sf: str) -> DataFrame:
    """One trial per user and event type, with error measures as its results."""
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1
    e = table(spark, sf, "events").withColumn("k", kind)
    exptid = F.col("user_id") * 5 + F.col("k")
    out = e.groupBy("user_id", "k").agg(
        F.avg("value").alias("mae"),
        F.max("value").alias("mse"),
        F.min("value").alias("mape"),
        (F.avg("value") / F.greatest(F.max("value"), F.lit(1.0))).alias("smape"),
        (F.count("*") * F.lit(0.5)).alias("t_train"),
    )
    variant = F.array(*[F.lit(v) for v in VARIANTS])
    n_agg = F.array(F.lit(5), F.lit(10), F.lit(15))
    return out.select(
        exptid.alias("exptid"),
        F.col("user_id").cast("string").alias("id"),
        F.element_at(variant, (F.col("k") + 1).cast("int")).alias("features"),
        F.when(F.col("k") % 2 == 0, "GRU").otherwise("LSTM").alias("mclass"),
        F.element_at(n_agg, (exptid % 3 + 1).cast("int")).alias("n_agg"),
        "mae", "mse", "mape", "smape", "t_train",
    )


TRIALS = """
    SELECT user_id * 5 + k AS exptid, user_id::VARCHAR AS id,
           (['f', 'sf', 'tf', 'stf', 'f3'])[(k + 1)::INT] AS features,
           CASE WHEN k % 2 = 0 THEN 'GRU' ELSE 'LSTM' END AS mclass,
           ([5, 10, 15])[((user_id * 5 + k) % 3 + 1)::INT] AS n_agg,
           mae, mse, mape, smape, t_train
    FROM (SELECT user_id,
                 list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS k,
                 avg(value) AS mae, max(value) AS mse, min(value) AS mape,
                 avg(value) / greatest(max(value), 1.0) AS smape, count(*) * 0.5::DOUBLE AS t_train
          FROM events GROUP BY 1, 2)
"""


# ------------------------------------------------------------------- samples

GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks are calendar quarters, groups order priorities, values mean order prices in
    thousands (whole numbers, so that ties occur).  Every order counts."""
    orders = table(spark, sf, "orders")
    quarter = F.year("o_orderdate") * 10 + F.quarter("o_orderdate")
    return orders.groupBy(quarter.alias("block"), F.col("o_orderpriority").alias("grp")).agg(
        F.floor(F.avg("o_totalprice") / 1000).cast("double").alias("v")
    )


SAMPLES = """
    SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS block, o_orderpriority AS grp,
           floor(avg(o_totalprice) / 1000) AS v
    FROM orders GROUP BY 1, 2
"""


# -------------------------------------------------------------- predictions


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence forecasts: each hour's mean predicted by the hour before it."""
    from tidegrid.operators.windows import xy_windows_flat

    pairs = xy_windows_flat(grid(spark, sf), SERIES, ["speed"], ["speed"])
    return pairs.select("id", "dt", F.col("speed_t+1").alias("y"), F.col("speed_t-0").alias("y_hat"))


PREDICTIONS = f"""
    SELECT * FROM (
        SELECT id, dt, lead(speed) OVER w AS y, speed AS y_hat,
               lead(1) OVER w AS there
        FROM ({GRID}) WINDOW w AS (PARTITION BY id ORDER BY dt)) WHERE there IS NOT NULL
"""
