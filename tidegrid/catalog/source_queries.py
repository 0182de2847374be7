"""Sources and sinks: written from the tables, read back, compared as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import (
    HOURLY, META, READINGS, SERIES, TRIALS, hourly, meta, readings, table, trials,
)
from tidegrid.operators.clean import drop_unnamed_columns, std_colnames
from tidegrid.operators.joins import neighbor_ids
from tidegrid.operators.windows import xy_windows_nested
from tidegrid.session import shared_folder
from tidegrid.sources import readers, writers
from tidegrid.sources.generate import generate_ramp, generate_series, grid_of


def _raw_zone(spark, sf):
    """Readings under the names detector files use, with a stray index column."""
    e = readings(spark, sf)
    return e.select(
        F.monotonically_increasing_id().alias("Unnamed: 0"),
        F.col("id").cast("string").alias("zone_id"),
        F.date_format("dt", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("measurement_start"),
        "speed", "volume", "occupancy", "quality",
    )


def _raw_meta(spark, sf):
    return meta(spark, sf).select(
        F.col("id").cast("string").alias("zone_id"),
        "road", "direction",
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
    )


ZONE_SQL = f"SELECT id::VARCHAR AS id, dt, speed, volume, occupancy, quality FROM ({READINGS})"


@query("read_csv_typed", rounded(ZONE_SQL, ["speed", "volume", "occupancy"]))
def read_csv_typed(spark, sf):
    path = shared_folder(spark, "zone-csv")
    _raw_zone(spark, sf).write.option("header", True).csv(path)
    df = readers.read_csv_typed(spark, path, timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    return finish(std_colnames(df.drop("Unnamed: 0")))


@query("read_parquet", "SELECT event_id, ts, user_id, event_type, value FROM events")
def read_parquet(spark, sf):
    df = readers.load_table(spark, f"{sf}/events.parquet", "parquet")
    return finish(df.select("event_id", "ts", "user_id", "event_type", "value"))


@query("drop_unnamed_columns", rounded(
    f"SELECT id::VARCHAR AS zone_id, speed, volume, occupancy, quality FROM ({READINGS})",
    ["speed", "volume", "occupancy"]))
def drop_unnamed(spark, sf):
    return finish(drop_unnamed_columns(_raw_zone(spark, sf)).drop("measurement_start"))


GEO_SQL = """
    WITH m AS ({source}),
    corner AS (SELECT min(lon) AS x, min(lat) AS y FROM m),
    first AS (SELECT lon AS x, lat AS y FROM m
              ORDER BY sqrt(pow(lon - (SELECT x FROM corner), 2) + pow(lat - (SELECT y FROM corner), 2)), id
              LIMIT 1)
    SELECT *, row_number() OVER (ORDER BY
        sqrt(pow(lon - (SELECT x FROM first), 2) + pow(lat - (SELECT y FROM first), 2)), id) AS ord
    FROM m
"""

STD_META = f"""
    SELECT id::VARCHAR AS id, replace(road, '-', '_') AS road, left(direction, 1) AS direction,
           lat, lon FROM ({META})
"""


@query("load_dataset", rounded(f"""
    SELECT z.id, z.dt, z.speed, CASE WHEN g.ord IS NOT NULL THEN dense_rank() OVER (ORDER BY g.ord NULLS LAST) END AS ord
    FROM ({ZONE_SQL}) z LEFT JOIN ({GEO_SQL.format(source=STD_META)}) g USING (id)""", ["speed"]))
def load_dataset(spark, sf):
    folder = shared_folder(spark, "dataset")
    _raw_meta(spark, sf).write.parquet(f"{folder}/meta.parquet")
    zone = _raw_zone(spark, sf).withColumn("measurement_start", F.to_timestamp("measurement_start"))
    zone.write.parquet(f"{folder}/zone.parquet")
    tables = readers.load_dataset(spark, folder, ["zone"])
    return finish(tables["zone"].select("id", "dt", "speed", "ord"))


_METRICS = ["exptid", "id", "t_train", "t_autotune", "mse", "mae", "mape", "smape"]
METRICS_SQL = f"SELECT exptid, id, t_train, 0.0::DOUBLE AS t_autotune, mse, mae, mape, smape FROM ({TRIALS})"
_DOUBLES = ["t_train", "t_autotune", "mse", "mae", "mape", "smape"]


def _metrics(spark, sf):
    return trials(spark, sf).withColumn("t_autotune", F.lit(0.0)).select(*_METRICS)


NO_TUNING = METRICS_SQL.replace("0.0::DOUBLE AS t_autotune", "CASE WHEN exptid % 3 <> 2 THEN 0.0::DOUBLE END AS t_autotune")


@query("read_metrics_dir", rounded(NO_TUNING, _DOUBLES))
def read_metrics_dir(spark, sf):
    """Files in two orders of columns, and some without a tuning time."""
    path = shared_folder(spark, "metrics")
    rows = _metrics(spark, sf)
    swapped = [*_METRICS[:4], "mae", "smape", "mape", "mse"]
    for part, names in enumerate((_METRICS, swapped, [c for c in swapped if c != "t_autotune"])):
        writers.append_metrics(rows.where(F.col("exptid") % 3 == part), path, names)
    return finish(readers.read_metrics_dir(spark, path))


@query("append_metrics", rounded(METRICS_SQL, _DOUBLES))
def append_metrics(spark, sf):
    path = shared_folder(spark, "metrics")
    rows = _metrics(spark, sf)
    for part in range(2):
        writers.append_metrics(rows.where(F.col("exptid") % 2 == part), path)
    return finish(readers.read_metrics_dir(spark, path))


@query("append_metrics_again", rounded(METRICS_SQL, _DOUBLES))
def append_metrics_again(spark, sf):
    """All studies (some trials each) are written with other values, then every study again."""
    path = shared_folder(spark, "metrics")
    rows = _metrics(spark, sf).withColumn("study", F.col("exptid") % 20)
    writers.append_metrics(rows.withColumn("mse", F.col("mse") + 1), path, _METRICS, replace="study")
    for part in range(2):
        writers.append_metrics(rows.where(F.col("study") % 2 == part), path, _METRICS, replace="study")
    return finish(readers.read_metrics_dir(spark, path))


@query("read_trial_confs", f"""
    SELECT exptid % 50 AS exptid, count(*) AS n, min(mclass) AS mclass, max(n_agg)::BIGINT AS n_agg
    FROM ({TRIALS}) GROUP BY 1""")
def read_trial_confs(spark, sf):
    path = shared_folder(spark, "confs")
    confs = trials(spark, sf).select(
        (F.col("exptid") % 50).alias("study"), "mclass", F.col("n_agg").cast("bigint")
    )
    confs.repartition("study").write.partitionBy("study").json(path)
    read = readers.read_trial_confs(
        spark, f"{path}/*/", "mclass string, n_agg bigint", r"study=(\d+)/", multi_line=False
    )
    return read.groupBy("exptid").agg(
        F.count("*").alias("n"), F.min("mclass").alias("mclass"), F.max("n_agg").alias("n_agg")
    )


@query("read_xy_tail", rounded(f"""
    SELECT id, dt, speed, volume FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY dt DESC) AS rn FROM ({HOURLY}))
    WHERE rn <= 20""", ["speed", "volume"]))
def read_xy_tail(spark, sf):
    path = shared_folder(spark, "xy")
    hourly(spark, sf).select("id", "dt", "speed", "volume").write.parquet(path)
    return finish(readers.read_xy_tail(spark, path, SERIES, n_rows=20))


@query("write_series_parquet", rounded(f"""
    SELECT h.id::INT AS id, dt, speed, road, direction
    FROM ({HOURLY}) h JOIN ({META}) m ON h.id = m.id""", ["speed"]))
def write_series_parquet(spark, sf):
    path = shared_folder(spark, "series")
    rows = hourly(spark, sf).join(meta(spark, sf).select("id", "road", "direction"), "id")
    rows = rows.select("id", "dt", "speed", "road", "direction")
    writers.write_series_parquet(rows, path, keys=("road", "direction"))
    back = readers.read_parquet(spark, path)
    return finish(back.select(F.col("id").cast("int"), "dt", "speed", "road", "direction"))


@query("write_xy", rounded(f"""
    SELECT * EXCLUDE (there) FROM (
        SELECT 'f' AS features, id::INT AS id, dt, volume::FLOAT::DOUBLE AS x0, occupancy::FLOAT::DOUBLE AS x1,
               lead(volume::FLOAT, 2) OVER w::DOUBLE AS x4, lead(occupancy::FLOAT, 2) OVER w::DOUBLE AS x5,
               lead(volume::FLOAT, 3) OVER w::DOUBLE AS y0, 3 AS n_tx, lead(1, 3) OVER w AS there
        FROM ({HOURLY}) WINDOW w AS (PARTITION BY id ORDER BY dt)) WHERE there IS NOT NULL""",
    ["x0", "x1", "x4", "x5", "y0"], 3))
def write_xy(spark, sf):
    path = shared_folder(spark, "xy")
    made = xy_windows_nested(hourly(spark, sf), SERIES, ["volume", "occupancy"], ["volume"], n_tx=3)
    writers.write_xy(made.withColumn("features", F.lit("f")), path, keys=("features",))
    back = readers.read_parquet(spark, path)
    at = lambda i, j: F.col("x")[i][j].cast("double")
    return finish(back.select(
        "features", F.col("id").cast("int"), "dt", at(0, 0).alias("x0"), at(0, 1).alias("x1"), at(2, 0).alias("x4"),
        at(2, 1).alias("x5"), F.col("y")[0][0].cast("double").alias("y0"), F.size("x").alias("n_tx"),
    ), 3)


@query("write_manifest", f"""
    SELECT road, direction, id, id_prev, id_next, 24 AS n_tx, 2 AS n_ty, 1 AS n_ty_step,
           'speed,volume' AS x_cols, 'speed' AS y_cols, '1,2' AS months FROM (
        SELECT road, direction, id, lag(id) OVER w AS id_prev, lead(id) OVER w AS id_next
        FROM ({META}) WINDOW w AS (PARTITION BY road, direction ORDER BY id))
    WHERE id_prev IS NOT NULL AND id_next IS NOT NULL""")
def write_manifest(spark, sf):
    path = shared_folder(spark, "manifest")
    neighbors = neighbor_ids(meta(spark, sf).withColumn("ord", F.col("id")))
    dims = {"n_tx": 24, "n_ty": 2, "n_ty_step": 1, "x_cols": ["speed", "volume"], "y_cols": ["speed"], "months": [1, 2]}
    writers.write_manifest(writers.manifest(neighbors, **dims), path)
    back = readers.read_manifest(spark, path)
    return back.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("x_cols", "y_cols", "months")})


@query("write_predictions", rounded(f"""
    SELECT id % 24 AS exptid, dt, volume AS y, occupancy AS y_hat FROM ({HOURLY})""", ["y", "y_hat"]))
def write_predictions(spark, sf):
    path = shared_folder(spark, "preds")
    rows = hourly(spark, sf).select(
        (F.col("id") % 24).alias("exptid"), "dt", F.col("volume").alias("y"), F.col("occupancy").alias("y_hat")
    )
    writers.write_predictions(rows, path)
    back = readers.read_parquet(spark, path)
    return finish(back.select(F.col("exptid").cast("bigint"), "dt", "y", "y_hat"))


@query("write_predictions_again", rounded(f"""
    SELECT id % 24 AS exptid, dt, volume AS y, occupancy AS y_hat FROM ({HOURLY})""", ["y", "y_hat"]))
def write_predictions_again(spark, sf):
    """A third of the trials run again: what they had is replaced, the others stay."""
    path = shared_folder(spark, "preds")
    rows = hourly(spark, sf).select(
        (F.col("id") % 24).alias("exptid"), "dt", F.col("volume").alias("y"), F.col("occupancy").alias("y_hat")
    )
    again = F.col("exptid") % 3 == 0
    writers.write_predictions(rows.withColumn("y", F.when(again, F.col("y") + 1).otherwise(F.col("y"))), path)
    writers.write_predictions(rows.where(again), path, mode="replace")
    back = readers.read_parquet(spark, path)
    return finish(back.select(F.col("exptid").cast("bigint"), "dt", "y", "y_hat"))


@query("generate_series", """
    SELECT unnest(generate_series(date_trunc('hour', min(ts)), date_trunc('hour', max(ts)), INTERVAL 1 HOUR)) AS dt,
           TRUE AS within FROM events""")
def generate_series_(spark, sf):
    """Random values differ from engine to engine: their times and range are compared."""
    ends = table(spark, sf, "events").agg(
        F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi")
    ).first()
    made = generate_series(spark, ends["lo"], ends["hi"], "1h", low=20, high=30, seed=3)
    return finish(made.select("dt", F.col("values").between(20, 29).alias("within")))


@query("generate_ramp", rounded("""
    WITH n AS (SELECT count(*) AS n FROM orders)
    SELECT TIMESTAMP '2020-01-01' + to_minutes(5 * i) AS dt, 1 + i * 9.0::DOUBLE / (n - 1) AS col1,
           11 + i * 9.0::DOUBLE / (n - 1) AS col2
    FROM (SELECT n, unnest(generate_series(0, n - 1)) AS i FROM n)""", ["col1", "col2"]))
def generate_ramp_(spark, sf):
    rows = table(spark, sf, "orders").count()
    return finish(generate_ramp(spark, rows, {"col1": (1, 10), "col2": (11, 20)}))


@query("grid_of", """
    SELECT id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS dt FROM (
        SELECT user_id AS id, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi
        FROM events GROUP BY 1)""")
def grid_of_(spark, sf):
    e = table(spark, sf, "events")
    bounds = e.groupBy(F.col("user_id").alias("id")).agg(
        F.date_trunc("hour", F.min("ts")).alias("lo"), F.date_trunc("hour", F.max("ts")).alias("hi")
    )
    return finish(grid_of(bounds, ["id"], "1h"))
