"""Scaling, splitting, error measures and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import (
    PREDICTIONS, READINGS, predictions, RAW, readings, table,
)
from tidegrid.operators import metrics as m
from tidegrid.operators import scale
from tidegrid.operators.ranks import rank_average, rank_average_global
from tidegrid.operators.split import tvt_split
from tidegrid.operators.windows import xy_windows_nested

COLS = ["speed", "volume"]
IDS = ["id"]


def _rows(spark, sf):
    return readings(spark, sf).select("id", "dt", *COLS)


def _one(x):
    return f"CASE WHEN {x} = 0 THEN 1.0 ELSE {x} END"


STANDARD = f"""
    SELECT id, {', '.join(f'avg({c}) AS {c}_mean, {_one(f"stddev_pop({c})")} AS {c}_sd' for c in COLS)}
    FROM ({READINGS}) GROUP BY 1"""
LO, HI = -0.5, 0.6
MINMAX = f"""
    SELECT id, {', '.join(f'''1.1::DOUBLE / {_one(f"(max({c}) - min({c}))")} AS {c}_scale,
        -0.5::DOUBLE - min({c}) * (1.1::DOUBLE / {_one(f"(max({c}) - min({c}))")}) AS {c}_add''' for c in COLS)}
    FROM ({READINGS}) GROUP BY 1"""


@query("standard_scaler_fit", rounded(STANDARD, [f"{c}_{p}" for c in COLS for p in ("mean", "sd")]))
def standard_scaler_fit(spark, sf):
    return finish(scale.standard_scaler_fit(_rows(spark, sf), IDS, COLS))


@query("standard_scaler_transform", rounded(f"""
    SELECT id, dt, (speed - speed_mean) / speed_sd AS speed, (volume - volume_mean) / volume_sd AS volume
    FROM ({READINGS}) JOIN ({STANDARD}) USING (id)""", COLS))
def standard_scaler_transform(spark, sf):
    rows = _rows(spark, sf)
    return finish(scale.standard_scaler_transform(rows, scale.standard_scaler_fit(rows, IDS, COLS), IDS, COLS))


@query("standard_scaler_inverse", rounded(f"""
    SELECT id, dt, speed * speed_sd + speed_mean AS speed, volume * volume_sd + volume_mean AS volume
    FROM ({READINGS}) JOIN ({STANDARD}) USING (id)""", COLS, 5))
def standard_scaler_inverse(spark, sf):
    rows = _rows(spark, sf)
    return finish(scale.standard_scaler_inverse(rows, scale.standard_scaler_fit(rows, IDS, COLS), IDS, COLS), 5)


@query("minmax_scaler_fit", rounded(MINMAX, [f"{c}_{p}" for c in COLS for p in ("scale", "add")]))
def minmax_scaler_fit(spark, sf):
    return finish(scale.minmax_scaler_fit(_rows(spark, sf), IDS, COLS, (LO, HI)))


@query("minmax_scaler_transform", rounded(f"""
    SELECT id, dt, speed * speed_scale + speed_add AS speed, volume * volume_scale + volume_add AS volume
    FROM ({READINGS}) JOIN ({MINMAX}) USING (id)""", COLS))
def minmax_scaler_transform(spark, sf):
    rows = _rows(spark, sf)
    params = scale.minmax_scaler_fit(rows, IDS, COLS, (LO, HI))
    return finish(scale.minmax_scaler_transform(rows, params, IDS, COLS))


@query("minmax_scaler_inverse", rounded(f"""
    SELECT id, dt, (speed - speed_add) / speed_scale AS speed, (volume - volume_add) / volume_scale AS volume
    FROM ({READINGS}) JOIN ({MINMAX}) USING (id)""", COLS, 5))
def minmax_scaler_inverse(spark, sf):
    rows = _rows(spark, sf)
    params = scale.minmax_scaler_fit(rows, IDS, COLS, (LO, HI))
    return finish(scale.minmax_scaler_inverse(rows, params, IDS, COLS), 5)


@query("scale_per_series", rounded(f"""
    SELECT id, dt, (speed - lo) * (1.0::DOUBLE / {_one('(hi - lo)')}) AS speed FROM ({READINGS})
    JOIN (SELECT id, min(speed) AS lo, max(speed) AS hi FROM ({READINGS}) GROUP BY 1) USING (id)""", ["speed"]))
def scale_per_series(spark, sf):
    return finish(scale.scale_per_series(_rows(spark, sf).select("id", "dt", "speed"), IDS, ["speed"]))


@query("tvt_split", f"""
    SELECT id, dt, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train'
                        WHEN pos < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT id, dt, row_number() OVER (PARTITION BY id ORDER BY dt) - 1 AS pos,
                 count(*) OVER (PARTITION BY id) AS n FROM ({READINGS}))""")
def tvt_split_(spark, sf):
    rows = readings(spark, sf).select("id", "dt")
    return finish(tvt_split(rows, RAW))


EPS = "1e-7::DOUBLE"
FORMULAS = {
    "mse": "avg(pow(y_hat - y, 2))",
    "mae": "avg(abs(y_hat - y))",
    "mape": f"100 * avg(abs(y - y_hat) / greatest(abs(y), {EPS}))",
    "smape": f"100 * avg(abs(y - y_hat) / greatest(abs(y) + abs(y_hat), {EPS}))",
}


# Errors relative to values near zero reach 1e9: fewer decimals, same digits.
DIGITS = {"mse": 6, "mae": 8, "mape": 1, "smape": 8}


def _metric_query(name):
    @query(f"metric_{name}", rounded(
        f"SELECT id, {FORMULAS[name]} AS {name} FROM ({PREDICTIONS}) GROUP BY 1", [name], DIGITS[name]))
    def build(spark, sf):
        expr = m.METRICS[name](F.col("y"), F.col("y_hat")).alias(name)
        return finish(predictions(spark, sf).groupBy("id").agg(expr), DIGITS[name])

    return build


for _name in FORMULAS:
    _metric_query(_name)


@query("evaluate_metrics", rounded(f"""
    SELECT id, {', '.join(f'{FORMULAS[n]} AS {n}' for n in ('mse', 'mae', 'smape'))}
    FROM ({PREDICTIONS}) GROUP BY 1""", ["mse", "mae", "smape"], 6))
def evaluate_metrics(spark, sf):
    return finish(m.evaluate_metrics(predictions(spark, sf), ["id"], metrics=["mse", "mae", "smape"]), 6)


@query("metric_smape_rowwise", rounded(f"""
    SELECT id, dt, 100 * (s1 + s2) / 2 AS smape FROM (
        SELECT id, dt, abs(y1 - p) / greatest(abs(y1) + abs(p), {EPS}) AS s1,
               abs(y2 - p) / greatest(abs(y2) + abs(p), {EPS}) AS s2, there FROM (
            SELECT id, dt, volume AS p, lead(volume) OVER w AS y1, lead(volume, 2) OVER w AS y2, lead(1, 2) OVER w AS there
            FROM ({READINGS}) WINDOW w AS (PARTITION BY id ORDER BY dt))) WHERE there IS NOT NULL""", ["smape"]))
def metric_smape_rowwise(spark, sf):
    rows = readings(spark, sf).select("id", "dt", "volume")
    made = xy_windows_nested(rows, RAW, ["volume"], ["volume"], n_tx=1, n_ty=2)
    y = F.flatten("y")
    p = F.transform(y, lambda _: F.col("x")[0][0])
    return finish(made.select("id", "dt", m.metric_smape_rowwise(y, p).alias("smape")))


RANK = "rank() OVER ({p} ORDER BY v) + (count(*) OVER (PARTITION BY {t} v) - 1) / 2.0::DOUBLE"


@query("rank_average", f"""
    SELECT event_id, event_type, {RANK.format(p='PARTITION BY event_type', t='event_type, ')} AS rank
    FROM (SELECT event_id, event_type, floor(value) AS v FROM events)""")
def rank_average_(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.floor("value").alias("v"))
    return rank_average(e, "v", ["event_type"]).select("event_id", "event_type", "rank")


@query("rank_average_global", f"""
    SELECT event_id, {RANK.format(p='', t='')} AS rank FROM (SELECT event_id, value AS v FROM events)""")
def rank_average_global_(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("value").alias("v"))
    return rank_average_global(e, "v").select("event_id", "rank")


