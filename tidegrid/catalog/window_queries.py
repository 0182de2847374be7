"""Supervised windows at one and two rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import GRID, GRID3, SERIES, grid
from tidegrid.functions.scalar import flatten_windows
from tidegrid.operators import windows as win
from tidegrid.operators.regularize import resample_mean


def sql_windows(source, x_cols, y_cols, n_tx, leads, keys=("id",), min_windows=0, reach=None):
    """Lagged columns of complete windows, as SQL."""
    k = ", ".join(keys)
    cols = [f"lead({c}, {i}) OVER w AS \"{c}_t-{n_tx - 1 - i}\"" for i in range(n_tx) for c in x_cols]
    cols += [f"lead({c}, {n_tx - 1 + j}) OVER w AS \"{c}_t+{j}\"" for j in leads for c in y_cols]
    reach = n_tx - 1 + max(leads) if reach is None else reach
    size = f"count(*) OVER (PARTITION BY {k}) - {reach}"
    return f"""
        SELECT * EXCLUDE (_there, _windows) FROM (
            SELECT {k}, dt, {', '.join(cols)}, lead(1, {reach}) OVER w AS _there, {size} AS _windows
            FROM ({source}) WINDOW w AS (PARTITION BY {k} ORDER BY dt))
        WHERE _there IS NOT NULL AND _windows >= {min_windows}"""


def names(x_cols, y_cols, n_tx, leads):
    return [f"{c}_t-{i}" for i in range(n_tx) for c in x_cols] + [f"{c}_t+{j}" for j in leads for c in y_cols]


@query("xy_windows_flat", rounded(
    sql_windows(GRID, ["speed"], ["speed"], 3, [1]), names(["speed"], ["speed"], 3, [1])))
def xy_windows_flat(spark, sf):
    return finish(win.xy_windows_flat(grid(spark, sf), SERIES, ["speed"], ["speed"], n_tx=3))


def _unnest(df, n_tx, n_vx, n_ty, x_cols, y_cols, leads):
    """Nested windows as flat columns, to compare them."""
    keep = [c for c in df.columns if c not in ("x", "y")]
    cols = [F.col("x")[i][v].alias(f"{x_cols[v]}_t-{n_tx - 1 - i}") for i in range(n_tx) for v in range(n_vx)]
    cols += [F.col("y")[i][v].alias(f"{c}_t+{leads[i]}") for i in range(n_ty) for v, c in enumerate(y_cols)]
    return df.select(*keep, *cols)


X2 = ["speed", "volume"]


@query("xy_windows_nested", rounded(
    sql_windows(GRID3, X2, ["speed"], 3, [2, 3]), names(X2, ["speed"], 3, [2, 3])))
def xy_windows_nested(spark, sf):
    made = win.xy_windows_nested(grid(spark, sf, ["speed", "volume", "occupancy"]), SERIES, X2, ["speed"], 3, 2, 2)
    return finish(_unnest(made, 3, 2, 2, X2, ["speed"], [2, 3]))


@query("flatten_windows", rounded(f"""
    SELECT id, dt, "speed_t-2" AS f0, "volume_t-2" AS f1, "speed_t-1" AS f2, "volume_t-1" AS f3,
           "speed_t-0" AS f4, "volume_t-0" AS f5
    FROM ({sql_windows(GRID3, X2, ["speed"], 3, [1])})""", [f"f{i}" for i in range(6)]))
def flatten_windows_(spark, sf):
    made = win.xy_windows_nested(grid(spark, sf, ["speed", "volume", "occupancy"]), SERIES, X2, ["speed"], 3)
    flat = made.withColumn("f", flatten_windows(F.col("x")))
    return finish(flat.select("id", "dt", *[F.col("f")[i].alias(f"f{i}") for i in range(6)]))


@query("xy_windows_strided", rounded(
    sql_windows(GRID, ["speed"], ["speed"], 4, [3, 6]), names(["speed"], ["speed"], 4, [3, 6])))
def xy_windows_strided(spark, sf):
    return finish(win.xy_windows_strided(
        grid(spark, sf), SERIES, ["speed"], ["speed"], n_tx=4, n_ty=2, n_ty_step=3))


def sql_dual(source, x_col, y_col, n_tx, n_ty, ratio, h=1, keys=("id",), min_windows=0, repeat=False):
    """Hourly inputs against targets of ``ratio`` hours, as SQL; ``repeat``: a last single
    target row stands for all of them (two targets)."""
    k = ", ".join(keys)
    skip = n_tx // ratio + h - 1
    bucket = f"time_bucket(INTERVAL '{ratio} hours', dt, TIMESTAMP '1970-01-01')"
    x = ", ".join(f'lead({x_col}, {i}) OVER w AS "{x_col}_t-{n_tx - 1 - i}"' for i in range(n_tx))
    y = ", ".join(f'lead({y_col}, {skip + i}) OVER w AS "{y_col}_t+{h + i}"' for i in range(n_ty))
    need = skip + n_ty - 1
    if repeat:
        need = skip
        y = ", ".join(
            f'CASE WHEN lead(1, {skip + i}) OVER w = 1 THEN lead({y_col}, {skip + i}) OVER w '
            f'ELSE lead({y_col}, {skip}) OVER w END AS "{y_col}_t+{h + i}"'
            for i in range(n_ty)
        )
    return f"""
        WITH g AS ({source}),
        ys AS (SELECT {k}, {bucket} AS dt, avg({y_col}) AS {y_col} FROM g GROUP BY ALL),
        xw AS (SELECT {k}, dt, {x}, lead(1, {n_tx - 1}) OVER w AS _x FROM g
               WINDOW w AS (PARTITION BY {k} ORDER BY dt)),
        yw AS (SELECT {k}, dt, {y}, lead(1, {need}) OVER w AS _y FROM ys
               WINDOW w AS (PARTITION BY {k} ORDER BY dt)),
        xy AS (SELECT *, count(*) OVER (PARTITION BY {k}) AS _n FROM xw JOIN yw USING ({k}, dt)
               WHERE _x IS NOT NULL AND _y IS NOT NULL)
        SELECT * EXCLUDE (_x, _y, _n) FROM xy WHERE _n >= {min_windows}"""


def dual_names(x_col, y_col, n_tx, n_ty, h=1):
    return [f"{x_col}_t-{i}" for i in range(n_tx)] + [f"{y_col}_t+{h + i}" for i in range(n_ty)]


def _two_rates(spark, sf, panel=SERIES, cols=("speed", "volume", "occupancy")):
    x = grid(spark, sf, list(cols))
    return x, resample_mean(x, panel, ["speed"], "3h")


DUAL_SQL = sql_dual(GRID3, "volume", "speed", 6, 2, 3)


@query("xy_windows_dual_flat", rounded(DUAL_SQL, dual_names("volume", "speed", 6, 2)))
def xy_windows_dual_flat(spark, sf):
    x, y = _two_rates(spark, sf)
    return finish(win.xy_windows_dual_flat(x, y, SERIES, ["volume"], ["speed"], "1h", "3h", 6, 2))


@query("xy_windows_dual_nested", rounded(DUAL_SQL, dual_names("volume", "speed", 6, 2)))
def xy_windows_dual_nested(spark, sf):
    x, y = _two_rates(spark, sf)
    made = win.xy_windows_dual_nested(x, y, SERIES, ["volume"], ["speed"], "1h", "3h", 6, 2)
    return finish(_unnest(made, 6, 1, 2, ["volume"], ["speed"], [1, 2]))


REPEAT_SQL = sql_dual(GRID3, "volume", "speed", 6, 2, 3, repeat=True)


@query("xy_windows_dual_repeat", rounded(REPEAT_SQL, dual_names("volume", "speed", 6, 2)))
def xy_windows_dual_repeat(spark, sf):
    x, y = _two_rates(spark, sf)
    return finish(win.xy_windows_dual_flat(x, y, SERIES, ["volume"], ["speed"], "1h", "3h", 6, 2, tail="repeat"))


WEEK = ("id", "year", "month", "week")
WEEKLY = """
    SELECT *, year(dt)::INT AS year, month(dt)::INT AS month, weekofyear(dt)::INT AS week FROM ({source})"""


@query("xy_windows_weekly", rounded(
    sql_windows(WEEKLY.format(source=GRID), ["speed"], ["speed"], 3, [1, 2], WEEK, 10),
    names(["speed"], ["speed"], 3, [1, 2])))
def xy_windows_weekly(spark, sf):
    return finish(win.xy_windows_weekly(grid(spark, sf), SERIES, ["speed"], ["speed"], n_tx=3, n_ty=2))


@query("xy_windows_dual_weekly", rounded(
    sql_dual(WEEKLY.format(source=GRID3), "volume", "speed", 6, 1, 3, keys=WEEK, min_windows=10),
    dual_names("volume", "speed", 6, 1)))
def xy_windows_dual_weekly(spark, sf):
    x, y = _two_rates(spark, sf)
    return finish(win.xy_windows_dual_weekly(x, y, SERIES, ["volume"], ["speed"], "1h", "3h", n_tx=6))

