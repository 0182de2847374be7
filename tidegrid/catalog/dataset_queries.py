"""The two preparation jobs, summarised per data set and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import READINGS, readings, sql_interpolated, table
from tidegrid.plans.datasets import (
    DatasetConf, build_dataset_dual_rate, build_dataset_single_rate,
)

CONF = DatasetConf(
    n_tx=12, n_ty=1, base_freq="1h", y_freq="6h", n_aggs=(60, 120),
    column_sets=(("speed",), ("speed", "volume")), snap="mean",
)
COLS = ["speed", "volume"]


def _meta(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    places = n.join(r, n.n_regionkey == r.r_regionkey)
    return c.join(places, c.c_nationkey == places.n_nationkey).select(
        F.col("c_custkey").alias("id"),
        F.col("r_name").alias("road"),
        F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S").alias("direction"),
        F.col("c_acctbal").alias("ord"),
    )


META = """
    SELECT c_custkey AS id, r_name AS road, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 'S' END AS direction,
           c_acctbal AS ord
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_custkey IN (SELECT user_id FROM events)"""
KEPT = f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY road, direction) AS _n FROM ({META})) WHERE _n > 2"
NEIGHBORS = f"""
    SELECT * FROM (SELECT road, direction, id, lag(id) OVER w AS p, lead(id) OVER w AS q FROM ({KEPT})
                   WINDOW w AS (PARTITION BY road, direction ORDER BY ord, id))
    WHERE p IS NOT NULL AND q IS NOT NULL"""
TRIMMED = f"""
    SELECT * EXCLUDE (lo, hi), year(dt)::INT AS year, month(dt)::INT AS month FROM (
        SELECT *, min(dt) OVER w AS lo, max(dt) OVER w AS hi FROM ({READINGS})
        WHERE id IN (SELECT id FROM ({KEPT})) WINDOW w AS (PARTITION BY id, year(dt), month(dt)))
    WHERE dt >= lo + to_days(((8 - isodow(lo)) % 7)::INT) AND dt <= hi - to_days((isodow(hi) % 7)::INT)"""
BASE = sql_interpolated(TRIMMED, COLS, "1 hour", ("id", "year", "month"))


def _rate(hours, cols):
    bucket = f"time_bucket(INTERVAL '{hours} hours', dt, TIMESTAMP '1970-01-01')"
    return f"""SELECT id, year, month, {bucket} AS dt, {', '.join(f'avg({c}) AS {c}' for c in cols)}
               FROM base WHERE isodow({bucket}) < 6 GROUP BY ALL"""


def _scaled(c):
    span = f"(max({c}) OVER s - min({c}) OVER s)"
    scale = f"(1.0::DOUBLE / CASE WHEN {span} = 0 THEN 1.0 ELSE {span} END)"
    return f"{c} * {scale} - (min({c}) OVER s) * {scale}"


def _combination(n_agg, spatial, single):
    """Window sums of every column for one rate and neighbourhood, as CTEs."""
    name = f"{'sp' if spatial else 'own'}{n_agg}"
    sides = [0, 1, 2] if spatial else [None]
    cols = [f"v{s}_{c}" if s is not None else c for s in sides for c in COLS]
    if spatial:
        picked = ", ".join(f"r{s}.{c} AS v{s}_{c}" for s in sides for c in COLS)
        rows = f"""SELECT r1.id, r1.year, r1.month, r1.dt, {picked} FROM ({NEIGHBORS}) n
            JOIN rate{n_agg} r1 ON r1.id = n.id JOIN rate{n_agg} r0 ON r0.id = n.p AND r0.dt = r1.dt
            JOIN rate{n_agg} r2 ON r2.id = n.q AND r2.dt = r1.dt"""
    else:
        rows = f"SELECT r.* FROM rate{n_agg} r WHERE id IN (SELECT id FROM ({NEIGHBORS}))"
    cols = cols + ["dow", "hod"]
    target = "v1_speed" if spatial else "speed"
    scaled = ", ".join(f"{_scaled(c)} AS {c}" for c in cols)
    reach = 12
    sums = ", ".join(
        f"sum({c}) OVER (PARTITION BY id, year, month, week ORDER BY dt ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS s_{c}"
        for c in cols
    )
    ends = ", ".join(f"{c} AS f_{c}, lead({c}, 11) OVER w AS l_{c}" for c in cols)
    y = f", lead({target}, 12) OVER w AS y" if single else ""
    ctes = f"""
    {name}_rows AS (SELECT *, (isodow(dt) - 1)::DOUBLE AS dow, hour(dt)::DOUBLE AS hod, weekofyear(dt) AS week
                    FROM ({rows})),
    {name}_scaled AS (SELECT id, year, month, week, dt, {scaled} FROM {name}_rows WINDOW s AS (PARTITION BY id)),
    {name}_x AS (SELECT id, year, month, week, dt, {sums}, {ends}, lead(1, {reach if single else 11}) OVER w AS there{y}
                 FROM {name}_scaled WINDOW w AS (PARTITION BY id, year, month, week ORDER BY dt)),"""
    if single:
        ctes += f"""
    {name} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY id, year, month, week) AS n FROM {name}_x
               WHERE there IS NOT NULL) WHERE n >= 10),"""
    else:
        ctes += f"""
    {name} AS (SELECT * FROM (SELECT x.*, yw.y, count(*) OVER (PARTITION BY x.id, x.year, x.month, x.week) AS n
               FROM {name}_x x JOIN yw ON x.id = yw.id AND x.dt = yw.dt AND x.week = yw.week AND x.month = yw.month
               WHERE x.there IS NOT NULL AND yw.there IS NOT NULL) WHERE n >= 10),"""
    parts = []
    for features in ("sf", "stf") if spatial else ("f", "tf"):
        for n_vx in (1, 2):
            used = [c for c in cols[:-2] if n_vx == 2 or c.endswith("speed")]
            used += ["dow", "hod"] if "t" in features else []
            total = " + ".join(f"coalesce(s_{c}, 0)" for c in used)
            parts.append(
                f"SELECT '{features}' AS features, {n_vx} AS n_vx, {n_agg} AS n_agg, id, count(*) AS n_windows, "
                f"12 AS n_steps, {len(used)} AS n_cols, sum({total}) AS sum_x, sum(f_{used[0]}) AS first_first, "
                f"sum(f_{used[-1]}) AS first_last, sum(l_{used[0]}) AS last_first, sum(l_{used[-1]}) AS last_last, "
                f"sum(y) AS sum_y FROM {name} GROUP BY id"
            )
    return ctes, parts


def _dataset_sql(single):
    ctes, parts = "", []
    for n_agg in (60, 120):
        for spatial in (False, True):
            c, p = _combination(n_agg, spatial, single)
            ctes += c
            parts += p
    skip = {60: 2, 120: 4}
    y_sql = []
    if not single:
        # n_tx = 12 inputs span 2 target bins at 1 h and 4 at 2 h.
        ctes = ""
        parts = []
        for n_agg in (60, 120):
            ctes += f"""
    yw{n_agg} AS (SELECT id, month, week, dt, lead(speed, {skip[n_agg]}) OVER w AS y, lead(1, {skip[n_agg]}) OVER w AS there
           FROM (SELECT *, weekofyear(dt) AS week FROM y_rate) WINDOW w AS (PARTITION BY id, year, month, week ORDER BY dt)),"""
            for spatial in (False, True):
                c, p = _combination(n_agg, spatial, single)
                ctes += c.replace("yw", f"yw{n_agg}")
                parts += p
        y_sql = [f"y_rate AS ({_rate(6, ['speed'])}),"]
    return f"""
    WITH base AS ({BASE}), rate60 AS ({_rate(1, COLS)}), rate120 AS ({_rate(2, COLS)}), {' '.join(y_sql)}
    {ctes.rstrip().rstrip(',')}
    {' UNION ALL '.join(parts)}"""


# Columns of the widest inputs: values of three series and the two time features.
WIDEST = 3 * len(COLS) + 2


def _summary(windows):
    """Sums of all values and of the corner values, which tell steps and columns apart.

    Windows open into their steps, whose values are added by column: a function over the
    elements of an array is interpreted for every value, sums of columns are compiled."""
    steps = windows.select("features", "n_vx", "n_agg", "id", "y", F.size("x").alias("n"), F.posexplode("x").alias("i", "row"))
    at = F.col("i")
    total = sum((F.coalesce(F.get("row", F.lit(j)), F.lit(0.0)) for j in range(1, WIDEST)), F.coalesce(F.get("row", F.lit(0)), F.lit(0.0)))
    first, last = at == 0, at == F.col("n") - 1
    head, tail = F.get("row", F.lit(0)), F.element_at("row", -1)
    return steps.groupBy("features", "n_vx", "n_agg", "id").agg(
        F.count(F.when(first, 1)).alias("n_windows"),
        F.max("n").alias("n_steps"),
        F.max(F.size("row")).alias("n_cols"),
        F.sum(total).alias("sum_x"),
        F.sum(F.when(first, head)).alias("first_first"),
        F.sum(F.when(first, tail)).alias("first_last"),
        F.sum(F.when(last, head)).alias("last_first"),
        F.sum(F.when(last, tail)).alias("last_last"),
        F.sum(F.when(first, F.col("y")[0][0])).alias("sum_y"),
    )


SUMS = ["sum_x", "first_first", "first_last", "last_first", "last_last", "sum_y"]


@query("build_dataset_single_rate", rounded(_dataset_sql(True), SUMS, 5))
def single_rate(spark, sf):
    return finish(_summary(build_dataset_single_rate(_meta(spark, sf), readings(spark, sf), CONF)), 5)


@query("build_dataset_dual_rate", rounded(_dataset_sql(False), SUMS, 5))
def dual_rate(spark, sf):
    return finish(_summary(build_dataset_dual_rate(_meta(spark, sf), readings(spark, sf), CONF)), 5)
