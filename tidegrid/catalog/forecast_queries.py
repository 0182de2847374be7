"""Forecasting and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import GRID, READINGS, SERIES, grid, sql_interpolated, trials, TRIALS
from tidegrid.operators import forecast
from tidegrid.operators.regularize import resample_mean
from tidegrid.operators.split import tvt_split
from tidegrid.operators.trials import RandomFeatures, run_trials, sample_config, trial_grid
from tidegrid.operators.windows import xy_windows_flat

X, Y1, Y2 = "speed_t-0", "speed_t+1", "speed_t+2"


def _windows(spark, sf, n_ty=2):
    made = xy_windows_flat(grid(spark, sf), SERIES, ["speed"], ["speed"], n_tx=1, n_ty=n_ty)
    return tvt_split(made.where(F.col(f"`{X}`").isNotNull()), SERIES)


SPLIT = """
    SELECT *, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train'
                   WHEN pos < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY dt) - 1 AS pos,
                 count(*) OVER (PARTITION BY {keys}) AS n FROM ({source}))"""

PAIRS = f"""
    SELECT * FROM (SELECT id, dt, speed AS x, lead(speed) OVER w AS y1, lead(speed, 2) OVER w AS y2,
                          lead(1, 2) OVER w AS there FROM ({GRID}) WINDOW w AS (PARTITION BY id ORDER BY dt))
    WHERE there IS NOT NULL AND x IS NOT NULL"""
ROWS = SPLIT.format(keys="id", source=PAIRS)


@query("forecast_fit_predict", rounded(f"""
    WITH r AS MATERIALIZED ({ROWS}),
    m AS MATERIALIZED (SELECT regr_slope(y1, x) AS b1, regr_intercept(y1, x) AS a1, regr_slope(y2, x) AS b2,
                              regr_intercept(y2, x) AS a2 FROM r WHERE split = 'train')
    SELECT id, dt, a1 + b1 * x AS "{Y1}_hat", a2 + b2 * x AS "{Y2}_hat" FROM r CROSS JOIN m WHERE split = 'test'""",
    [f"{Y1}_hat", f"{Y2}_hat"], 6))
def forecast_fit_predict(spark, sf):
    out = forecast.forecast_fit_predict(_windows(spark, sf), [X], [Y1, Y2], "linear")
    return finish(out.select("id", "dt", f"{Y1}_hat", f"{Y2}_hat"), 6)


@query("tune_search", rounded(f"""
    WITH r AS ({ROWS}),
    m AS (SELECT regr_slope(y1, x) AS b, regr_intercept(y1, x) AS a, sum(x * y1) / sum(x * x) AS b0
          FROM r WHERE split = 'train'),
    l AS (SELECT 0 AS run, '{{"fitIntercept": true}}' AS params, avg(pow(y1 - a - b * x, 2)) AS loss
          FROM r, m WHERE split = 'valid'
          UNION ALL SELECT 1, '{{"fitIntercept": false}}', avg(pow(y1 - b0 * x, 2)) FROM r, m WHERE split = 'valid')
    SELECT *, loss = min(loss) OVER () AS is_best FROM l""", ["loss"], 6))
def tune_search(spark, sf):
    candidates = [{"fitIntercept": True}, {"fitIntercept": False}]
    return finish(forecast.tune_search(_windows(spark, sf), [X], [Y1], candidates).runs, 6)


@query("forecast_per_series", rounded(f"""
    WITH g AS ({GRID}), p AS (SELECT id, dt, speed AS x, lead(speed) OVER (PARTITION BY id ORDER BY dt) AS y FROM g),
    m AS (SELECT id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, arg_max(x, dt) AS last FROM p GROUP BY 1)
    SELECT id, 1 AS step, a + b * last AS y_hat FROM m WHERE b IS NOT NULL
    UNION ALL SELECT id, 2, a + b * (a + b * last) FROM m WHERE b IS NOT NULL""", ["y_hat"], 6))
def forecast_per_series(spark, sf):
    return finish(forecast.forecast_per_series(grid(spark, sf), SERIES, "speed", p=1, steps=2), 6)


# Slope, constant and remaining squares of a line, as the operator settles them: an input
# without variation has slope zero, an exact fit leaves a billionth of the target's squares.
def _line(y: str, x: str, to: str) -> str:
    slope = f"CASE WHEN regr_sxx({y}, {x}) <= 1e-9 * sum({x} * {x}) THEN 0 ELSE regr_sxy({y}, {x}) / regr_sxx({y}, {x}) END"
    return (
        f"{slope} AS b{to}, avg({y}) - ({slope}) * avg({x}) AS a{to}, "
        f"greatest(regr_syy({y}, {x}) - ({slope}) * regr_sxy({y}, {x}), 1e-9 * sum({y} * {y}), 1e-300) AS r{to}"
    )


@query("forecast_auto", rounded(f"""
    WITH g AS (SELECT id, dt, speed AS v0, speed - lag(speed) OVER (PARTITION BY id ORDER BY dt) AS v1 FROM ({GRID})),
    p AS (SELECT id, dt, v0, v1, lead(v0) OVER w AS y0, lead(v1) OVER w AS y1 FROM g WHERE v1 IS NOT NULL
          WINDOW w AS (PARTITION BY id ORDER BY dt)),
    m AS (SELECT id, count(*) AS n, {_line("y0", "v0", "0")}, {_line("y1", "v1", "1")}
          FROM p WHERE y0 IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
    l AS (SELECT id, arg_max(v0, dt) AS l0, arg_max(v1, dt) AS l1 FROM p GROUP BY 1),
    c AS (SELECT *, n * ln(r1 / n) < n * ln(r0 / n) - 1e-6 AS differ FROM m JOIN l USING (id)),
    s AS (SELECT *, CASE WHEN differ THEN l0 + a1 + b1 * l1 ELSE a0 + b0 * l0 END AS s1 FROM c)
    SELECT id, 1 AS p, differ::INT AS d, 1 AS step, s1 AS y_hat FROM s
    UNION ALL SELECT id, 1, differ::INT, 2, CASE WHEN differ THEN s1 + a1 + b1 * (s1 - l0) ELSE a0 + b0 * s1 END FROM s""",
    ["y_hat"], 5))
def forecast_auto(spark, sf):
    return finish(forecast.forecast_auto(grid(spark, sf), SERIES, "speed", max_p=1, max_d=1, steps=2), 5)


# Two inputs, the value and the residual before: slopes by Cramer's rule, along the larger
# axis alone where the smaller has no variation.
@query("forecast_arma", rounded(f"""
    WITH g AS (SELECT id, dt, speed AS x, lead(speed) OVER w AS y, lead(dt) OVER w AS next_dt FROM ({GRID}) WHERE speed IS NOT NULL
               WINDOW w AS (PARTITION BY id ORDER BY dt)),
    f AS (SELECT id, {_line("y", "x", "")} FROM g WHERE y IS NOT NULL GROUP BY 1),
    e AS (SELECT id, next_dt AS dt, y AS v, y - (a + b * x) AS e FROM g JOIN f USING (id) WHERE y IS NOT NULL),
    p AS (SELECT id, dt, v, e, lead(v) OVER (PARTITION BY id ORDER BY dt) AS y FROM e),
    m AS (SELECT id, count(*) AS n, {_line("y", "v", "0")}, regr_sxx(y, v) AS vv, regr_sxx(y, e) AS ee, regr_sxy(v, e) AS ve,
                 regr_sxy(y, v) AS vy, regr_sxy(y, e) AS ey, regr_syy(y, v) AS yy, avg(y) AS my, avg(v) AS mv, avg(e) AS me,
                 1e-9 * (sum(v * v) + sum(e * e)) AS least, sum(y * y) AS raw
          FROM p WHERE y IS NOT NULL GROUP BY 1 HAVING count(*) > 3),
    x AS (SELECT *, (vv + ee + sqrt(pow(vv - ee, 2) + 4 * ve * ve)) / 2 AS l1,
                 (vv + ee - sqrt(pow(vv - ee, 2) + 4 * ve * ve)) / 2 AS l2 FROM m),
    u AS (SELECT *, CASE WHEN vv >= ee THEN l1 - ee ELSE ve END AS u1, CASE WHEN vv >= ee THEN ve ELSE l1 - vv END AS u2 FROM x),
    k AS (SELECT *, CASE WHEN l2 > least THEN (ee * vy - ve * ey) / (vv * ee - ve * ve)
                         WHEN l1 > least THEN u1 * (u1 * vy + u2 * ey) / (u1 * u1 + u2 * u2) / l1 ELSE 0 END AS bv,
                 CASE WHEN l2 > least THEN (vv * ey - ve * vy) / (vv * ee - ve * ve)
                      WHEN l1 > least THEN u2 * (u1 * vy + u2 * ey) / (u1 * u1 + u2 * u2) / l1 ELSE 0 END AS be FROM u),
    c AS (SELECT *, n * ln(greatest(yy - bv * vy - be * ey, 1e-9 * raw, 1e-300) / n) + 2 < n * ln(r0 / n) - 1e-6 AS moving FROM k),
    l AS (SELECT id, arg_max(v, dt) AS lv, arg_max(e, dt) AS le FROM e GROUP BY 1),
    s AS (SELECT *, CASE WHEN moving THEN my - bv * mv - be * me ELSE a0 END AS c0, CASE WHEN moving THEN bv ELSE b0 END AS c1,
                 CASE WHEN moving THEN be * le ELSE 0 END AS c2 FROM c JOIN l USING (id))
    SELECT id, 1 AS p, 0 AS d, moving::INT AS q, 1 AS step, c0 + c1 * lv + c2 AS y_hat FROM s
    UNION ALL SELECT id, 1, 0, moving::INT, 2, c0 + c1 * (c0 + c1 * lv + c2) FROM s""", ["y_hat"], 4))
def forecast_arma(spark, sf):
    made = forecast.forecast_auto(grid(spark, sf), SERIES, "speed", max_p=1, max_d=0, steps=2, max_q=1, long=1)
    return finish(made, 4)


SPACE = {"ridge": [0.0, 100.0, 10000.0, 1000000.0], "intercept": [True, False]}


# Eight candidates, nine runs: six in the first half of the time, the best three in all of it.
@query("halving_search", rounded(f"""
    WITH r AS MATERIALIZED (SELECT * FROM ({ROWS}) WHERE y1 IS NOT NULL),
    t AS (SELECT epoch_us(min(dt)) AS lo, epoch_us(max(dt)) AS hi FROM r WHERE split = 'train'),
    s AS (SELECT 0 AS rung, avg(x) AS mx, avg(y1) AS my, regr_sxx(y1, x) AS xx, regr_sxy(y1, x) AS xy, sum(x * x) AS rx, sum(x * y1) AS ry
          FROM r, t WHERE split = 'train' AND epoch_us(dt) >= hi - (hi - lo) // 2
          UNION ALL SELECT 1, avg(x), avg(y1), regr_sxx(y1, x), regr_sxy(y1, x), sum(x * x), sum(x * y1) FROM r WHERE split = 'train'),
    c AS (SELECT (row_number() OVER (ORDER BY md5('0|' || params)) - 1)::INT AS candidate, * FROM (
          SELECT ridge, intercept, '{{"intercept": ' || intercept || ', "ridge": ' || ridge || '}}' AS params
          FROM (SELECT unnest([0.0, 100.0, 10000.0, 1000000.0]::DOUBLE[]) AS ridge), (SELECT unnest([true, false]) AS intercept))),
    f AS (SELECT candidate, params, rung, CASE WHEN intercept THEN xy / (xx + ridge) ELSE ry / (rx + ridge) END AS b,
                 CASE WHEN intercept THEN my - xy / (xx + ridge) * mx ELSE 0 END AS a FROM c, s),
    l AS (SELECT candidate, params, rung, avg(pow(y1 - a - b * x, 2)) AS loss FROM f, r WHERE split = 'valid' GROUP BY ALL),
    one AS (SELECT candidate, loss, row_number() OVER (ORDER BY loss, candidate) AS place FROM l WHERE rung = 0 AND candidate < 6),
    two AS (SELECT l.candidate, l.loss, row_number() OVER (ORDER BY l.loss, l.candidate) AS place
            FROM l JOIN one USING (candidate) WHERE rung = 1 AND one.place <= 3)
    SELECT c.candidate, c.params, (CASE WHEN two.place IS NOT NULL THEN 2 WHEN one.place IS NOT NULL THEN 1 ELSE 0 END)::INT AS rungs,
           coalesce(two.loss, one.loss) AS loss,
           CASE WHEN two.place = 1 THEN 'best' WHEN one.place IS NOT NULL THEN 'stopped' ELSE 'not run' END AS status
    FROM c LEFT JOIN one USING (candidate) LEFT JOIN two USING (candidate)""", ["loss"], 5))
def halving_search(spark, sf):
    return finish(forecast.halving_search(_windows(spark, sf), [X], [Y1], SPACE, runcount=9).runs, 5)


@query("sample_config", f"""
    SELECT n_agg, mclass, features FROM (SELECT DISTINCT n_agg, mclass, features FROM ({TRIALS}))
    ORDER BY md5(concat_ws('|', '7', n_agg, mclass, features)) LIMIT 1""")
def sample_config_(spark, sf):
    configs = trials(spark, sf).select("n_agg", "mclass", "features").distinct()
    return sample_config(configs, 7)


RATES = [1, 2, 3]
MODELS = ["persistence", "linear"]


def _rate_sql(rate):
    base = sql_interpolated(READINGS, ["volume"])
    return f"""
    SELECT * FROM (SELECT {rate} AS n_agg, id, dt, volume AS x, lead(volume) OVER w AS y, lead(1) OVER w AS there
        FROM (SELECT id, time_bucket(INTERVAL '{rate} hours', dt, TIMESTAMP '1970-01-01') AS dt, avg(volume) AS volume
              FROM ({base}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY id ORDER BY dt)) WHERE there IS NOT NULL"""


@query("run_trials", rounded(f"""
    WITH r AS ({SPLIT.format(keys='n_agg, id', source=' UNION ALL '.join(_rate_sql(r) for r in RATES))}),
    m AS (SELECT n_agg, id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r WHERE split = 'train' GROUP BY 1, 2),
    h AS (SELECT n_agg - 1 AS exptid, id, y, x AS y_hat FROM r WHERE split = 'test'
          UNION ALL SELECT n_agg + 2, id, y, a + b * x FROM r JOIN m USING (n_agg, id) WHERE split = 'test')
    SELECT exptid::BIGINT AS exptid, id, avg(pow(y - y_hat, 2)) AS mse, avg(abs(y - y_hat)) AS mae
    FROM h GROUP BY 1, 2""", ["mse", "mae"], 5))
def run_trials_(spark, sf):
    base = grid(spark, sf, ["volume"])
    parts = []
    for rate in RATES:
        rows = base if rate == 1 else resample_mean(base, SERIES, ["volume"], f"{rate}h")
        made = xy_windows_flat(rows, SERIES, ["volume"], ["volume"])
        parts.append(tvt_split(made, SERIES).withColumn("n_agg", F.lit(rate)))
    windows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    plan = trial_grid(spark, {"n_agg": RATES, "mclass": MODELS})
    scored, _ = run_trials(
        windows, plan, ["n_agg"], ["volume_t-0"], ["volume_t+1"], metrics=["mse", "mae"]
    )
    return finish(scored, 5)


FEATURES = RandomFeatures(count=2, ridge=5.0, width=97.0, seed=3)


def _cosine(k: int) -> str:
    weights, phase = FEATURES.mixtures(1)[k]
    return f"cos({phase!r}::DOUBLE + {weights[0]!r}::DOUBLE * x)"


@query("run_trials_nonlinear", rounded(f"""
    WITH r AS (SELECT *, {_cosine(0)} AS z0, {_cosine(1)} AS z1
               FROM ({SPLIT.format(keys='n_agg, id', source=' UNION ALL '.join(_rate_sql(r) for r in RATES[:2]))})),
    m AS (SELECT n_agg, id, regr_sxx(y, z0) + {FEATURES.ridge} AS s00, regr_sxx(y, z1) + {FEATURES.ridge} AS s11, regr_sxy(z0, z1) AS s01,
                 regr_sxy(y, z0) AS t0, regr_sxy(y, z1) AS t1, avg(y) AS my, avg(z0) AS m0, avg(z1) AS m1
          FROM r WHERE split = 'train' GROUP BY 1, 2),
    k AS (SELECT *, (s11 * t0 - s01 * t1) / (s00 * s11 - s01 * s01) AS b0, (s00 * t1 - s01 * t0) / (s00 * s11 - s01 * s01) AS b1 FROM m),
    h AS (SELECT n_agg - 1 AS exptid, id, y, x AS y_hat FROM r WHERE split = 'test'
          UNION ALL SELECT n_agg + 1, id, y, my + b0 * (z0 - m0) + b1 * (z1 - m1) FROM r JOIN k USING (n_agg, id) WHERE split = 'test')
    SELECT exptid::BIGINT AS exptid, id, avg(pow(y - y_hat, 2)) AS mse, avg(abs(y - y_hat)) AS mae
    FROM h GROUP BY 1, 2""", ["mse", "mae"], 5))
def run_trials_nonlinear(spark, sf):
    base = grid(spark, sf, ["volume"])
    parts = []
    for rate in RATES[:2]:
        rows = base if rate == 1 else resample_mean(base, SERIES, ["volume"], f"{rate}h")
        made = xy_windows_flat(rows, SERIES, ["volume"], ["volume"])
        parts.append(tvt_split(made, SERIES).withColumn("n_agg", F.lit(rate)))
    plan = trial_grid(spark, {"n_agg": RATES[:2], "mclass": ["persistence", "random_features"]})
    scored, _ = run_trials(
        parts[0].unionByName(parts[1]), plan, ["n_agg"], ["volume_t-0"], ["volume_t+1"], metrics=["mse", "mae"], features=FEATURES
    )
    return finish(scored, 5)
