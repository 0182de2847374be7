"""Regularisation and row features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import (
    GRID3, HOURLY, READINGS, SERIES, VALUES, grid, hourly, RAW, readings, sql_interpolated, table,
)
from tidegrid.operators import regularize as reg
from tidegrid.operators.joins import union_all


@query("validate_series", """
    SELECT o_custkey AS id, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) < 8""")
def validate_series(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"))
    return reg.validate_series(orders, SERIES, 8)


@query("dt_is_unique", """
    SELECT o_custkey AS id, count(*) = count(DISTINCT o_orderdate) AS is_unique FROM orders GROUP BY 1""")
def dt_is_unique(spark, sf):
    orders = table(spark, sf, "orders")
    rows = orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("dt"))
    return reg.dt_is_unique(rows, SERIES)


GAPS = """
    SELECT id, gap_us FROM (
        SELECT id, epoch_us(dt) - epoch_us(lag(dt) OVER (PARTITION BY id ORDER BY dt)) AS gap_us FROM ({source}))
    WHERE gap_us IS NOT NULL
"""
HOUR_GAPS = GAPS.format(source=HOURLY)
RAW_GAPS = GAPS.format(source=READINGS)


@query("gap_counts", f"SELECT id, gap_us, count(*) AS n FROM ({HOUR_GAPS}) GROUP BY 1, 2")
def gap_counts(spark, sf):
    return reg.gap_counts(hourly(spark, sf), SERIES)


@query("infer_freq", f"""
    SELECT id, CASE WHEN min(gap_us) = max(gap_us) THEN min(gap_us) END AS freq_us
    FROM ({GAPS.format(source=sql_interpolated(READINGS, ['volume'], '1 hour'))}) GROUP BY 1
    UNION ALL
    SELECT id + 1000000000, CASE WHEN min(gap_us) = max(gap_us) THEN min(gap_us) END FROM ({HOUR_GAPS}) GROUP BY 1""")
def infer_freq(spark, sf):
    regular = reg.infer_freq(grid(spark, sf, ["volume"]), SERIES)
    gappy = reg.infer_freq(hourly(spark, sf), SERIES)
    return regular.unionByName(gappy.withColumn("id", F.col("id") + 1000000000))


# What stands in each calendar: the distinct periods of all orders, per priority and for all.
CALENDARS = {
    "month": "date_trunc('month', o_orderdate)", "month_end": "last_day(o_orderdate)",
    "quarter": "date_trunc('quarter', o_orderdate)", "year": "date_trunc('year', o_orderdate)",
    "week": "date_trunc('week', o_orderdate)", "day": "o_orderdate",
    "weekday": "CASE WHEN {weekday} < 5 THEN o_orderdate END",
}
STARTS = " ".join(f"WHEN {m} THEN '{name}'" for m, name in enumerate(reg.MONTHS, 1))


def _calendars(spark, sf):
    orders = table(spark, sf, "orders")
    parts = [
        orders.select(F.concat_ws(" ", F.lit(kind), p).alias("id"), F.expr(at.format(weekday="weekday(o_orderdate)")).cast("timestamp").alias("dt"))
        for kind, at in CALENDARS.items() for p in (F.col("o_orderpriority"), F.lit("all"))
    ]
    return union_all(*parts).where("dt IS NOT NULL").distinct()


CALENDAR_SQL = " UNION ".join(
    f"SELECT '{kind} ' || {p} AS id, ({at.format(weekday='isodow(o_orderdate) - 1')})::TIMESTAMP AS dt FROM orders"
    for kind, at in CALENDARS.items() for p in ("o_orderpriority", "'all'")
)


@query("infer_calendar_freq", f"""
    WITH c AS (SELECT id, dt, lag(dt) OVER (PARTITION BY id ORDER BY dt) AS p FROM ({CALENDAR_SQL}) WHERE dt IS NOT NULL),
    f AS (SELECT id, count(*) AS n, min(dt - p) AS lo, max(dt - p) AS hi, min(datediff('month', p, dt)) AS m0, max(datediff('month', p, dt)) AS m1,
                 bool_and(day(dt) = 1 AND day(p) = 1) AS starts, bool_and(dt = last_day(dt) AND p = last_day(p)) AS ends,
                 bool_and(isodow(dt) < 6 AND isodow(p) < 6 AND date_diff('day', p, dt) = CASE WHEN isodow(p) = 5 THEN 3 ELSE 1 END) AS work,
                 min(month(dt)) AS least, max(month(dt)) AS most, max(isodow(dt)) AS dow FROM c WHERE p IS NOT NULL GROUP BY 1)
    SELECT id, CASE WHEN n < 2 THEN NULL
        WHEN m0 = m1 AND m0 >= 1 AND (starts OR ends) THEN
            CASE WHEN m0 % 12 = 0 THEN CASE WHEN m0 > 12 THEN (m0 // 12)::VARCHAR ELSE '' END || 'Y' || CASE WHEN starts THEN 'S-' ELSE 'E-' END || CASE most {STARTS} END
                 WHEN m0 % 3 = 0 THEN CASE WHEN m0 > 3 THEN (m0 // 3)::VARCHAR ELSE '' END || 'Q' || CASE WHEN starts THEN 'S-' ELSE 'E-' END || CASE (least - 1) % 3 + 1 {STARTS} END
                 ELSE CASE WHEN m0 > 1 THEN m0::VARCHAR ELSE '' END || 'M' || CASE WHEN starts THEN 'S' ELSE 'E' END END
        WHEN lo = hi AND date_diff('day', TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + lo) % 7 = 0 THEN
            CASE WHEN lo > INTERVAL 7 DAY THEN (date_diff('day', TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + lo) // 7)::VARCHAR ELSE '' END
            || 'W-' || ['MON', 'TUE', 'WED', 'THU', 'FRI', 'SAT', 'SUN'][dow]
        WHEN lo = hi THEN CASE WHEN lo > INTERVAL 1 DAY THEN date_diff('day', TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-01' + lo)::VARCHAR ELSE '' END || 'D'
        WHEN work THEN 'B' END AS freq FROM f""")
def infer_calendar_freq(spark, sf):
    return reg.infer_calendar_freq(_calendars(spark, sf), RAW)


@query("min_gap_freq", f"SELECT id, min(gap_us) AS freq_us FROM ({RAW_GAPS}) GROUP BY 1")
def min_gap_freq(spark, sf):
    rows = readings(spark, sf)
    return reg.min_gap_freq(rows, RAW)


FILLED = """
    WITH h AS ({source}), span AS (SELECT id, min(dt) AS lo, max(dt) AS hi FROM h GROUP BY 1),
    cells AS (SELECT id, unnest(generate_series(lo, hi, INTERVAL '1 hour')) AS dt FROM span)
    SELECT c.id, c.dt, CASE WHEN h.id IS NULL THEN {fill} ELSE h.volume END AS volume
    FROM cells c LEFT JOIN h ON c.id = h.id AND c.dt = h.dt
"""


# Every hour twice for a third of the series: duplicates are averaged before gaps are filled.
REPEATED = f"""
    SELECT id, dt, avg(volume) AS volume FROM (
        SELECT id, dt, volume FROM ({HOURLY})
        UNION ALL SELECT id, dt, volume + 4 FROM ({HOURLY}) WHERE id % 3 = 0) GROUP BY 1, 2"""


@query("gap_fill", rounded(FILLED.format(source=REPEATED, fill="-1.0"), ["volume"]))
def gap_fill(spark, sf):
    rows = hourly(spark, sf).select("id", "dt", "volume")
    again = rows.where("id % 3 = 0").withColumn("volume", F.col("volume") + 4)
    single = reg.average_duplicates(rows.unionByName(again), SERIES, ["volume"])
    return finish(reg.gap_fill(single, SERIES, "1h", fill_value=-1.0))


@query("gap_fill_inferred", rounded(f"""
    WITH h AS ({HOURLY}),
    freq AS (SELECT id, min(gap_us) AS f FROM ({HOUR_GAPS}) GROUP BY 1),
    span AS (SELECT id, min(dt) AS lo, max(dt) AS hi, min(f) AS f FROM h JOIN freq USING (id) GROUP BY 1),
    cells AS (SELECT id, unnest(generate_series(lo, hi, to_microseconds(f))) AS dt FROM span)
    SELECT c.id, c.dt, h.volume FROM cells c LEFT JOIN h ON c.id = h.id AND c.dt = h.dt""", ["volume"]))
def gap_fill_inferred(spark, sf):
    return finish(reg.gap_fill_inferred(hourly(spark, sf).select("id", "dt", "volume"), SERIES))


@query("interpolate_linear", rounded(GRID3, VALUES))
def interpolate_linear(spark, sf):
    return finish(grid(spark, sf, VALUES))


DAILY = """
    SELECT o_orderpriority AS id, o_totalprice AS speed,
           o_orderdate + to_hours(CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE 0 END) AS dt FROM orders"""


@query("interpolate_exact", rounded(sql_interpolated(DAILY, ["speed"], "1 day", snap="exact"), ["speed"], 6))
def interpolate_exact(spark, sf):
    """Only readings exactly on the grid count; every third one is five hours off it."""
    late = F.when(F.col("o_orderkey") % 3 == 0, F.expr("interval 5 hours")).otherwise(F.expr("interval 0 hours"))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("id"), (F.col("o_orderdate") + late).alias("dt"), F.col("o_totalprice").alias("speed")
    )
    return finish(reg.interpolate_linear(rows, RAW, ["speed"], "1D", snap="exact"), 6)


@query("resample_mean", rounded(f"""
    SELECT id, time_bucket(INTERVAL '10 minutes', dt) AS dt, avg(speed) AS speed, avg(volume) AS volume
    FROM ({READINGS}) GROUP BY 1, 2""", ["speed", "volume"]))
def resample_mean(spark, sf):
    return finish(reg.resample_mean(readings(spark, sf), SERIES, ["speed", "volume"], "10min"))


MONTHLY = f"SELECT *, year(dt)::INT AS year, month(dt)::INT AS month FROM ({READINGS})"
MONTH_GRID = sql_interpolated(MONTHLY, VALUES, "1 hour", ("id", "year", "month"))


@query("interpolate_resample", rounded(f"""
    SELECT id, year, month, time_bucket(INTERVAL '3 hours', dt, TIMESTAMP '1970-01-01') AS dt,
           avg(speed) AS speed, avg(volume) AS volume, avg(occupancy) AS occupancy
    FROM ({MONTH_GRID}) GROUP BY ALL""", VALUES))
def interpolate_resample(spark, sf):
    rows = readings(spark, sf).withColumns({"year": F.year("dt"), "month": F.month("dt")})
    panel = SERIES.within("year", "month")
    return finish(reg.interpolate_resample(rows, panel, VALUES, "1h", "3h", snap="mean"))


@query("resample_multi", rounded(f"""
    WITH g AS ({GRID3})
    SELECT x.id, x.dt, x.volume, y.speed FROM g x JOIN (
        SELECT id, time_bucket(INTERVAL '6 hours', dt, TIMESTAMP '1970-01-01') AS dt, avg(speed) AS speed
        FROM g GROUP BY 1, 2) y ON x.id = y.id AND x.dt = y.dt""", ["volume", "speed"]))
def resample_multi(spark, sf):
    x, y = reg.resample_multi(
        readings(spark, sf), SERIES, ["volume"], ["speed"], "1h", "1h", "6h", snap="mean"
    )
    return finish(x.join(y, ["id", "dt"]))


@query("time_features", "SELECT event_id, ts, (isodow(ts) - 1)::INT AS dow, hour(ts)::INT AS hod FROM events")
def time_features(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return finish(reg.time_features(e, "ts"))


@query("shift", rounded(f"""
    SELECT id, dt, lag(volume, 2, -1.0) OVER w AS down, lead(volume, 1, -1.0) OVER w AS up
    FROM ({READINGS}) WINDOW w AS (PARTITION BY id ORDER BY dt)""", ["down", "up"]))
def shift(spark, sf):
    rows = readings(spark, sf).select("id", "dt", F.col("volume").alias("down"), F.col("volume").alias("up"))
    return finish(reg.shift(reg.shift(rows, RAW, ["down"], 2, -1.0), RAW, ["up"], -1, -1.0))


@query("every_nth", f"""
    SELECT id, dt FROM (SELECT id, dt, row_number() OVER (PARTITION BY id ORDER BY dt) AS rn FROM ({READINGS}))
    WHERE (rn - 1) % 3 = 0""")
def every_nth(spark, sf):
    rows = readings(spark, sf).select("id", "dt")
    return finish(reg.every_nth(rows, RAW, 3))


# Prices of orders by customer in bins of a calendar: its name, and the day that names a bin.
CALENDAR_BINS = {
    "MS": "date_trunc('month', dt)", "ME": "last_day(dt)::TIMESTAMP",
    "QS-FEB": "date_trunc('quarter', dt - INTERVAL 1 MONTH) + INTERVAL 1 MONTH",
    "W-MON": "date_trunc('week', dt - INTERVAL 1 DAY) + INTERVAL 7 DAY",
    "B": "CASE WHEN isodow(dt) > 5 THEN date_trunc('week', dt) + INTERVAL 4 DAY ELSE date_trunc('day', dt) END",
}
PRICES = "SELECT o_custkey AS id, o_orderdate::TIMESTAMP AS dt, o_totalprice::DOUBLE AS price FROM orders"
CALENDAR_MEANS = " UNION ALL ".join(
    f"SELECT '{name}' AS freq, id, {bin} AS dt, avg(price) AS price FROM ({PRICES}) GROUP BY ALL" for name, bin in CALENDAR_BINS.items()
)


def _calendar_means(spark, sf, *names):
    prices = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("dt"), F.col("o_totalprice").cast("double").alias("price")
    )
    return union_all(*[reg.resample_mean(prices, RAW, ["price"], n).withColumn("freq", F.lit(n)) for n in names])


@query("resample_mean_calendar", rounded(f"""
    SELECT * FROM ({CALENDAR_MEANS}) UNION ALL
    SELECT '2MS', id, lo + to_months(2 * (datediff('month', lo, dt) // 2)::INT), avg(price)
    FROM (SELECT *, date_trunc('month', min(dt) OVER (PARTITION BY id)) AS lo FROM ({PRICES})) GROUP BY ALL""", ["price"]))
def resample_mean_calendar(spark, sf):
    return finish(_calendar_means(spark, sf, *CALENDAR_BINS, "2MS"))


CALENDAR_CELLS = " UNION ALL ".join(
    f"""SELECT '{name}' AS freq, id, unnest(generate_series(lo, hi, INTERVAL {step})) AS dt
        FROM (SELECT id, min(dt) AS lo, max(dt) AS hi FROM m WHERE freq = '{name}' GROUP BY 1)"""
    for name, step in (("MS", "1 MONTH"), ("QS-FEB", "3 MONTH"), ("W-MON", "7 DAY"))
)


@query("gap_fill_calendar", rounded(f"""
    WITH m AS ({CALENDAR_MEANS}), cells AS ({CALENDAR_CELLS})
    SELECT c.freq, c.id, c.dt, CASE WHEN m.id IS NULL THEN -1.0 ELSE m.price END AS price
    FROM cells c LEFT JOIN m ON m.freq = c.freq AND m.id = c.id AND m.dt = c.dt""", ["price"]))
def gap_fill_calendar(spark, sf):
    """Months, quarters and weeks in which a customer ordered nothing stand at -1."""
    names = ["MS", "QS-FEB", "W-MON"]
    filled = [reg.gap_fill(_calendar_means(spark, sf, n), RAW.within("freq"), n, -1.0) for n in names]
    return finish(union_all(*filled))
