"""Joins, counts, pivots, completeness and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.tables import (
    HOURLY, META, READINGS, SERIES, TRIALS, VALUES, VARIANTS, hourly, meta, readings, table, trials,
)
from tidegrid.operators import joins, quality
from tidegrid.operators.regularize import resample_mean
from tidegrid.operators.trials import trial_grid
from tidegrid.operators.windows import xy_windows_nested
from tidegrid.plans.nullity import nullity_report
from tidegrid.session import shared_folder, stage
from tidegrid.sources import readers, writers

# ------------------------------------------------------------------------ joins


@query("common_ids", f"SELECT id FROM ({META}) INTERSECT SELECT id FROM ({READINGS})")
def common_ids(spark, sf):
    return joins.common_ids(meta(spark, sf), [readings(spark, sf)])


@query("filter_by_common_id", f"""
    SELECT id, dt, volume FROM ({READINGS})
    WHERE id IN (SELECT id FROM ({META}) WHERE direction <> 'East')""")
def filter_by_common_id(spark, sf):
    tables = {
        "meta": meta(spark, sf).where("direction <> 'East'"),
        "zone": readings(spark, sf).select("id", "dt", "volume"),
        "lane": None,
    }
    return finish(joins.filter_by_common_id(tables)["zone"])


NEIGHBORS = f"""
    SELECT * FROM (
        SELECT road, direction, id, lag(id) OVER w AS id_prev, lead(id) OVER w AS id_next
        FROM ({META}) WINDOW w AS (PARTITION BY road, direction ORDER BY lat, id))
    WHERE id_prev IS NOT NULL AND id_next IS NOT NULL"""


def _neighbors(spark, sf):
    return joins.neighbor_ids(meta(spark, sf), ord_col="lat")


@query("neighbor_ids", NEIGHBORS)
def neighbor_ids(spark, sf):
    return _neighbors(spark, sf)


@query("neighbor_ids_long_road", f"""
    SELECT * FROM (
        SELECT nation, id, lag(id) OVER w AS id_prev, lead(id) OVER w AS id_next
        FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END AS nation, c_custkey AS id, c_acctbal AS ord FROM customer)
        WINDOW w AS (PARTITION BY nation ORDER BY ord, id))
    WHERE id_prev IS NOT NULL AND id_next IS NOT NULL""")
def neighbor_ids_long_road(spark, sf):
    """A third of all customers on one road, which is ordered in ranges."""
    road = F.when(F.col("c_custkey") % 3 == 0, F.lit(0)).otherwise(F.col("c_nationkey"))
    places = table(spark, sf, "customer").select(
        road.cast("int").alias("nation"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("ord")
    )
    return joins.neighbor_ids(places, ["nation"], max_rows=0)


ALONG = f"""
    SELECT * FROM (
        SELECT direction, id, lag(id) OVER w AS id_prev, lead(id) OVER w AS id_next
        FROM ({META}) WHERE id IN (SELECT id FROM ({READINGS})) WINDOW w AS (PARTITION BY direction ORDER BY lat, id))
    WHERE id_prev IS NOT NULL AND id_next IS NOT NULL"""


@query("neighbor_features", rounded(f"""
    WITH d AS (SELECT id, date_trunc('day', dt) AS dt, avg(speed) AS speed, avg(volume) AS volume
               FROM ({READINGS}) GROUP BY 1, 2)
    SELECT n.id, b.dt, a.speed AS "0_speed", a.volume AS "0_volume", b.speed AS "1_speed",
           b.volume AS "1_volume", c.speed AS "2_speed", c.volume AS "2_volume"
    FROM ({ALONG}) n JOIN d b ON b.id = n.id
    JOIN d a ON a.id = n.id_prev AND a.dt = b.dt JOIN d c ON c.id = n.id_next AND c.dt = b.dt""",
    [f"{i}_{c}" for i in range(3) for c in ("speed", "volume")]))
def neighbor_features(spark, sf):
    """Neighbours among the ids that have readings, as the preparation jobs take them."""
    rows = readings(spark, sf)
    kept = joins.filter_by_common_id({"meta": meta(spark, sf), "zone": rows})
    along = joins.neighbor_ids(kept["meta"], ["direction"], ord_col="lat")
    return finish(joins.neighbor_features(quality_daily(rows), along, ["speed", "volume"], SERIES))


def quality_daily(rows):
    return resample_mean(rows, SERIES, ["speed", "volume"], "1D")


@query("align_inner", rounded(f"""
    SELECT a.id, a.dt, a.volume, b.occupancy FROM ({HOURLY}) a
    JOIN (SELECT user_id AS id, date_trunc('hour', ts) AS dt, avg(value) AS occupancy FROM events GROUP BY 1, 2) b
    ON a.id = b.id AND a.dt = b.dt""", ["volume", "occupancy"]))
def align_inner(spark, sf):
    values = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("id"), F.date_trunc("hour", "ts").alias("dt")
    ).agg(F.avg("value").alias("occupancy"))
    left = hourly(spark, sf).select("id", "dt", "volume")
    return finish(joins.align_inner(left, values, ["id", "dt"]))


@query("join_inner", rounded(f"SELECT exptid, mae, mclass, n_agg FROM ({TRIALS})", ["mae"]))
def join_inner(spark, sf):
    rows = trials(spark, sf)
    return finish(joins.join_inner(rows.select("exptid", "mae"), rows.select("exptid", "mclass", "n_agg")))


WIDE = ", ".join(f"max(CASE WHEN features = '{v}' THEN mape END) AS \"{v}\"" for v in VARIANTS)


@query("join_left_wide", rounded(f"""
    SELECT id, {WIDE} FROM ({TRIALS}) GROUP BY 1 HAVING count(*) FILTER (features = 'f') > 0""", VARIANTS))
def join_left_wide(spark, sf):
    return finish(joins.join_left_wide(trials(spark, sf), "features", VARIANTS, "mape"))


@query("missing_trials", f"""
    SELECT exptid FROM (SELECT unnest(generate_series(1, (SELECT max(user_id) * 5 + 9 FROM events))) AS exptid)
    WHERE exptid NOT IN (SELECT exptid FROM ({TRIALS}) WHERE n_agg <> 10)""")
def missing_trials(spark, sf):
    last = table(spark, sf, "events").agg(F.max("user_id")).first()[0] * 5 + 10
    return joins.missing_trials(trials(spark, sf).where("n_agg <> 10"), last)


ROADS = ["101", "5"]
AGGS = [5, 10, 15]
FEATURES = ["f", "sf", "tf", "stf"]


@query("trial_grid", """
    SELECT exptid, (['101', '5'])[(exptid % 2 + 1)::INT] AS road, ([5, 10, 15])[((exptid // 2) % 3 + 1)::INT] AS n_agg,
           (['f', 'sf', 'tf', 'stf'])[((exptid // 6) % 4 + 1)::INT] AS features
    FROM (SELECT unnest(generate_series(10, 9 + 24 * (SELECT count(*) FROM customer))) AS exptid)""")
def trial_grid_(spark, sf):
    """Every combination once for each detector, from lists that were written and read back."""
    path = shared_folder(spark, "lists")
    writers.write_trial_lists(spark, {"road": ROADS, "n_agg": AGGS, "features": FEATURES}, path)
    read = readers.read_trial_lists(spark, path)
    lists = {name: read[name] for name in ("road", "n_agg", "features")}
    detectors = table(spark, sf, "customer").count()
    made = trial_grid(spark, lists, first=10, repeats=detectors)
    return made.withColumn("n_agg", F.col("n_agg").cast("int"))


@query("union_all", rounded(f"SELECT id, dt, speed FROM ({READINGS})", ["speed"]))
def union_all(spark, sf):
    rows = readings(spark, sf).select("id", "dt", "speed", "quality")
    parts = [rows.where(F.col("quality") == kind).drop("quality") for kind in KINDS]
    return finish(joins.union_all(*parts))


# ------------------------------------------------------------------- aggregates


@query("group_count", f"SELECT mclass, features, count(*) AS n FROM ({TRIALS}) GROUP BY 1, 2")
def group_count(spark, sf):
    return quality.group_count(trials(spark, sf), ["mclass", "features"])


@query("group_filter_min", f"""
    SELECT id, road, direction FROM ({META})
    WHERE (road, direction) IN (SELECT (road, direction) FROM ({META}) GROUP BY road, direction HAVING count(*) > 4)
    """)
def group_filter_min(spark, sf):
    return quality.group_filter_min(meta(spark, sf), ["road", "direction"], 3).select("id", "road", "direction")


@query("get_group", f"SELECT exptid FROM ({TRIALS}) WHERE mclass = 'GRU' AND features = 'tf'")
def get_group(spark, sf):
    return quality.get_group(trials(spark, sf), mclass="GRU", features="tf").select("exptid")


@query("dataset_profile", f"""
    SELECT 'meta' AS table_name, count(*) AS n_rows, count(DISTINCT id) AS n_ids, NULL::TIMESTAMP AS min_dt,
           NULL::TIMESTAMP AS max_dt, 0::BIGINT AS n_dt, count(*) > count(DISTINCT id) AS has_dup_ids,
           NULL::BIGINT AS n_common FROM ({META})
    UNION ALL
    SELECT 'zone', count(*), count(DISTINCT id), min(dt), max(dt), count(DISTINCT dt),
           count(*) > count(DISTINCT id),
           (SELECT count(*) FROM (SELECT id FROM ({META}) INTERSECT SELECT id FROM ({READINGS})))
    FROM ({READINGS})""")
def dataset_profile(spark, sf):
    return finish(quality.dataset_profile({"meta": meta(spark, sf), "zone": readings(spark, sf), "lane": None}))


@query("dataset_profile_merged", f"""
    SELECT CASE WHEN m.d IS NULL THEN 'all' ELSE m.d::VARCHAR END AS part, count(*) AS n_rows, count(DISTINCT r.id) AS n_ids,
           min(r.dt) AS min_dt, max(r.dt) AS max_dt, count(DISTINCT r.dt) AS n_dt, count(*) > count(DISTINCT r.id) AS has_dup_ids,
           count(DISTINCT CASE WHEN r.id IN (SELECT id FROM ({META})) THEN r.id END) AS n_common
    FROM ({READINGS}) r JOIN (SELECT DISTINCT dt::DATE AS d, dt::DATE AS at FROM ({READINGS})
                              UNION ALL SELECT DISTINCT NULL::DATE, dt::DATE FROM ({READINGS})) m ON m.at = r.dt::DATE
    GROUP BY m.d""")
def dataset_profile_merged(spark, sf):
    """Days are profiled in two halves, stored, and merged by day and in all; sketches
    of 65 thousand values, so that counts up to that are exact."""
    rows = readings(spark, sf).withColumns({"part": F.to_date("dt").cast("string"), "late": F.hour("dt") > 11})
    stored = stage(quality.profile_sketches(rows, ["part", "late"], lg=16))
    known = stage(quality.merge_profiles(quality.profile_sketches(meta(spark, sf), lg=16), lg=16))
    days = quality.merge_profiles(stored, ["part"], lg=16)
    whole = quality.merge_profiles(stored.withColumn("part", F.lit("all")), ["part"], lg=16)
    return finish(quality.profile_counts(days.unionByName(whole), known))


KINDS = ["click", "error", "purchase", "signup", "view"]


def _by_kind(spark, sf):
    """Hourly means per event type: a few dense series to lay side by side."""
    rows = readings(spark, sf)
    cell = F.date_trunc("hour", "dt").alias("dt")
    return rows.groupBy(F.col("quality").alias("id"), cell).agg(
        F.avg("volume").alias("volume"), F.max("speed").alias("speed")
    )


BY_KIND = f"""
    SELECT quality AS id, date_trunc('hour', dt) AS dt, avg(volume) AS volume, max(speed) AS speed
    FROM ({READINGS}) GROUP BY 1, 2"""
WIDE_COLS = [f"{k}_{v}" for k in KINDS for v in ("volume", "speed")]
PIVOT = f"""
    SELECT dt, {', '.join(f"avg(CASE WHEN id = '{k}' THEN {v} END) AS {k}_{v}" for k in KINDS for v in ('volume', 'speed'))}
    FROM ({BY_KIND}) GROUP BY 1"""


def _wide(spark, sf):
    return quality.pivot_series(_by_kind(spark, sf), ["volume", "speed"], KINDS)


@query("pivot_series", rounded(PIVOT, WIDE_COLS))
def pivot_series(spark, sf):
    return finish(_wide(spark, sf))


@query("unpivot_series", rounded(f"SELECT id, dt, volume, speed FROM ({BY_KIND})", ["volume", "speed"]))
def unpivot_series(spark, sf):
    long = quality.unpivot_series(_wide(spark, sf), ["volume", "speed"], KINDS)
    return finish(long.select("id", "dt", "volume", "speed"))


COLUMN_COUNTS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_present, count({c}) / count(*) AS ratio FROM ({PIVOT})"
    for c in WIDE_COLS
)


@query("completeness_by_column", rounded(COLUMN_COUNTS, ["ratio"]))
def completeness_by_column(spark, sf):
    return finish(quality.completeness_by_column(_wide(spark, sf), WIDE_COLS))


PRESENT = " + ".join(f"({c} IS NOT NULL)::INT" for c in WIDE_COLS)


@query("completeness_by_row", f"""
    SELECT dt, ({PRESENT})::INT AS n_present, (min({PRESENT}) OVER ())::INT AS min_present,
           (max({PRESENT}) OVER ())::INT AS max_present FROM ({PIVOT})""")
def completeness_by_row(spark, sf):
    return finish(quality.completeness_by_row(_wide(spark, sf), WIDE_COLS))


@query("nullity_mask", f"SELECT dt, {', '.join(f'{c} IS NOT NULL AS {c}' for c in WIDE_COLS)} FROM ({PIVOT})")
def nullity_mask(spark, sf):
    return finish(quality.nullity_mask(_wide(spark, sf), WIDE_COLS))


SERIES_COUNTS = f"""
    SELECT id, count(speed) AS n_present,
           count(speed) / (SELECT count(DISTINCT dt) FROM ({HOURLY})) AS ratio
    FROM ({HOURLY}) GROUP BY 1"""


@query("nullity_sort_columns", rounded(f"""
    SELECT *, row_number() OVER (ORDER BY n_present, id) AS ord FROM ({SERIES_COUNTS})""", ["ratio"]))
def nullity_sort_columns(spark, sf):
    counted = quality.completeness_by_series(hourly(spark, sf), SERIES, "speed")
    return finish(quality.nullity_sort_columns(counted, "id"))


@query("nullity_sort_rows", f"SELECT dt, ({PRESENT})::INT AS n_present FROM ({PIVOT})")
def nullity_sort_rows(spark, sf):
    rows = quality.completeness_by_row(_wide(spark, sf), WIDE_COLS)
    return finish(quality.nullity_sort_rows(rows.select("dt", "n_present")))


@query("nullity_filter", rounded(f"""
    SELECT * FROM ({SERIES_COUNTS}) WHERE ratio >= 0.05 ORDER BY n_present DESC, id LIMIT 100""", ["ratio"]))
def nullity_filter(spark, sf):
    counted = quality.completeness_by_series(hourly(spark, sf), SERIES, "speed")
    return finish(quality.nullity_filter(counted, "id", "top", p=0.05, n=100))


@query("nullity_filter_bottom", rounded(f"""
    SELECT * FROM ({SERIES_COUNTS}) WHERE ratio <= 0.2 ORDER BY n_present, id LIMIT 100""", ["ratio"]))
def nullity_filter_bottom(spark, sf):
    counted = quality.completeness_by_series(hourly(spark, sf), SERIES, "speed")
    return finish(quality.nullity_filter(counted, "id", "bottom", p=0.2, n=100))


@query("nullity_filter_rows", f"""
    SELECT dt FROM (SELECT dt, ({PRESENT})::INT AS n_present FROM ({PIVOT}))
    WHERE n_present >= 6 ORDER BY n_present DESC, dt LIMIT 50""")
def nullity_filter_rows(spark, sf):
    return finish(quality.nullity_filter_rows(_wide(spark, sf), WIDE_COLS, "top", p=0.6, n=50).select("dt"))


@query("nullity_report", rounded(f"""
    WITH h AS ({HOURLY}), g AS (
        SELECT epoch_us(max(dt)) - epoch_us(min(dt)) AS span FROM h),
    s AS (SELECT min(gap) AS step FROM (
        SELECT epoch_us(dt) - epoch_us(lag(dt) OVER (ORDER BY dt)) AS gap FROM (SELECT DISTINCT dt FROM h)))
    SELECT id, var, n_present, n_present / ((SELECT span FROM g) // (SELECT step FROM s) + 1) AS ratio FROM (
        SELECT id, 'speed' AS var, count(speed) AS n_present FROM h GROUP BY 1
        UNION ALL SELECT id, 'volume', count(volume) FROM h GROUP BY 1)""", ["ratio"]))
def nullity_report_(spark, sf):
    return finish(nullity_report(hourly(spark, sf), SERIES, ["speed", "volume"]))


@query("window_shape_report", f"""
    SELECT id, 'f' AS features, count(*) AS n_rows, 4 AS n_tx, 3 AS n_vx, 2 AS n_ty, 1 AS n_vy FROM (
        SELECT id, lead(1, 5) OVER (PARTITION BY id ORDER BY dt) AS there FROM ({HOURLY}))
    WHERE there IS NOT NULL GROUP BY 1""")
def window_shape_report(spark, sf):
    made = xy_windows_nested(hourly(spark, sf), SERIES, VALUES, ["speed"], n_tx=4, n_ty=2)
    return quality.window_shape_report(made.withColumn("features", F.lit("f")), ["id", "features"])


@query("append_average_row", rounded(f"""
    SELECT id, {WIDE} FROM ({TRIALS}) GROUP BY 1
    UNION ALL SELECT 'avg', {', '.join(f'avg("{v}")' for v in VARIANTS)} FROM (SELECT id, {WIDE} FROM ({TRIALS}) GROUP BY 1)
    """, VARIANTS))
def append_average_row(spark, sf):
    wide = trials(spark, sf).groupBy("id").pivot("features", VARIANTS).agg(F.max("mape"))
    return finish(quality.append_average_row(wide, VARIANTS))


@query("metrics_pivot", rounded(f"""
    SELECT * FROM (
        SELECT id, {', '.join(f"max(CASE WHEN features = '{v}' THEN {m} END) AS {v}_{m}" for v in VARIANTS for m in ('mae', 'mape'))}
        FROM ({TRIALS}) GROUP BY 1)
    WHERE {' AND '.join(f'{v}_mae IS NOT NULL' for v in VARIANTS)}""",
    [f"{v}_{m}" for v in VARIANTS for m in ("mae", "mape")]))
def metrics_pivot(spark, sf):
    return finish(quality.metrics_pivot(trials(spark, sf), ["mae", "mape"], VARIANTS, column="features"))


LONG_METRICS = f"""
    SELECT id, features, 'mae' AS metric, mae AS v FROM ({TRIALS})
    UNION ALL SELECT id, features, 'mape', mape FROM ({TRIALS})"""


def _long_metrics(spark, sf):
    return trials(spark, sf).unpivot(["id", "features"], ["mae", "mape"], "metric", "v")


@query("mark_min_grouped", rounded(f"""
    SELECT *, v = min(v) OVER (PARTITION BY id, metric) AS is_min FROM ({LONG_METRICS})""", ["v"]))
def mark_min_grouped(spark, sf):
    return finish(quality.mark_min_grouped(_long_metrics(spark, sf), "v"))


@query("mark_min", rounded(f"""
    SELECT exptid, id, mae, mae = min(mae) OVER (PARTITION BY id) AS is_min FROM ({TRIALS})""", ["mae"]))
def mark_min(spark, sf):
    return finish(quality.mark_min(trials(spark, sf).select("exptid", "id", "mae"), "mae"))


@query("mark_max", rounded(f"""
    SELECT exptid, id, mae, mae = max(mae) OVER (PARTITION BY id) AS is_max FROM ({TRIALS})""", ["mae"]))
def mark_max(spark, sf):
    return finish(quality.mark_max(trials(spark, sf).select("exptid", "id", "mae"), "mae"))
