"""Projection, recoding, filters, orderings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalog.registry import finish, query, rounded
from tidegrid.catalog.source_queries import GEO_SQL
from tidegrid.catalog.tables import (
    META, READINGS, SERIES, TRIALS, hourly, HOURLY, meta, readings, table, trials,
)
from tidegrid.functions.freq import freq_to_interval
from tidegrid.functions.scalar import (
    array_argmax, array_onehot, format_bytes, next_weekday, zero_to_one,
)
from tidegrid.operators import clean
from tidegrid.operators.ranks import group_head


@query("std_colnames", "SELECT user_id AS id, ts AS dt, value FROM events")
def std_colnames(spark, sf):
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("zone_id"), F.col("ts").alias("measurement_start"), "value"
    )
    return finish(clean.std_colnames(raw))


@query("std_colcodes", f"SELECT id, road, left(direction, 1) AS direction FROM ({META})")
def std_colcodes(spark, sf):
    return clean.std_colcodes(meta(spark, sf)).select("id", "road", "direction")


@query("decode_codes", f"SELECT id, direction FROM ({META})")
def decode_codes(spark, sf):
    return clean.decode_codes(clean.std_colcodes(meta(spark, sf))).select("id", "direction")


@query("replace_chars", f"SELECT id, replace(road, '-', '_') AS road FROM ({META})")
def replace_chars(spark, sf):
    return clean.replace_chars(meta(spark, sf), "road").select("id", "road")


@query("select_ids_cols", f"""
    SELECT dt, id, volume FROM ({READINGS}) WHERE id IN (SELECT id FROM ({META}) WHERE direction = 'North')""")
def select_ids_cols(spark, sf):
    ids = meta(spark, sf).where("direction = 'North'")
    return finish(clean.select_ids_cols(readings(spark, sf), ids, ["dt", "id", "volume"]))


@query("filter_months", "SELECT o_orderkey, o_orderdate FROM orders WHERE month(o_orderdate) IN (3, 7)")
def filter_months(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return finish(clean.filter_months(orders, [3, 7], "o_orderdate"))


@query("distinct_months", "SELECT DISTINCT month(o_orderdate)::INT AS month FROM orders")
def distinct_months(spark, sf):
    return clean.distinct_months(table(spark, sf, "orders"), "o_orderdate")


@query("filter_weekdays", "SELECT event_id, ts FROM events WHERE isodow(ts) BETWEEN 1 AND 5")
def filter_weekdays(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return finish(clean.filter_weekdays(e, [0, 1, 2, 3, 4], "ts"))


@query("trim_partial_weeks", f"""
    SELECT id, dt, volume FROM (
        SELECT *, min(dt) OVER w AS lo, max(dt) OVER w AS hi FROM ({READINGS})
        WINDOW w AS (PARTITION BY id, year(dt), month(dt)))
    WHERE dt >= lo + to_days(((8 - isodow(lo)) % 7)::INT) AND dt <= hi - to_days((isodow(hi) % 7)::INT)""")
def trim_partial_weeks(spark, sf):
    rows = readings(spark, sf).select("id", "dt", "volume")
    return finish(clean.trim_partial_weeks(rows, SERIES))


@query("next_weekday", """
    SELECT o_orderkey, o_orderdate + to_days(((8 - isodow(o_orderdate)) % 7)::INT) AS next_monday,
           o_orderdate - to_days((isodow(o_orderdate) % 7)::INT) AS last_sunday FROM orders""")
def next_weekday_(spark, sf):
    orders = table(spark, sf, "orders")
    return finish(orders.select(
        "o_orderkey",
        next_weekday(F.col("o_orderdate"), 0).alias("next_monday"),
        next_weekday(F.col("o_orderdate"), 6, forward=False).alias("last_sunday"),
    ))


@query("first_datetime_col", "SELECT o_orderkey, o_orderdate AS dt FROM orders")
def first_datetime_col(spark, sf):
    orders = table(spark, sf, "orders")
    return finish(orders.select("o_orderkey", F.col(clean.first_datetime_col(orders)).alias("dt")))


@query("filter_expr", f"SELECT exptid FROM ({TRIALS}) WHERE n_agg = 5 AND mclass = 'GRU' AND mae > 20")
def filter_expr(spark, sf):
    return clean.filter_expr(trials(spark, sf), "n_agg = 5 AND mclass = 'GRU' AND mae > 20").select("exptid")


@query("label_append_if", f"""
    SELECT exptid, CASE WHEN exptid % 3 = 0 THEN features || '3' ELSE features END AS features FROM ({TRIALS})""")
def label_append_if(spark, sf):
    names = F.when(F.col("exptid") % 3 == 0, F.array(F.lit("0_speed"), F.lit("0_volume"))).otherwise(
        F.array(F.lit("speed"), F.lit("dow"))
    )
    labelled = clean.label_append_if(trials(spark, sf).withColumn("x_cols", names), "features", "x_cols")
    return labelled.select("exptid", "features")


@query("dropna_rows", f"SELECT id, dt, speed, volume FROM ({READINGS}) WHERE speed IS NOT NULL")
def dropna_rows(spark, sf):
    return finish(clean.dropna_rows(readings(spark, sf).select("id", "dt", "speed", "volume")))


@query("rename_columns", rounded(f"SELECT exptid AS trial, mae AS error FROM ({TRIALS})", ["error"]))
def rename_columns(spark, sf):
    picked = trials(spark, sf).select("exptid", "mae")
    return finish(clean.rename_columns(picked, {"exptid": "trial", "mae": "error"}))


@query("ordered_category_list", """
    SELECT event_id, event_type, list_position(['view', 'click', 'purchase'], event_type)::INT AS ord FROM events""")
def ordered_category_list(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    return clean.ordered_category_list(e, "event_type", ["view", "click", "purchase"])


@query("ordered_category_typed", f"""
    SELECT id, row_number() OVER (ORDER BY id::INT DESC) AS ord FROM (SELECT DISTINCT id FROM ({TRIALS}))""")
def ordered_category_typed(spark, sf):
    return clean.ordered_category_typed(trials(spark, sf), "id", "int", ascending=False)


@query("ordered_category_geo", f"SELECT id, ord FROM ({GEO_SQL.format(source=META)})")
def ordered_category_geo(spark, sf):
    return clean.ordered_category_geo(meta(spark, sf)).select("id", "ord")


@query("remove_unused_categories", f"""
    SELECT id, dense_rank() OVER (ORDER BY ord) AS ord
    FROM ({GEO_SQL.format(source=META)}) WHERE direction = 'West'""")
def remove_unused_categories(spark, sf):
    west = clean.ordered_category_geo(meta(spark, sf)).where("direction = 'West'")
    return clean.remove_unused_categories(west).select("id", "ord")


_SIZE = "(l_orderkey * l_partkey * l_suppkey)"


def _sql_bytes(units, qualifier, gap):
    cases = " ".join(
        f"WHEN n < {1024.0 ** (i + 1):.0f} THEN printf('%.1f{qualifier}{gap}{u}', n / {1024 ** i}::DOUBLE)"
        for i, u in enumerate(units)
    )
    return f"CASE {cases} END"


@query("format_bytes", f"""
    SELECT l_orderkey, l_linenumber, {_sql_bytes(["bytes", "KB", "MB", "GB", "TB"], "+", " ")} AS short,
           {_sql_bytes(["B", "KiB", "MiB", "GiB", "TiB"], "", "")} AS "binary"
    FROM (SELECT l_orderkey, l_linenumber, {_SIZE}::DOUBLE AS n FROM lineitem)""")
def format_bytes_(spark, sf):
    size = F.expr(_SIZE)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        format_bytes(size).alias("short"),
        format_bytes(size, "binary").alias("binary"),
    )


@query("freq_to_interval", """
    SELECT event_id, ts + INTERVAL 30 MINUTE AS later, ts + to_seconds(event_id % 600) AS shifted FROM events""")
def freq_to_interval_(spark, sf):
    e = table(spark, sf, "events")
    return finish(e.select(
        "event_id",
        (F.col("ts") + freq_to_interval("30T")).alias("later"),
        (F.col("ts") + freq_to_interval(F.col("event_id") % 600)).alias("shifted"),
    ))


@query("zero_to_one", "SELECT event_id, CASE WHEN k = 0 THEN 1.0 ELSE k END AS k FROM (SELECT event_id, (event_id % 4)::DOUBLE AS k FROM events)")
def zero_to_one_(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", zero_to_one((F.col("event_id") % 4).cast("double")).alias("k"))


@query("array_onehot", "SELECT vec_id, pos - 1 AS pos, CASE WHEN label = pos - 1 THEN 1 ELSE 0 END AS hot FROM (SELECT vec_id, label, unnest(generate_series(1, 10))::INT AS pos FROM embeddings)")
def array_onehot_(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(array_onehot(F.col("label"), 10)).alias("pos", "hot"))


@query("array_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS arg FROM embeddings")
def array_argmax_(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", array_argmax(F.col("embedding")).alias("arg"))


@query("group_head", """
    SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3""".replace("SELECT * FROM", "SELECT o_custkey, o_orderkey FROM"))
def group_head_(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return group_head(orders, ["o_custkey"], ["o_orderkey"], 3)


@query("sort_by", rounded(f"SELECT id, dt, volume FROM ({HOURLY})", ["volume"]))
def sort_by(spark, sf):
    return finish(hourly(spark, sf).select("id", "dt", "volume")).orderBy("id", "dt")


@query("limit_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def limit_head(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("distinct", "SELECT DISTINCT event_type, user_id FROM events")
def distinct(spark, sf):
    return table(spark, sf, "events").select("event_type", "user_id").distinct()


@query("intersect", "SELECT c_custkey AS id FROM customer INTERSECT SELECT user_id FROM events")
def intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).intersect(
        table(spark, sf, "events").select(F.col("user_id").alias("id"))
    )


