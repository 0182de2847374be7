"""Recoding, orders, joins, pivots, completeness, sources and sinks."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import same_rows
from tidegrid import Panel
from tidegrid.functions.scalar import (
    array_argmax, array_onehot, format_bytes, hypothesis_decision, missing_to_null, zero_to_one,
)
from tidegrid.operators import clean, joins, quality
from tidegrid.operators.ranks import in_ranges
from tidegrid.operators.trials import sample_config, trial_grid
from tidegrid.plans.nullity import nullity_report
from tidegrid.sources import generate, readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "n,style,text",
    [(23028, "short", "22.5+ KB"), (0, "short", "0.0+ bytes"), (1023, "short", "1023.0+ bytes"),
     (1024**6, "short", "1024.0+ PB"), (1024, "binary", "1.0KiB"), (5 * 1024**3, "binary", "5.0GiB"),
     (22.25 * 1024, "short", "22.2+ KB"), (-2048, "binary", "-2.0KiB")],
)
def test_format_bytes(spark, n, style, text):
    assert one(spark, format_bytes(F.lit(float(n)), style)) == text


def test_format_bytes_without_qualifier(spark):
    assert one(spark, format_bytes(F.lit(23028), "short", "")) == "22.5 KB"


def test_small_functions(spark):
    assert one(spark, array_onehot(F.lit(2), 4)) == [0, 0, 1, 0]
    assert one(spark, array_argmax(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == 1
    assert [one(spark, zero_to_one(F.lit(v))) for v in (0.0, 3.0)] == [1.0, 3.0]
    assert one(spark, missing_to_null(F.lit(float("nan")))) is None
    kept, dropped = (one(spark, hypothesis_decision(F.lit(p), "x")) for p in (0.2, 0.05))
    assert (kept.rejected, dropped.rejected) == (False, True)
    assert kept.decision.endswith("(fail to reject H0)")
    assert dropped.decision.endswith("(reject H0)")


def test_names_and_codes(spark):
    df = spark.createDataFrame([("1", "I-75", "North"), ("2", "I-4", "Up")], "zone_id string, freeway string, direction string")
    out = clean.replace_chars(clean.std_colcodes(clean.std_colnames(df)), "road")
    assert [tuple(r) for r in out.orderBy("id").collect()] == [("1", "I_75", "N"), ("2", "I_4", "Up")]
    back = clean.decode_codes(out)
    assert [r.direction for r in back.orderBy("id").collect()] == ["North", "Up"]
    with pytest.raises(ValueError):
        clean.decode_codes(out, {"direction": {"a": "X", "b": "X"}})


def test_first_datetime_col(spark):
    df = spark.range(1).select("id", F.current_date().alias("d"), F.current_timestamp().alias("t"))
    assert clean.first_datetime_col(df) == "d"
    assert clean.first_datetime_col(df.select("id")) is None


def test_label_append_uses_a_substring(spark):
    df = spark.createDataFrame([("f", ["0_volume"]), ("tf", ["speed"])], "features string, x_cols array<string>")
    assert [r.features for r in clean.label_append_if(df, "features", "x_cols").collect()] == ["f3", "tf"]


def _points(spark):
    pts = [("p1", 0.0, 1.0), ("p2", 5.0, 5.0), ("p3", 1.0, 0.5), ("p4", 9.0, 8.0), ("p5", 5.0, 5.0)]
    return spark.createDataFrame(pts, "id string, lon double, lat double")


def test_geo_order(spark):
    got = {asc: [r.id for r in clean.ordered_category_geo(_points(spark), ascending=asc).orderBy("ord").collect()]
           for asc in (True, False)}
    # The starting point is the one nearest the corner, ties go by id.
    assert got[True] == ["p1", "p3", "p2", "p5", "p4"]
    assert got[False] == ["p4", "p2", "p5", "p3", "p1"]
    left = clean.remove_unused_categories(clean.ordered_category_geo(_points(spark)).where("id <> 'p3'"))
    assert [(r.id, r.ord) for r in left.orderBy("ord").collect()] == [("p1", 1), ("p2", 2), ("p5", 3), ("p4", 4)]


def test_listed_and_typed_orders(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), ("9",)], "id string")
    listed = {r.id: r.ord for r in clean.ordered_category_list(df, "id", ["9", "10"]).collect()}
    assert listed == {"9": 1, "10": 2, "x": None}
    numbers = df.where("id <> 'x'")
    assert {r.id: r.ord for r in clean.ordered_category_typed(numbers, "id", "int").collect()} == {"9": 1, "10": 2}
    assert {r.id: r.ord for r in clean.ordered_category_typed(numbers, "id", "string").collect()} == {"10": 1, "9": 2}


def test_common_ids(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "id int")
    tables = {"meta": ids(1, 2, 3), "zone": ids(2, 2, 3, 4), "lane": ids(3, 2), "event": None}
    kept = joins.filter_by_common_id(tables)
    assert sorted(r.id for r in kept["zone"].collect()) == [2, 2, 3]
    assert kept["event"] is None
    assert joins.common_ids(None, [ids(1)]) is None
    assert joins.filter_by_common_id({"meta": ids(1), "zone": None})["meta"].isEmpty()


def test_neighbours(spark, series):
    meta = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 1)], "id string, ord int").selectExpr(
        "id", "ord", "if(id = 'd', 'r2', 'r1') AS road", "'N' AS direction")
    neighbours = joins.neighbor_ids(meta)
    assert [(r.id, r.id_prev, r.id_next) for r in neighbours.collect()] == [("b", "a", "c")]
    df = series(ids=("a", "b", "c", "d"), v=[1, None, 3]).where("NOT (id = 'c' AND minute(dt) = 2)")
    rows = joins.neighbor_features(df, neighbours, ["v"], Panel()).orderBy("dt").collect()
    assert [(r.id, r["0_v"], r["1_v"], r["2_v"]) for r in rows] == [("b", 1, 1, 1), ("b", None, None, None)]


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_neighbours_on_a_long_road(spark, ranges):
    # A third of the ids on one road, roads of one and two ids, ties, a road and an id that are null.
    rows = [(None if k % 50 == 0 else "hot" if k % 3 == 0 else f"r{k % 40}" if k % 7 else f"one {k}", None if k == 33 else k, k * 7 % 90) for k in range(400)]
    meta = spark.createDataFrame(rows, "road string, id int, ord int")
    plain = joins.neighbor_ids(meta, ["road"])
    assert plain.where("road = 'hot'").count() > 100
    same_rows(joins.neighbor_ids(meta, ["road"], max_rows=20, ranges=ranges), plain)
    same_rows(joins.neighbor_ids(meta, ["road"], ord_col="id", max_rows=20, ranges=ranges), joins.neighbor_ids(meta, ["road"], ord_col="id"))
    assert joins.neighbor_ids(meta.where("false"), ["road"], max_rows=-1, ranges=ranges).isEmpty()


def test_no_task_holds_more_than_its_share_of_a_road(spark):
    meta = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', cast(id AS string)) AS road", "id", "id * 7919 % 9000 AS ord")
    cut = in_ranges(meta, ["road", "ord", "id"], 12)
    assert cut.where("road = 'hot'").groupBy("_b").count().agg(F.max("count")).first()[0] < 1500


def test_left_wide_keeps_the_first_variants_ids(spark):
    df = spark.createDataFrame([("a", "f", 1.0), ("a", "sf", 2.0), ("b", "sf", 3.0), ("c", "f", None)], "id string, k string, v double")
    rows = joins.join_left_wide(df, "k", ["f", "sf"], "v").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, 2.0), ("c", None, None)]


def test_trials(spark):
    lists = {"road": ["1", "101"], "n_agg": [5, 10, 15], "f": ["f", "sf"]}
    grid = trial_grid(spark, lists).orderBy("exptid").collect()
    assert len({tuple(r)[1:] for r in grid}) == 12
    assert [tuple(r) for r in grid[:3]] == [(0, "1", 5, "f"), (1, "101", 5, "f"), (2, "1", 10, "f")]
    frame = trial_grid(spark, lists)
    assert sample_config(frame, 3).collect() == sample_config(frame.repartition(7), 3).collect()
    missing = joins.missing_trials(frame.where("exptid % 4 <> 1"), 12)
    assert sorted(r.exptid for r in missing.collect()) == [1, 5, 9]


def test_pivot_round_trip(series):
    df = series(ids=("a", "b"), v=[1, None, 3], w=[4, 5, None]).where("NOT (id = 'b' AND minute(dt) = 1)")
    wide = quality.pivot_series(df, ["v", "w"], ["a", "b"])
    assert wide.columns == ["dt", "a_v", "a_w", "b_v", "b_w"]
    assert wide.count() == 3
    long = quality.unpivot_series(wide, ["v", "w"], ["a", "b"])
    assert long.select("id", "dt", "v", "w").exceptAll(df.select("id", "dt", "v", "w")).isEmpty()
    assert long.count() == df.count()
    assert quality.pivot_series(df, ["v"], ["a", "b"]).columns == ["dt", "a_v", "b_v"]


def test_completeness(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, 1.0), (2, 1.0, None, None), (3, 1.0, 2.0, None), (4, None, None, None)],
        "dt int, a double, b double, c double")
    cols = ["a", "b", "c"]
    counts = quality.completeness_by_column(df, cols)
    assert {r.column: (r.n_present, r.ratio) for r in counts.collect()} == {"a": (3, 0.75), "b": (1, 0.25), "c": (1, 0.25)}
    rows = quality.completeness_by_row(df, cols).orderBy("dt").collect()
    assert [(r.n_present, r.min_present, r.max_present) for r in rows] == [(2, 0, 2), (1, 0, 2), (2, 0, 2), (0, 0, 2)]
    assert quality.nullity_select(df, cols, "top", p=0.5).columns == ["dt", "a"]
    assert quality.nullity_select(df, cols, "bottom", p=0.5).columns == ["dt", "b", "c"]
    assert quality.nullity_select(df, cols, "top", n=2, ascending=False).columns == ["dt", "a", "b"]
    assert quality.nullity_select(df, cols, ascending=True).columns == ["dt", "b", "c", "a"]
    assert sorted(r.dt for r in quality.nullity_filter_rows(df, cols, "top", p=0.5).collect()) == [1, 3]
    assert [r.column for r in quality.nullity_sort_columns(counts, "column", False).orderBy("ord").collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        quality.nullity_filter(counts, "column", "middle")


def test_nullity_report_equals_the_wide_table(series):
    df = series("5 minute", ids=("a", "b"), v=[1, None, 3, 4], w=[1, 2, None, None])
    df = df.where("NOT (id = 'b' AND minute(dt) IN (5, 10))")
    df = df.unionByName(df.where("id = 'a' AND minute(dt) = 0"))
    shares = {(r.id, r["var"]): r.ratio for r in nullity_report(df, Panel(), ["v", "w"]).collect()}
    assert shares == {("a", "v"): 0.75, ("a", "w"): 0.5, ("b", "v"): 0.5, ("b", "w"): 0.25}
    halves = nullity_report(df, Panel(), ["v"], "10min").collect()
    assert {(r.id, r.ratio) for r in halves} == {("a", 1.0), ("b", 0.5)}


def test_groups_and_marks(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 1.0), ("a", "z", 3.0), ("b", "x", None), ("b", "y", 5.0)], "id string, k string, v double")
    assert {r.id for r in quality.group_filter_min(df, ["id"]).collect()} == {"a"}
    low = {(r.id, r.k) for r in quality.mark_min(df, "v").where("is_min").collect()}
    assert low == {("a", "x"), ("a", "y"), ("b", "y")}
    high = {(r.id, r.k) for r in quality.mark_max(df, "v").where("is_max").collect()}
    assert high == {("a", "z"), ("b", "y")}
    average = quality.append_average_row(df.groupBy("id").agg(F.avg("v").alias("v")), ["v"])
    assert {r.id: r.v for r in average.collect()} == {"a": 5 / 3, "b": 5.0, "avg": 10 / 3}


def test_profile(spark, series):
    zone = series(ids=("a", "b"), v=[1, 2, 3])
    meta = spark.createDataFrame([("a",), ("c",), ("c",)], "id string")
    rows = {r.table_name: r for r in quality.dataset_profile({"meta": meta, "zone": zone, "lane": None}).collect()}
    assert (rows["meta"].n_rows, rows["meta"].has_dup_ids, rows["meta"].n_common) == (3, True, None)
    assert (rows["zone"].n_rows, rows["zone"].n_ids, rows["zone"].n_dt, rows["zone"].n_common) == (6, 2, 3, 1)


def test_profile_counts_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, None), (None, None), ("a", None), ("b", 5)], "id string, us long").select("id", F.timestamp_micros("us").alias("dt"))
    for approx in (False, True):
        rows = {r.table_name: r for r in quality.dataset_profile({"zone": df, "none": df.where("false"), "ids": df.select("id")}, approx=approx).collect()}
        assert [(rows[n].n_rows, rows[n].n_ids, rows[n].n_dt, rows[n].has_dup_ids) for n in ("zone", "none", "ids")] == [
            (4, 2, 1, True), (0, 0, 0, False), (4, 2, 0, True)]


def test_stored_profiles_merge(spark):
    rows = spark.range(60000).selectExpr("id % 30000 AS id", "timestamp_micros(id * 5 % 90000) AS dt", "cast(id % 7 AS int) AS part")
    known = quality.profile_sketches(spark.range(10000, 50000).select("id"))
    stored = quality.profile_sketches(rows.where("part < 6"), ["part"]).unionByName(quality.profile_sketches(rows.where("part = 6"), ["part"]))
    assert stored.count() == 7
    got = quality.profile_counts(quality.merge_profiles(stored), known).first()
    exact = quality.dataset_profile({"zone": rows}).first()
    assert (got.n_rows, got.min_dt, got.max_dt, got.has_dup_ids) == (exact.n_rows, exact.min_dt, exact.max_dt, True)
    assert got.n_ids == pytest.approx(exact.n_ids, rel=0.032) and got.n_dt == pytest.approx(exact.n_dt, rel=0.032)
    assert got.n_common == pytest.approx(20000, abs=0.032 * 50000)
    small = quality.profile_counts(quality.merge_profiles(stored, ["part"])).orderBy("part").collect()
    assert [r.n_ids for r in small] == [rows.where(f"part = {k}").select("id").distinct().count() for k in range(7)]
    nothing = quality.profile_counts(quality.merge_profiles(quality.profile_sketches(rows.where("false")))).first()
    assert (nothing.n_rows, nothing.n_ids, nothing.n_dt) == (0, 0, 0)


def test_dataset_round_trip(spark, tmp_path):
    (tmp_path / "meta.csv").write_text(
        "zone_id,road,direction,latitude,longitude,Unnamed: 9\nb,I-4,North,1.0,1.0,0\na,I-4,South,0.0,0.0,1\n")
    (tmp_path / "zone.csv").write_text(
        "zone_id,measurement_start,speed,volume\na,2024-01-01 00:05:00,50.5,NaN\nx,2024-01-01 00:05:00,1,2\n")
    tables = readers.load_dataset(spark, str(tmp_path), ["zone"], "csv")
    meta = [tuple(r) for r in tables["meta"].select("id", "road", "direction", "ord").orderBy("ord").collect()]
    assert meta == [("a", "I_4", "S", 1), ("b", "I_4", "N", 2)]
    assert "Unnamed: 9" not in tables["meta"].columns
    zone = {r.id: r for r in tables["zone"].collect()}
    assert (zone["a"].speed, zone["a"].volume, zone["a"].ord, zone["x"].ord) == (50.5, None, 1, None)
    assert dict(tables["zone"].dtypes)["dt"] == "timestamp"
    with pytest.raises(ValueError):
        readers.load_table(spark, "x", "feather")
    with pytest.raises(ValueError):
        readers.load_dataset(spark, str(tmp_path), ["lanes"], "csv")


def test_trial_confs_take_their_number_from_the_file(spark, tmp_path):
    for number in (7, 12):
        (tmp_path / f"{number}.json").write_text('{\n "n_tx": %d,\n "mclass": "linear"\n}' % (number * 2))
    confs = readers.read_trial_confs(spark, str(tmp_path))
    assert {(r.exptid, r.n_tx) for r in confs.collect()} == {(7, 14), (12, 24)}


def test_sinks(spark, series, tmp_path):
    df = series(ids=("a", "b"), v=[1, 2, 3]).withColumn("road", F.lit("r"))
    writers.write_series_parquet(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "road=r").is_dir()
    writers.write_series_parquet(df, str(tmp_path / "per_id"), keys=("road", "id"))
    assert (tmp_path / "per_id" / "road=r" / "id=a").is_dir()
    assert readers.read_parquet(spark, str(tmp_path / "s")).count() == 6
    for _ in range(2):
        writers.append_metrics(df.selectExpr("1L AS exptid", "id", "v AS mse"), str(tmp_path / "m"))
    assert readers.read_metrics_dir(spark, str(tmp_path / "m"), "exptid bigint, id string, mse double").count() == 12
    assert readers.read_xy_tail(spark, str(tmp_path / "s"), Panel(), n_rows=2).count() == 4
    assert readers.read_xy_tail(spark, str(tmp_path / "s"), Panel(), readers.TEST_ROWS).count() == 6


def test_generated_series(spark):
    hourly = generate.generate_series(spark, seed=1)
    row = hourly.agg(F.count("*").alias("n"), F.min("values").alias("lo"), F.max("values").alias("hi")).first()
    assert row.n == 169 and 0 <= row.lo <= row.hi <= 99
    ramp = generate.generate_ramp(spark, 400, {"col1": (1, 10), "col2": (11, 20)}).orderBy("dt").collect()
    assert (ramp[0].col1, ramp[-1].col1, ramp[0].col2, ramp[-1].col2) == pytest.approx((1, 10, 11, 20))


def test_metric_files_are_matched_by_name(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.csv").write_text("exptid,id,t_train,t_autotune,mse,mae,mape,smape\n1,a,1,2,3,4,5,6\n2,b,1,2,3,4,5,6\n")
    (tmp_path / "m" / "b.csv").write_text("id,exptid,mae,mse,note,smape,mape,t_train\nc,3,4,3,x,6,5,1\n")
    (tmp_path / "m" / "c.csv").write_text("exptid,id,t_train,t_autotune,mse,mae,mape,smape\n4,d,1,2,3,4,5,6\n")
    rows = {r.exptid: r for r in readers.read_metrics_dir(spark, str(tmp_path / "m")).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert all((r.t_train, r.mse, r.mae, r.mape, r.smape) == (1, 3, 4, 5, 6) for r in rows.values())
    assert rows[3].t_autotune is None and rows[3].id == "c" and rows[1].t_autotune == 2


def test_trial_lists_come_back(spark, tmp_path):
    lists = {"road": ["5", "101"], "n_agg": [5, 10, 15]}
    writers.write_trial_lists(spark, lists, str(tmp_path / "l"))
    assert readers.read_trial_lists(spark, str(tmp_path / "l")) == lists
    assert trial_grid(spark, lists, repeats=3).count() == 18
