"""Sliding windows: the published ramp cases and two-rate cases."""

import pytest
from pyspark.sql import functions as F

from tidegrid import Panel
from tidegrid.operators import windows as win

P = Panel().bounded()
RAMP1 = {"a": list(range(10))}
RAMP2 = {"a": list(range(10)), "b": list(range(10, 20))}

# (columns, n_tx, n_ty, h, first input, first target, number of windows)
CASES = [
    (RAMP1, 1, 1, 1, [0], [1], 9),
    (RAMP1, 1, 1, 2, [0], [2], 8),
    (RAMP2, 1, 1, 1, [0, 10], [1, 11], 9),
    (RAMP2, 2, 1, 1, [0, 10, 1, 11], [2, 12], 8),
    (RAMP2, 1, 2, 1, [0, 10], [1, 11, 2, 12], 8),
    (RAMP2, 2, 2, 1, [0, 10, 1, 11], [2, 12, 3, 13], 7),
    (RAMP2, 2, 2, 2, [0, 10, 1, 11], [3, 13, 4, 14], 6),
]


@pytest.mark.parametrize("chunk", [None, 180_000_000])
@pytest.mark.parametrize("cols,n_tx,n_ty,h,x0,y0,n", CASES)
def test_ramp(series, cols, n_tx, n_ty, h, x0, y0, n, chunk):
    df, names, panel = series(**cols), list(cols), P.chunked(chunk)
    flat = win.xy_windows_flat(df, panel, names, names, n_tx, n_ty, h).orderBy("dt").collect()
    nested = win.xy_windows_nested(df, panel, names, names, n_tx, n_ty, h).orderBy("dt").collect()
    assert len(flat) == len(nested) == n
    for i, (f, d) in enumerate(zip(flat, nested)):
        assert list(f)[2:] == [v + i for v in x0 + y0]
        assert [v for step in d.x for v in step] == [v + i for v in x0]
        assert [v for step in d.y for v in step] == [v + i for v in y0]


def test_flat_names_and_label(series):
    out = win.xy_windows_flat(series(**RAMP2), P, ["a", "b"], ["a"], 2, 2, 2)
    assert out.columns == ["id", "dt", "a_t-1", "b_t-1", "a_t-0", "b_t-0", "a_t+2", "a_t+3"]
    assert out.agg(F.date_format(F.min("dt"), "HH:mm")).first()[0] == "00:00"


def test_strided_targets_are_step_rows_apart(series):
    df = series(**RAMP1)
    flat = win.xy_windows_strided(df, P, ["a"], ["a"], n_tx=2, n_ty=2, n_ty_step=3).orderBy("dt")
    assert flat.columns[2:] == ["a_t-1", "a_t-0", "a_t+3", "a_t+6"]
    assert [list(r)[2:] for r in flat.collect()] == [[i, i + 1, i + 4, i + 7] for i in range(3)]
    nested = win.xy_windows_nested(df, P, ["a"], ["a"], n_tx=2, n_ty=2, n_ty_step=3).orderBy("dt")
    assert [r.y for r in nested.collect()] == [[[i + 4], [i + 7]] for i in range(3)]


def _dual(series):
    return series(v=list(range(12))), series("3 minute", w=[1, 4, 7, 10])


@pytest.mark.parametrize("chunk", [None, 360_000_000])
@pytest.mark.parametrize(
    "n_tx,n_ty,tail,expected",
    [
        (3, 1, "drop", [([0, 1, 2], [4]), ([3, 4, 5], [7]), ([6, 7, 8], [10])]),
        (3, 2, "drop", [([0, 1, 2], [4, 7]), ([3, 4, 5], [7, 10])]),
        (3, 2, "repeat", [([0, 1, 2], [4, 7]), ([3, 4, 5], [7, 10]), ([6, 7, 8], [10, 10])]),
        (6, 1, "drop", [(list(range(6)), [7]), (list(range(3, 9)), [10])]),
    ],
)
def test_dual_rate(series, n_tx, n_ty, tail, expected, chunk):
    x, y = _dual(series)
    panel = P.chunked(chunk)
    args = (x, y, panel, ["v"], ["w"], "1min", "3min", n_tx, n_ty, 1, tail)
    flat = [list(r)[2:] for r in win.xy_windows_dual_flat(*args).orderBy("dt").collect()]
    assert flat == [xs + ys for xs, ys in expected]
    nested = win.xy_windows_dual_nested(*args).orderBy("dt").collect()
    assert [([s[0] for s in r.x], [s[0] for s in r.y]) for r in nested] == expected


def test_dual_rejects_bad_rates(series):
    x, y = _dual(series)
    with pytest.raises(ValueError):
        win.xy_windows_dual_flat(x, y, P, ["v"], ["w"], "2min", "3min", 3)
    with pytest.raises(ValueError):
        win.xy_windows_dual_flat(x, y, P, ["v"], ["w"], "1min", "3min", 2)


def test_weekly_restarts_and_skips_short_weeks(series):
    # 2020-01-01 is a Wednesday: 5 days of the first week, 7 of the next, 2 of the last.
    df = series("1 day", v=list(range(14)))
    out = win.xy_windows_weekly(df, P, ["v"], ["v"], n_tx=1, n_ty=1, min_windows=4)
    assert [(r.week, r["v_t-0"], r["v_t+1"]) for r in out.orderBy("dt").collect()] == (
        [(1, i, i + 1) for i in range(4)] + [(2, i, i + 1) for i in range(5, 11)]
    )
    assert win.xy_windows_weekly(df, P, ["v"], ["v"]).isEmpty()


def test_one_shuffle_and_one_sort_for_all_lags(series):
    out = win.xy_windows_flat(series(v=list(range(10))), P, ["v"], ["v"], 4, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_min_windows_is_the_same_for_cut_series(spark, series):
    from tests.conftest import same_rows
    from tidegrid.operators.windows import xy_windows_dual_nested, xy_windows_flat, xy_windows_nested

    short = series(ids=("a", None), v=list(range(9)))
    rows = short.unionByName(series(ids=("b",), v=list(range(60))))
    whole, cut = Panel(("id",), "dt").bounded(), Panel(("id",), "dt").chunked(7 * 60_000_000)
    for least, kept in ((5, {"a", None, "b"}), (10, {"b"})):
        for build in (xy_windows_flat, xy_windows_nested):
            made = [build(rows, p, ["v"], ["v"], n_tx=3, n_ty=2, min_windows=least) for p in (whole, cut)]
            assert {r.id for r in made[0].select("id").distinct().collect()} == kept
            same_rows(*made)
    fine = series(ids=("a", "b"), v=list(range(60)))
    coarse = fine.where(F.minute("dt") % 3 == 0)
    made = [
        xy_windows_dual_nested(fine, coarse, p, ["v"], ["v"], 60, 180, n_tx=6, n_ty=2, min_windows=3)
        for p in (whole, cut)
    ]
    assert made[0].count() > 0
    same_rows(*made)


def test_wide_flat_windows_equal_narrow_ones(spark, series, monkeypatch):
    from tests.conftest import same_rows
    from tidegrid.operators import windows
    from tidegrid.operators.windows import xy_windows_flat

    rows = series(ids=("a", "b"), v=list(range(30)), w=list(range(30, 60)))
    args = (rows, Panel(("id",), "dt").bounded(), ["v", "w"], ["w"])
    narrow = xy_windows_flat(*args, n_tx=4, n_ty=3, h=2, n_ty_step=2)
    monkeypatch.setattr(windows, "WIDE", 5)
    wide = xy_windows_flat(*args, n_tx=4, n_ty=3, h=2, n_ty_step=2)
    assert wide.columns == narrow.columns
    same_rows(wide, narrow)
