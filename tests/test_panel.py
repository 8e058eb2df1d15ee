"""Sources, cleaning and windows on hand-written cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from accuracast.operators import cleaning as cl
from accuracast.operators import windows as win
from accuracast.session import new_path
from accuracast.sources import readers as rd


def values(df, *keys):
    return [r.y for r in df.orderBy(*(keys or ("series_id", "pos"))).collect()]


def test_leading_zeros(make):
    p = make({"a": [0, 0, 3, 0, 1], "b": [None, 0, 3]})
    assert values(cl.leading_zeros_to_null(p)) == [None, None, 3.0, 0.0, 1.0, None, 0.0, 3.0]


def test_fill_and_cut(make):
    p = make({"a": [None, 1, None, 3, None]})
    assert values(cl.ffill_bfill(p)) == [1.0, 1.0, 1.0, 3.0, 3.0]
    assert values(cl.cut_last_non_null(p, 1)) == [None, 1.0, None, None, None]
    assert values(cl.median_fill(p)) == [2.0, 1.0, 2.0, 3.0, 2.0]


def test_duplicates_keep_last(spark):
    rows = spark.createDataFrame([("a", 1, 1, 5.0), ("a", 1, 3, 7.0), ("a", 1, 2, 6.0)], "series_id string, ts int, o int, y double")
    assert cl.dedup_keep_last(rows, "o").first().y == 7.0


def test_date_rule(spark):
    def frame(bad):
        rows = [(i, (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat() if i % 20 >= bad else "x") for i in range(100)]
        return spark.createDataFrame(rows, "o int, v string")

    assert rd.date_stats(frame(3), "v").first().is_date  # 15 % do not parse
    assert not rd.date_stats(frame(5), "v").first().is_date  # 25 % do not parse
    assert rd.date_index(frame(3), "v").count() == 85


@pytest.mark.parametrize("sep,decimal", [(",", "."), (";", ","), ("\t", "."), ("|", ".")])
def test_csv_round_trip(spark, make, sep, decimal):
    p = make({"a": [1.25, 2.5], "b": [3.75, 0]})
    path = new_path(spark, "csv")
    rd.write_wide_csv(p.select("series_id", "ts", "y"), path, sep, decimal)
    assert values(rd.read_panel_csv(spark, path), "series_id", "ts") == [1.25, 2.5, 3.75, 0.0]


def test_run_round_trip_keeps_special_values(spark):
    path = new_path(spark, "run")
    df = spark.createDataFrame([("train", float("nan")), ("val", float("inf")), ("val", -math.inf), ("val", None)], "split string, y double")
    rd.persist_run({"t": df}, path)
    got = [r.y for r in rd.load_run(spark, path, "t").collect()]
    assert sum(v is None for v in got) == 1 and sum(v is not None and math.isnan(v) for v in got) == 1 and math.inf in got and -math.inf in got


def test_irregular_index_has_no_frequency(spark):
    rows = spark.createDataFrame([("a", dt.datetime(2020, 1, d)) for d in (1, 2, 4, 8)], "series_id string, ts timestamp_ntz")
    assert cl.infer_frequency(rows).first().freq is None


def test_windows_never_leak():
    total, n, h = 345, 5, 26
    bounds = win.split_bounds(total, n, h)
    assert len(bounds) == 15 and {e - s for _, _, s, e in bounds} == {208} and min(s for _, _, s, _ in bounds) >= 0
    horizon = {k: set() for k in win.SPLITS}
    for split, _, _, end in bounds:
        horizon[split] |= set(range(end - h, end))
    assert not horizon["train"] & horizon["val"] and not horizon["val"] & horizon["test"]
    with pytest.raises(ValueError):
        win.choose_layout(60, 5, 26)


def test_short_series_give_no_windows(make):
    assert win.split_windows(make({"a": range(5)}), 3, 12).count() == 0
    assert win.meta_windows(make({"a": range(30)}), 3, 12).count() == 0


def test_meta_windows_lengths(make):
    w = win.meta_windows(make({"a": range(100)}), 4, 12)
    sizes = w.groupBy("window_id").agg(F.sum((F.col("part") == "past").cast("int")).alias("p"), F.sum((F.col("part") == "horizon").cast("int")).alias("h")).collect()
    assert len(sizes) == 4 and all(r.p >= 24 and r.h == 12 for r in sizes)


def test_overlapping_windows_match_brute_force(make):
    y = [float(i * i % 17) for i in range(40)]
    w = win.split_windows(make({"a": y}), 3, 5)
    length = max(6, min(40, 5 + round(0.8 * 40)))
    for i in range(3):
        assert values(w.where(f"window_id = {i + 1}"), "pos") == y[i : i + length]


def _csv(spark, name, lines):
    path = new_path(spark, name)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return path


def test_csv_is_judged_by_all_its_lines(spark):
    day = lambda i: (dt.date(2020, 1, 1) + dt.timedelta(days=i)).isoformat()
    path = _csv(spark, "late", ["Date;a;b"] + [f"{day(i)};{i};{i + 1}" if i < 60 else f"{day(i)};{i},5;{i},25" for i in range(100)])
    rows = rd.read_panel_csv(spark, path).collect()
    assert len(rows) == 200 and all(r.y is not None for r in rows)
    assert {r.y for r in rows if r.ts.date() == dt.date(2020, 3, 11)} == {70.5, 70.25}


def test_csv_with_numbers_or_names_as_index(spark):
    path = _csv(spark, "numbers", ['"t","a, mean","b"'] + [f'{i},"{i}.5",' for i in range(30)] + ['29,"7.0",'])
    rows = rd.read_panel_csv(spark, path).collect()
    assert {r.series_id for r in rows} == {"a, mean"} and len(rows) == 30  # b is empty
    assert {r.ts: r.y for r in rows}[29.0] == 7.0  # the last of equal index values stays
    names = rd.read_panel_csv(spark, _csv(spark, "names", ["m|a|b", "M1|1|2", "M2|3|4"])).collect()
    assert sorted((r.series_id, r.ts, r.y) for r in names) == [("a", "M1", 1.0), ("a", "M2", 3.0), ("b", "M1", 2.0), ("b", "M2", 4.0)]


def test_csv_with_quoted_decimal_commas(spark):
    path = _csv(spark, "quoted", ["Date,a,b"] + [f'2020-01-{i:02d},"{i},5","{i},25"' for i in range(1, 21)])
    rows = rd.read_panel_csv(spark, path).collect()
    assert len(rows) == 40 and {r.y for r in rows if r.ts.day == 7} == {7.5, 7.25}


def test_csv_with_ragged_lines(spark):
    lines = ["Date;a;b"] + [f"2020-01-{i:02d};{i},5;{i}" for i in range(1, 21)]
    lines[4], lines[9] = "2020-01-04;4,5", "2020-01-09;9,5;9;left over"
    rows = rd.read_panel_csv(spark, _csv(spark, "ragged", lines)).collect()
    assert sum(r.series_id == "a" and r.y is not None for r in rows) == 20
    assert sum(r.series_id == "b" and r.y is not None for r in rows) == 19


def test_csv_without_numbers_is_refused(spark):
    with pytest.raises(ValueError, match="numbers"):
        rd.read_panel_csv(spark, _csv(spark, "words", ["t,a", "x,y", "z,w"]))
    with pytest.raises(ValueError, match="separator"):
        rd.read_panel_csv(spark, _csv(spark, "one", ["t", "x", "z"]))


@pytest.mark.parametrize(
    "dates,want",
    [
        (["01.02.2020", "02.02.2020", "13.02.2020", "14.02.2020", "15.2.2020"], dt.date(2020, 2, 1)),
        (["1/2/2020", "1/13/2020", "1/14/2020", "1/15/2020", "1/16/2020"], dt.date(2020, 1, 2)),
        (["1/2/2020", "13/2/2020", "14/2/2020", "15/2/2020", "16/2/2020 12:30"], dt.date(2020, 2, 1)),
        (["2020-02-01", "2020-02-02", "2020-02-03", "2020-02-04", "2020-02-05"], dt.date(2020, 2, 1)),
    ],
)
def test_csv_dates_are_read_by_one_pattern(spark, dates, want):
    rows = rd.read_panel_csv(spark, _csv(spark, "dates", ["Date;a"] + [f"{d};{i}" for i, d in enumerate(dates)])).collect()
    assert len(rows) == 5 and {r.y: r.ts.date() for r in rows}[0.0] == want


@pytest.mark.parametrize("total,n,h,want", [(345, 5, 26, (208, 7)), (300, 5, 26, (208, 3)), (250, 5, 26, (156, 3)), (345, 1, 26, (208, 1)), (120, 2, 10, (68, 10))])
def test_window_layout(total, n, h, want):
    assert win.choose_layout(total, n, h) == want
