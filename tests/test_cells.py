"""Starts, cells, calendars, panels and batches against plain loops."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.functions import calendars as cl
from loomline.operators import cells
from loomline.operators import members as mb
from loomline.operators import windows as wn
from loomline.sources import files


@pytest.mark.parametrize(("core", "more"), [(20, 36), (3, 4), (1, 1)])
def test_starts_never_overlap_and_are_those_of_loops(spark, core, more):
    rows = [("a", 1000), ("b", 777), ("c", 9), ("d", 10), ("e", 60), ("f", 200)]
    got = {}
    for r in cells.disjoint_starts(spark.createDataFrame(rows, "series_id string, n long"), 10, core, more).collect():
        got.setdefault(r.series_id, []).append(r.start)
    for name, n in rows:
        starts = sorted(got.get(name, []))
        assert all(b - a >= 10 for a, b in zip(starts, starts[1:])) and all(0 <= s <= n - 10 for s in starts)
        if n < 10:
            assert not starts
            continue
        even = [i * (n - 10) // max(core - 1, 1) for i in range(core)] if n >= core * 10 else [0]
        gaps, at = [], 0
        for s in [*even, n]:
            gaps += range(at, min(s, n) - 10 + 1, 10)
            at = s + 10
        picks = {gaps[i * (len(gaps) - 1) // max(more - 1, 1)] for i in range(more)} if gaps else set()
        assert starts == sorted([*even, *picks])


def test_cells_of_short_series_hold_out_whole_ones(spark):
    series = [("long", f"s{i}", 30) for i in range(4)] + [("long", "tiny", 5)] + [("short", f"s{i}", 9 + i % 3) for i in range(12)] + [("one", "s", 9)]
    frame = spark.createDataFrame([(*s, 5, 3) for s in series], "cell string, series_id string, n int, horizon int, windows int")
    got = cells.rolling_cells(frame, 900, 1).collect()
    assert sorted((r.series_id, r.cutoff) for r in got if r.cell == "long") == sorted((f"s{i}", c) for i in range(4) for c in (15, 20, 25))
    short = [(r.series_id, r.cutoff) for r in got if r.cell == "short"]
    assert len(short) == 2 and all(c == 9 + int(s[1:]) % 3 - 5 for s, c in short)
    assert not [r for r in got if r.cell == "one"]  # never all
    assert sum(r.cell == "long" for r in cells.rolling_cells(frame, 7, 1).collect()) == 7


def test_calendars_go_on_where_the_past_ends(spark):
    rows = [("2024-01-31 10:00:05", "month", 1), ("2024-02-29", "year", 1), ("2024-01-01 00:00", "hour", 1), ("2023-12-31 23:59:30", "minute", 15), ("2024-05-15", "quarter", 2), ("2024-01-03", "week", 1), (None, "day", 1), ("2024-01-01", "fortnight", 1)]
    frame = spark.createDataFrame(rows, "s string, u string, k int").withColumn("s", F.col("s").cast("timestamp_ntz"))
    past, future = cl.calendar(F.col("s"), F.col("u"), F.col("k"), F.lit(2), F.lit(2))
    got = [(r.p, r.f) for r in frame.select(past.alias("p"), future.alias("f")).collect()]
    assert got == [
        (["2024-01-01", "2024-02-01"], ["2024-03-01", "2024-04-01"]), (["2024-01-01", "2025-01-01"], ["2026-01-01", "2027-01-01"]), (["2024-01-01", "2024-01-01 01:00:00"], ["2024-01-01 02:00:00", "2024-01-01 03:00:00"]),
        (["2023-12-31 23:59:00", "2024-01-01 00:14:00"], ["2024-01-01 00:29:00", "2024-01-01 00:44:00"]), (["2024-04-01", "2024-10-01"], ["2025-04-01", "2025-10-01"]), (["2024-01-01", "2024-01-08"], ["2024-01-15", "2024-01-22"]),
        (None, None), (None, None),
    ]
    assert frame.limit(1).select(cl.calendar(F.col("s"), F.col("u"), F.col("k"), F.lit(0), F.lit(1))[0].alias("p")).first().p == []


def test_panel_and_requests_are_read_back(spark, tmp_path):
    rows = [("w1", "M4/H", "short", "h", "hour", datetime(2024, 1, 1), [float(i) for i in range(300)], [1.0, 2.0], "a", 2.0), ("w2", "X", "long", "ME", "month", datetime(2024, 1, 31), [None, 3.0], [1.0], "b", float("nan"))]
    frame = spark.createDataFrame(rows, "window string, name string, term string, freq string, unit string, start timestamp_ntz, values array<double>, target array<double>, block string, scale double")
    panel, posed = files.write_panel(frame, f"{tmp_path}/out", ["a"], most=200)
    p = {r.window: r for r in panel.collect()}
    assert p["w1"].cell == "m4/H/short" and p["w1"].start == "2024-01-05 04:00:00" and len(p["w1"].history) == 200 and p["w1"].scale == 2.0
    assert p["w2"].cell == "x/M/long" and p["w2"].history == [3.0] * 4 and p["w2"].start == "2024-01-01" and p["w2"].scale is None
    (r,) = posed.collect()
    assert (r.window, r.start, r.frequency, r.horizon, len(r.history), r.history[-1]) == ("w1", "2024-01-06 12:00:00", "H", 2, 168, 299.0)


def test_boards_are_read_by_directory(spark, tmp_path):
    for m, name in (("m1", "all_results.csv"), ("m2", "all-results.csv")):
        files.write_board(spark.createDataFrame([("c", 1.5)], "cell string, mase double"), f"{tmp_path}/{m}/{name}")
    got = files.boards(spark, str(tmp_path)).orderBy("model").collect()
    assert [(r.model, r.cell, r.mase) for r in got] == [("m1", "c", 1.5), ("m2", "c", 1.5)]


def test_clean_keeps_one_of_each_content(spark):
    rows = [(1, [1.0, 2.0], [3.0]), (2, [1.0, 2.0], [3.0]), (3, [1.0, 2.0], [4.0]), (4, [5.0, 5.0], [1.0]), (5, [7.0, 8.0], [1.0]), (6, None, [1.0]), (7, [1.0, None], [3.0])]
    frame = spark.createDataFrame(rows, "k int, history array<double>, future array<double>")
    got = wn.clean(frame, spark.createDataFrame([([7.0, 8.0],)], "history array<double>"), "k").collect()
    assert sorted(r.k for r in got) == [1, 3, 7]


def test_batches_are_routed_by_states_and_keep_their_order(spark):
    rows = [(3, "a", [1.0], [1.0], ["t"]), (1, "b", [-1.0], [-1.0], ["t"]), (2, "c", None, None, ["t"]), (0, "d", [1.0], [1.0], ["t"])]
    asked = spark.createDataFrame(rows, "position int, request string, text_state array<double>, full_state array<double>, stamps array<string>")
    numerical = spark.createDataFrame([("a", [5.0])], "request string, values array<double>")
    texts = spark.createDataFrame([("b", "<forecast>(t, 7)</forecast>"), ("c", "no")], "request string, text string")
    got = mb.forecast_batch(asked, numerical, texts, [[1.0], [-1.0]], [0.0, 0.0]).orderBy("position").collect()
    assert [(r.request, r.kind, r["values"], r.problem) for r in got] == [("d", 0, None, "no forecast"), ("b", 1, [7.0], None), ("c", 1, None, "no block"), ("a", 0, [5.0], None)]
    one = mb.forecast_batch(asked, numerical, texts, [[1.0], [-1.0]], [0.0, 0.0], override=1).collect()
    assert {r.kind for r in one} == {1}
