import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import calendars, series, text
from loomline.operators import batches, paths, windows
from loomline.sources import catalogue


def test_sampled_windows_stay_inside_their_series(spark):
    arrays = spark.createDataFrame([("a", [float(i) for i in range(300)]), ("short", [1.0] * 11)], "series_id string, v array<double>")
    got = windows.sampled(arrays, {"short": 8, "long": 60}, 9, 1).collect()
    assert {r.series_id for r in got} == {"a"} and 0 < len(got) <= 9
    for r in got:
        assert r.history[-1] + 1 == r.future[0] == r.cutoff and len(r.future) == r.horizon
        assert len(r.history) == min(r.cutoff, 8192, len(r.history)) and len(r.history) in {min(r.cutoff, k * r.horizon) for k in windows.LENGTHS}


def test_content_classes_and_filters(spark):
    rows = spark.createDataFrame([(3, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [5.0, 5.0]), (4, [None, 1.0]), (5, [])], "k long, v array<double>")
    assert {r.k: r["first"] for r in windows.content_classes(rows, "v", "k").collect()} == {1: 1, 3: 1, 2: 2, 4: 4, 5: 5}
    assert {r.k for r in rows.where(windows.varying(F.col("v"))).collect()} == {1, 3, 4}
    assert {r.k for r in windows.unprotected(rows, "v", rows.where("k = 1")).collect()} == {2, 4, 5}


def test_draws_that_are_too_large_are_errors(spark):
    rows = spark.createDataFrame([(i, "a" if i < 8 else "b", "x") for i in range(10)], "k long, o string, i string")
    assert windows.selection(rows, 10, 1, "k").distinct().count() == 10
    with pytest.raises(ValueError):
        windows.selection(rows, 11, 1, "k")
    with pytest.raises(ValueError):
        windows.balanced(rows, "o", "i", 11, 1, "k")
    assert [r.o for r in windows.balanced(rows, "o", "i", 5, 1, "k").orderBy("turn", "o").collect()] == ["a", "b", "a", "b", "a"]


def test_epoch_has_each_row_once_and_the_remainder_last(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, int(rng.integers(10, 100))) for i in range(101)], "k long, n long")
    got = batches.length_buckets(rows, "n", "k", 8, 4, 1).collect()
    sizes = np.bincount([r.batch for r in got])
    assert sorted(r.k for r in got) == list(range(101)) and list(sizes) == [8] * 12 + [5]
    assert batches.length_buckets(rows.limit(0), "n", "k", 8, 4, 1).count() == 0


def test_shifts_and_anchors(spark):
    rows = spark.createDataFrame([("month", 1), ("day", -1), ("week", 0), ("??", 1)], "unit string, n int").withColumn("ts", F.expr("timestamp_ntz'2024-01-31 10:20:00'"))
    got = {r.unit: str(r.t) for r in rows.select("unit", calendars.shifted("ts", "unit", "n").alias("t")).collect()}
    assert got == {"month": "2024-02-01 00:00:00", "day": "2024-01-30 00:00:00", "week": "2024-01-29 00:00:00", "??": "None"}
    s = spark.createDataFrame([("a", i) for i in range(10) if i != 7], "series_id string, pos long")
    assert sorted(r.pos for r in calendars.complete_anchors(s, 2, 3).collect()) == [2, 3, 4]


def test_predictive_gain_is_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=80)
    y = np.roll(x, 3) + 0.3 * rng.normal(size=80)
    lag, best = 0, 0.0
    for k in range(1, 21):
        t = np.arange(20, 80)
        base = np.column_stack([np.ones(60), y[t - 1]])
        full = np.column_stack([base, x[t - k]])
        rss = [((y[t] - a @ np.linalg.lstsq(a, y[t], rcond=None)[0]) ** 2).sum() for a in (base, full)]
        if (gain := 1 - rss[1] / rss[0]) > best:
            lag, best = k, gain
    frame = lambda v: spark.createDataFrame([("p", i, float(z)) for i, z in enumerate(v)], "pair string, pos long, value double")
    got = series.predictive_gain(frame(x), frame(y)).first()
    assert got.lag == lag == 3 and abs(got.gain - best) < 1e-9
    flat = series.predictive_gain(frame([1.0] * 40), frame([2.0] * 40)).first()
    assert (flat.lag, flat.gain) == (0, 0.0)


def test_polynomial_is_least_squares(spark):
    v = np.array([1.0, 4.0, 2.0, 8.0, 5.0, 7.0, 1.0])
    z, t = (v - v.mean()) / v.std(), np.linspace(-1, 1, 7)
    want = np.polyfit(t, z, 2)
    rows = [("a", i, float(x)) for i, x in enumerate(v)] + [("flat", i, 2.0) for i in range(5)] + [("one", 0, 1.0)]
    got = {r.series_id: r for r in series.polynomial(spark.createDataFrame(rows, "series_id string, pos long, value double")).collect()}
    assert abs(got["a"].curve - want[0]) < 1e-9 and abs(got["a"].quadratic_r2 - (1 - ((z - np.polyval(want, t)) ** 2).sum() / (z @ z))) < 1e-9
    assert got["flat"].curve is None and got["one"].linear_r2 is None


def test_completions(spark):
    d = spark.createDataFrame([("<forecast>(a, 9)</forecast> <FORECAST>\n(a, 1.25)\n('b', -3e2)\n(a, 2)\n</forecast>",), ("<forecast>\n(a, 1)</forecast>",), ("none",), (None,), ("<forecast>(a, 1)(b, 1e999)</forecast>",)], "text string")
    got = text.parsed(d.withColumn("stamps", F.array(F.lit("a"), F.lit("b"))), "text", "stamps").collect()
    assert [(r["values"], r.problem) for r in got] == [([2.0, -300.0], None), (None, "missing stamp"), (None, "no block"), (None, "no block"), (None, "missing stamp")]


def test_choices_lists_and_numbers(spark):
    d = spark.createDataFrame([("I say b) no.", "x [1, 2.5] y", 1.5), ("c) no", "[1] [2]", 1234567.5), (None, None, None), ("A) Yes", "none", 1e-7), ("", "", float("nan"))], "a string, q string, v double")
    got = d.select(text.choice(F.col("a"), F.array(F.lit("Yes"), F.lit("No"))).alias("c"), text.listed(F.col("q")).alias("l"), text.number(F.col("v")).alias("n")).collect()
    assert [r.c for r in got] == [1, None, None, 0, None] and [r.l for r in got] == [[1.0, 2.5], None, None, None, None]
    assert [r.n for r in got] == ["1.5", "1234568", None, "1e-07", None]


def test_draws_lie_between_the_outer_deciles(spark):
    f = spark.createDataFrame([("w", "m", s, [float(k + s) for k in range(9)]) for s in range(3)], "window string, model string, step long, q array<double>")
    got = paths.draws(f, 300, 1).collect()
    assert len(got) == 900 and all(r.step <= r.value <= r.step + 8 for r in got)
    assert abs(np.mean([r.value - r.step for r in got]) - 4) < 0.5


def test_mid_ranks(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("h", 1.0)], "g string, v double")
    assert sorted((r.g, r.place) for r in paths.mid_ranks(rows, ["g"], "v").collect()) == [("g", 0.0), ("g", 0.75), ("g", 0.75), ("h", 0.0)]


def test_value_columns_take_numbers_only(spark):
    rows = spark.createDataFrame([(1, 2.0, "x", 3)], "k long, a double, b string, c int")
    assert sorted((r.column, r.value) for r in catalogue.value_columns(rows, ["k"]).collect()) == [("a", 2.0), ("c", 3.0)]
