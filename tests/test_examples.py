"""Examples and measurement texts against plain loops; writers that refuse what is not finite."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions import evidence as ev
from loomline.functions.series import filled
from loomline.operators import examples as ex
from loomline.operators import scoring
from loomline.sources import files


def told(x):
    return f"{x:.4g}" if abs(x) >= 1e4 or 0 < abs(x) < 1e-4 else (f"{x:.5f}".rstrip("0").rstrip(".") or "0")


def corr(a, b):
    return 0.0 if len(a) < 3 or a.std() < 1e-12 or b.std() < 1e-12 else float(np.corrcoef(a, b)[0, 1])


def line(v, name):
    """The first line of a series' measurements."""
    t = np.arange(len(v))
    d = np.diff(v)
    q = np.quantile(v, [0.1, 0.5, 0.9])
    acf = ",".join(f"{k}:{told(corr(v[:-k], v[k:]))}" for k in (1, 2, 4, 8, 16, 32) if len(v) > k)
    power = np.abs(np.fft.rfft(v - np.polyval(np.polyfit(t, v, 1), t)))[1:] ** 2
    k = int(power.argmax())
    z = np.abs(v - q[1]) / (1.4826 * np.median(np.abs(v - q[1])))
    at = int(z.argmax())
    first = dict(mean=v.mean(), sd=v.std(), min=v.min(), q10=q[0], median=q[1], q90=q[2], max=v.max(), slope=np.polyfit(t, v, 1)[0], diff_sd=d.std(), diff_acf1=corr(d[:-1], d[1:]))
    last = dict(fft_period=len(v) / (k + 1), fft_power_fraction=power[k] / power.sum(), largest_robust_z=z[at], at_fraction=at / (len(v) - 1))
    text = lambda m: " ".join(f"{k}={told(float(x))}" for k, x in m.items())
    return f"{name}: n={len(v)} {text(first)} raw_acf[{acf}] {text(last)}"


def long(spark, **series):
    rows = [(i, p, t, float(x)) for key, v in series.items() for i, p in [key.split("_")] for t, x in enumerate(v)]
    return spark.createDataFrame(rows, "id string, place string, pos long, value double")


def test_messages_hold_the_measurements_of_one_and_two_series(spark):
    rng = np.random.default_rng(7)
    a, b = np.cumsum(rng.normal(size=60)) * 3, rng.normal(size=50) * 9 + 100
    s = long(spark, one_a=a, two_a=a, two_b=b, bad_a=[1.0] * 7, three_a=a, three_b=b, three_c=a)
    q = spark.createDataFrame([("one", "Why?", None), ("two", "Which?", ["this", "that"]), ("bad", "x", None), ("three", "x", None), ("none", "x", None)], "id string, question string, options array<string>")
    got = {r.id: r for r in ex.analysis_messages(q, s).collect()}
    assert {k: r.problem for k, r in got.items()} == {"one": None, "two": None, "bad": "invalid series", "three": "more than two series", "none": "no series"}
    assert line(a, "S1") in got["one"].message.split("\n") and "Pair:" not in got["one"].message
    lines = got["two"].message.split("\n")
    assert line(a, "S1") in lines and line(b, "S2") in lines
    n, design = len(b), np.column_stack([np.ones(len(b)), a[: len(b)]])
    r2 = 1 - ((b - design @ np.linalg.lstsq(design, b, rcond=None)[0]) ** 2).sum() / ((b - b.mean()) ** 2).sum()
    (pair,) = [x for x in lines if x.startswith("Pair: ")]
    assert f"corr0={told(corr(a[:n], b))};" in pair and f"affine_S1_to_S2_R2={told(r2)};" in pair
    fit = lambda v, k: 1 - (lambda r: (r**2).sum())(v - np.polyval(np.polyfit(np.linspace(-1, 1, len(v)), v, k), np.linspace(-1, 1, len(v)))) / ((v - v.mean()) ** 2).sum()
    for name, v in (("S1", a), ("S2", b)):
        (trend,) = [x for x in lines if x.startswith(f"{name}_trend_fits: ")]
        assert f"linear_R2={fit(v, 1):.5g} quadratic_R2={fit(v, 2):.5g} " in trend
        assert sum(x.startswith(f"{name}_first_half: n={(len(v) + 1) // 2} ") for x in lines) == 1
    assert lines[-1] == ex.rq.CHOICE_OUTPUT and "A) this" in lines


def convert(spark, *rows):
    frame = spark.createDataFrame([(i, k, r if isinstance(r, str) or r is None else json.dumps(r)) for i, (k, r) in enumerate(rows)], "key long, kind string, raw string")
    return [r for r in ex.converted(frame).orderBy(F.substring_index("row_id", ":", -1).cast("int")).collect()]


def test_every_raw_row_renders_or_tells_why(spark):
    v = [float(x) for x in range(1, 13)]
    qa = lambda q, a: {"QA_list": f'"question": {json.dumps(q)}, "answer": {json.dumps(a)}'}
    four = "A: up\nB: down\nC: flat\nD: other"
    rows = [
        ("listed", qa(f"See {v} now", "yes")), ("listed", qa("no list", "yes")), ("listed", qa(f"{v} and {v}", "yes")), ("listed", "{broken"), ("listed", None),
        ("lettered", {"Series": str(v), "Question": "Q\n(a) an increasing line\n(b) Increased line\n(c) flat", "Answer": "(c)"}), ("lettered", {"Series": str(v), "Question": "Q\n(a) an increasing line\n(b) Increased line\n(c) flat", "Answer": "(a)"}),
        ("described", {"timeseries": [v], "prompt_1": "P", "answer_1": "A"}), ("described", {"timeseries": json.dumps([v]), "prompt_1": "P", "answer_1": "A"}), ("described", {"timeseries": [v, v], "prompt_1": "P", "answer_1": "A"}),
        ("pattern", {"timeseries": [v], "prompt_1": "P", "option": "\n\nOptions:\n" + four, "answer_1": "Thus the correct answer is b."}), ("pattern", {"timeseries": [v], "prompt_1": "P", "option": "\n\nOptions:\n" + four, "answer_1": "The correct answer is B. The correct answer is C."}),
        ("pattern", {"timeseries": [v], "option": "Options: A. up\nor so\nB. down\nC. flat\nD. other", "truth": "A"}), ("pattern", {"timeseries": [v], "option": "A. up\nB. Up\nC. flat\nD. other", "truth": "A"}),
        ("templated", {"timeseries": [v], "input": ex.PREFIX + "Mean?", "output": "np.float64(6.5)"}), ("templated", {"timeseries": [v[:3]], "input": "Mean?", "output": "2"}), ("other", {"x": 1}),
    ]
    got = convert(spark, *rows)
    problems = [None, "no single series", "no single series", "no single series", "no single series", None, "no single answer", None, None, "no single series", None, "no single answer", None, "ambiguous options", None, "invalid series", "unknown kind"]
    assert [r.problem for r in got] == problems
    assert all((r.message is None) == (r.target is None) == (r.problem is not None) for r in got)
    assert [r.target for r in got if r.target] == ["yes", "C) flat", "A", "A", "B) down", "A) up\nor so", "6.5"]
    assert all("Time series values (successive observations separated by spaces):\n1 2 3" in r.message for r in got if r.message)
    assert got[0].question == f"See {ex.PHRASE} now" and got[14].question == "Mean?"


def test_sensor_readings_have_a_channel_for_each_axis(spark):
    rng = np.random.default_rng(8)
    v = [round(float(x), 3) for x in rng.normal(size=30)]
    ask = lambda text, v: {"task": "classification", "QA_list": f'"question": {json.dumps(f"{text} {v} ?")}, "answer": "walk"'}
    got = convert(spark, ("listed", ask(f"data with {ex.qs.ACTIVITY}", v)), ("listed", ask(f"of {ex.qs.SENSORS}", v[:9])), ("listed", ask("data", v)))
    text = got[0].evidence
    for i, axis in enumerate("XYZ"):
        assert f"{axis} channel:\n{line(np.array(v[i::3]), 'S1')}\n" in text and f"\n{axis}_trend_fits: " in text and f"\n{axis}_second_half: n=5 " in text
    assert text.count("Trend fits: ") == 1 and f"0 | {v[0]:.4g} | {v[1]:.4g} | {v[2]:.4g}" in text
    assert got[1].evidence.endswith(f"Hip | {v[6]:.4g} | {v[7]:.4g} | {v[8]:.4g}") and got[2].problem == "unrecognized sensor layout"


def test_forecast_examples_keep_their_limits(spark):
    rows = [(1, [1.0] * 200, [f"s{i}" for i in range(200)], [float(i) for i in range(70)], [f"t{i}" for i in range(70)], ""), (2, [1.0], ["s"], [float("nan")], ["t"], ""), (3, [1.0], ["s"], [1.0, 2.0], ["t"], "c")]
    frame = spark.createDataFrame(rows, "k int, history array<double>, past array<string>, future array<double>, stamps array<string>, context string")
    got = {r.k: r for r in ex.forecast_example(frame).collect()}
    assert got[1].problem is None and got[1].message.count("(s") == 168 and got[1].target.count("(t") == 64 and got[1].target.startswith("<forecast>\n(t0, 0)\n")
    assert (got[2].problem, got[2].message, got[2].target) == ("no target", None, None) and got[3].target is None
    kept = {r.k: r for r in ex.bounded_example(ex.forecast_example(frame), F.lit("2"), F.lit(None)).collect()}
    assert kept[1].target.startswith("<forecast>\n(t0, 2)\n(t1, 2)\n(t2, 2)\n(t3, 3)\n") and "a minimum of 2." in kept[1].message and kept[2].message is None


def test_reports_meet_whole_surroundings_only(spark):
    from datetime import datetime, timedelta

    noon = datetime(2024, 3, 1, 12, 20)
    reports = [("A", noon, "near"), ("A", noon - timedelta(hours=5), "early"), ("A", noon + timedelta(minutes=40), None), ("B", noon, "lonely"), ("A", None, "x")]
    obs = [("A", datetime(2024, 3, 1, 9) + timedelta(hours=i, minutes=m), float(i + m / 100)) for i in range(10) for m in (-20, 10)] + [("A", datetime(2024, 3, 1, 12), 999.0), ("B", noon, 1.0)]
    r, o = spark.createDataFrame(reports, "office string, issued timestamp_ntz, text string"), spark.createDataFrame(obs, "office string, ts timestamp_ntz, value double")
    got = ex.reported(r, o, hours=3).collect()
    assert [(g.office, g.text, g.history, g.future) for g in got] == [("A", "near", [1.1, 2.1, 3.1], [4.1, 5.1, 6.1])]
    assert got[0].past == [f"2024-03-01T{h}:00:00+00:00" for h in (10, 11, 12)] and got[0].stamps[0] == "2024-03-01T13:00:00+00:00"
    assert ex.reported(r, o, hours=24).count() == 0


def test_json_lines_refuse_what_is_not_finite(spark, tmp_path):
    path = f"{tmp_path}/x.jsonl"
    fine = spark.createDataFrame([(1, 1.5, [1.0, None], (2.0,)), (2, None, None, None)], "k int, `a.b` double, v array<double>, s struct<y:double>")
    assert files.write_json_lines(fine, path) == 2
    before = sorted(map(str, files.read_any(spark, path).collect()))
    for bad in ([(1, float("nan"), None, None)], [(1, 1.0, [1.0, float("inf")], None)], [(1, 1.0, None, (float("-inf"),))]):
        with pytest.raises(Exception, match="not finite"):
            files.write_json_lines(spark.createDataFrame(bad, fine.schema), path)
        assert sorted(map(str, files.read_any(spark, path).collect())) == before
    assert files.write_json_lines(fine.limit(1), path) == 1 and files.write_json_lines(fine.where("k > 5"), path) == 0
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.jsonl"]


def test_filling_is_interpolation_in_place(spark):
    rng = np.random.default_rng(9)
    rows = [[None, 1.0, None, float("nan"), 4.0, None], [2.0], [None, None], [], [1.0, 2.0]] + [[float(x) if rng.random() < 0.3 else None for x in rng.normal(size=200)] for _ in range(5)]
    got = [r.f for r in spark.createDataFrame(list(enumerate(rows)), "i int, v array<double>").select("i", filled(F.col("v")).alias("f")).orderBy("i").collect()]
    for v, f in zip(rows, got, strict=True):
        x = np.array([np.nan if y is None else y for y in v], float)
        ok = np.isfinite(x)
        assert f is None if len(x) and not ok.any() else np.allclose(f, np.interp(np.arange(len(x)), np.flatnonzero(ok), x[ok]) if len(x) else [])


def test_a_board_without_a_complete_model_is_an_error(spark):
    board = spark.createDataFrame([("m", "a", 1.0), ("n", "b", 1.0)], "model string, cell string, mase double")
    with pytest.raises(ValueError, match="every cell"):
        scoring.complete_peers(board)
    assert scoring.complete_peers(board.limit(0)).count() == 0


def test_sources_are_measured_where_they_are(spark):
    rng = np.random.default_rng(10)
    v = [rng.normal(size=n).round(3).tolist() for n in (9, 30, 9, 7)] + [[2.0] * 8, [1.0] * 7 + [float("nan")], [1.0] * 7 + [None]]
    rows = spark.createDataFrame([(i // 2, x, "q", "series") for i, x in enumerate(v)] + [(9, v[1], "q", None)], "key long, values array<double>, question string, shape string")
    told = ev.source_evidence(rows)
    plan = told._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "InPandas" not in plan
    got = [r.evidence for r in told.collect()]
    assert [x is None for x in got] == [False, False, False, True, False, True, True, True]
    for x, e in zip(v[:3], got, strict=False):
        assert line(np.array(x), "S1") in e.split("\n")
    assert "S1_trend_fits: unavailable (constant series)" in got[4] and got[4].count("unavailable (constant or insufficient signal)") == 2
    assert ev.sr.dominant_period(spark.createDataFrame([("a", 1, 1.0)], "series_id string, pos int, value double"))._jdf.queryExecution().toString().count("FlatMapGroupsInPandas") == 0
