"""The ensemble against plain loops: features, pools, blends, the training table, cross-fitted routers, the chain."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.functions.arrow import arrays, by_row, lists
from loomline.operators import ensemble as en
from loomline.operators import features as ft

MODELS = ["a", "b", "c"]
GATES = [("H|short", 0, 0.0, [0.0, 0.1]), ("H|short", 1, 0.5, [0.2, 0.0])]


def forecast(rng, horizon, level=0.0):
    return np.sort(level + rng.normal(size=(horizon, 9)), 1)


def long(windows):
    return [(w, m, t + 1, [float(x) for x in q[t]]) for w, f in windows.items() for m, q in f.items() for t in range(len(q))]


def frames(spark, windows, forecasts):
    w = spark.createDataFrame(windows, "window string, source_group string, block string, history array<double>, future array<double>, horizon int, freq string, term string, gate_features array<double>")
    return w, spark.createDataFrame(long(forecasts), "window string, model string, step int, q array<double>")


def case(spark, n=24, horizon=10, lost=()):
    rng = np.random.default_rng(5)
    windows, forecasts = [], {}
    for i in range(n):
        level = float(rng.normal() * 30)
        history = (level + rng.normal(size=60)).tolist()
        future = (level + rng.normal(size=horizon)).tolist()
        windows.append((f"w{i}", f"g{i % 9}", "cells", history, future, horizon, "D" if i % 5 == 4 else "h", "short", [1.0, float(i % 3)]))
        # the second forecaster is near the future, the others are too high
        forecasts[f"w{i}"] = {m: forecast(rng, horizon, level + bias) for m, bias in zip("abcd", (4.0, 0.1, 6.0, 1.0), strict=True) if (i, m) not in lost}
    return windows, forecasts, *frames(spark, windows, forecasts)


def plain_features(history, q, m, kind, term):
    """The 19 + 22 values of a window, one at a time."""
    v = [x for x in history[-512:] if math.isfinite(x)]
    mag = max(max(abs(x) for x in v), 1.0)
    s = [x / mag for x in v]
    loc = statistics.median(s)
    c = [x - loc for x in s]
    mean = lambda x: sum(x) / len(x) if len(x) else 0.0
    sd = lambda x: math.sqrt(mean([(y - mean(x)) ** 2 for y in x]))
    diff = lambda x: [b - a for a, b in zip(x, x[1:])]
    step = lambda x: mean([abs(d) for d in diff(x)])

    def slope(x):
        if len(x) < 2:
            return 0.0
        t = [i - (len(x) - 1) / 2 for i in range(len(x))]
        return sum(a * (b - mean(x)) for a, b in zip(t, x)) / sum(a * a for a in t)

    sc = max(1.4826 * statistics.median([abs(x) for x in c]), step(s), sd(c), 1e-4 * abs(loc), 1e-6)
    clip = lambda x, k: max(-k, min(k, x))
    z = [clip(x / sc, 50) for x in c]
    qs = [[[clip((x / mag - loc) / sc, 100) for x in t] for t in f] for f in q]
    h = len(q[0])
    out = [math.log1p(len(v)), math.log1p(h), math.log((len(v) + 1) / (h + 1)), math.log1p(mag), loc, sc, math.log1p(m), h / m]
    out += [float(kind == k) for k in ft.FAMILIES] + [float(term.lower() == t) for t in ft.TERMS]
    mids, wide, skew = [[t[4] for t in f] for f in qs], [[t[8] - t[0] for t in f] for f in qs], [[t[8] + t[0] - 2 * t[4] for t in f] for f in qs]
    trend = [clip(z[-1] + slope(z[-64:]) * (i + 1), 100) for i in range(h)]
    season = [z[len(v) - m + i % m] if len(v) >= m else z[-1] for i in range(h)]
    agreed = [statistics.median([f[t] for f in mids]) for t in range(h)]
    gap = lambda a, b: mean([abs(x - y) for x, y in zip(a, b)])
    place = lambda x: [(sum(y < a for y in x) + (sum(y == a for y in x) - 1) / 2) / (len(x) - 1) for a in x]
    ranks = [place([mean(f) for f in mids]), place([mean(f) for f in wide]), place([step(f) for f in mids]), place([gap(f, agreed) for f in mids])]
    for i, (a, w, k) in enumerate(zip(mids, wide, skew)):
        out += [mean(a), sd(a), a[0], a[-1], slope(a), step(a), mean([abs(x) for x in diff(diff(a))]), mean(w), sd(w), min(w), max(w), w[0], w[-1], mean(k), sd(k), a[0] - z[-1], gap(a, trend), gap(a, season), *(r[i] for r in ranks)]
    return out


def test_every_router_feature_is_that_of_plain_loops(spark):
    rng = np.random.default_rng(3)
    for n, h, m, freq, kind in ((600, 12, 24, "h", "hour"), (5, 1, 12, "M", "month"), (40, 3, 4, "Q", "quarter"), (1, 2, 1, "??", "other")):
        history = [float(x) for x in rng.normal(size=n) * 7]
        if n > 3:
            history[1], history[2] = float("nan"), history[3]
        q = {k: forecast(rng, h) for k in range(8)}
        rows = spark.createDataFrame([("w", history, freq, "Short")], "window string, history array<double>, freq string, term string")
        f = spark.createDataFrame([("w", k, t + 1, v[t].tolist()) for k, v in q.items() for t in range(h)], "window string, model_index int, step int, q array<double>")
        got = ft.router_features(rows, f).first().features
        assert len(got) == 195 and np.allclose(got, plain_features(history, [v.tolist() for v in q.values()], m, kind, "short"), atol=1e-9)


def test_windows_without_whole_forecasts_or_history_have_no_features(spark):
    rows = spark.createDataFrame([("none", [float("nan")], "h", "short"), ("bad", [1.0], "h", "short"), ("gone", [1.0], "h", "short")], "window string, history array<double>, freq string, term string")
    f = spark.createDataFrame([("none", 0, 1, [1.0] * 9), ("bad", 0, 1, [float("inf")] * 9)], "window string, model_index int, step int, q array<double>")
    assert ft.router_features(rows, f).count() == 0


def test_expert_features_are_laid_out_as_told():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3, ft.GLOBAL + ft.LOCAL * 8))
    x[0, ft.GLOBAL : ft.GLOBAL + ft.LOCAL] = x[0, ft.GLOBAL + ft.LOCAL : ft.GLOBAL + 2 * ft.LOCAL]  # ties
    got = ft.expert_values(x, 8)
    assert got.shape == (3, 8, 1433)
    for r in range(3):
        g, loc = x[r, : ft.GLOBAL], x[r, ft.GLOBAL :].reshape(8, ft.LOCAL)
        order = [[sum((loc[j, k], j) < (loc[e, k], e) for j in range(8)) for k in range(ft.LOCAL)] for e in range(8)]
        for e in range(8):
            me, own = np.eye(8)[e], loc[e]
            want = [*g, *own, *loc.ravel(), *np.tile(own, 8), *(own - loc).ravel(), *np.abs(own - loc).ravel(), *loc.mean(0), *(loc.max(0) - loc.min(0)), *loc.std(0), *loc.min(0), *loc.max(0), *np.median(loc, 0)]
            want += [*((own - loc.mean(0)) / np.maximum(loc.std(0), 0.05)), *(np.array(order[e]) / 7), *(np.array(order) / 7).ravel(), *me, *np.outer(g, me).ravel(), *np.sort(loc, 0).ravel()]
            assert np.allclose(got[r, e], want)


def test_nested_lists_come_back():
    rows = [np.random.default_rng(2).normal(size=s) for s in ((2, 3, 4), (1, 2, 4), (0, 0, 0))]
    for part in (slice(0, 3), slice(1, 3)):
        assert all(np.array_equal(a, b) for a, b in zip(arrays(lists(rows, 3)[part], 3), rows[part], strict=True))
    assert lists([None, np.ones(2)], 1).to_pylist() == [None, [1.0, 1.0]]


def test_rows_with_uneven_lists_reach_formulas_as_none(spark):
    rows = spark.createDataFrame([(1, [[1.0], [2.0, 3.0]]), (2, None), (3, [[1.0, None]])], "k int, v array<array<double>>")
    got = by_row(rows, ["v", "k"], "n double, k string", lambda v, k: (None if v is None else float(np.isnan(v).sum()), f"<{k}>")).collect()
    assert [(r.n, r.k) for r in got] == [(None, "<1>"), (None, "<2>"), (1.0, "<3>")]


def plain_pool(q, w):
    out = np.zeros((len(w), q.shape[1], 9))
    for r, weights in enumerate(w):
        for t in range(q.shape[1]):
            atoms = sorted((q[m, t, k], m, k) for m in range(len(q)) for k in range(9))
            for i in range(9):
                total = 0.0
                for v, m, _ in atoms:
                    total += weights[m] / weights.sum() / 9
                    if round(total, 12) >= (i + 1) / 10:
                        out[r, t, i] = v
                        break
    return out


def test_pools_are_quantiles_of_the_mixture():
    rng = np.random.default_rng(4)
    q, w = np.round(rng.normal(size=(4, 6, 9)), 1), rng.random((3, 4))
    assert np.allclose(en.pool_values(q, w), plain_pool(q, w))
    q[1, 2, 3] = np.nan  # that forecast loses its weight
    assert np.allclose(en.pool_values(q, w), plain_pool(np.delete(q, 1, 0), np.delete(w, 1, 1)))
    same = np.repeat(np.sort(rng.normal(size=(1, 5, 9)), 2), 4, 0)
    assert np.allclose(en.pool_values(same, w)[0], same[0])


def test_optimum_is_the_best_of_a_grid():
    rng = np.random.default_rng(6)
    for _ in range(30):
        left, right, y, w = rng.normal(size=(4, 8))
        w = np.abs(w)
        loss = lambda a, left=left, right=right, y=y, w=w: (w * np.abs((1 - a) * left + a * right - y)).sum()
        assert loss(en.optimum(left, right, y, w)) <= min(map(loss, np.linspace(0, 1, 201))) + 1e-9
    assert en.optimum(left, left, y, w) is None and en.optimum(left, right * np.nan, y, w) is None


def test_blend_keeps_the_left_where_the_right_is_missing():
    left, right = np.zeros((3, 9)), np.ones((3, 9))
    right[1, 4] = np.nan
    got = en.blended(left, right, 0.25)
    assert (got[[0, 2]] == 0.25).all() and (got[1] == 0).all() and (en.blended(left, None, 0.25) == left).all()


def test_training_table_rows(spark):
    lost = {(3, "b"), (4, "d")}
    windows, forecasts, w, f = case(spark, lost=lost)
    rows = {r.window: r for r in en.training_table(w, f, MODELS, ["a", "d"], 3).collect()}
    assert len(rows) == 24 and not rows["w3"].keep and rows["w3"].features is None and rows["w3"].core is None
    assert rows["w4"].keep and np.isnan(rows["w4"].members[1]).all() and not np.isnan(rows["w4"].members[0]).any()
    at = [round(k * 9 / 7) for k in range(8)]
    for name, group, _, history, future, *_ in windows:
        r = rows[name]
        if name == "w3":
            continue
        mag = max(1.0, max(map(abs, history)))
        assert np.allclose(r.target, [future[k] / mag for k in at]) and sum(r.knot_weight) == 10 and math.isclose(r.magnitude, mag)
        risk = [np.mean([abs(q[k] - future[k]) for k in at]) - np.mean([sum(q[k][i] * (2 * i - 8) / 81 for i in range(9)) for k in at]) for q in (forecasts[name][m] for m in MODELS)]
        assert r.ranks == np.argsort(np.argsort(risk)).tolist()
        assert len({x.fold for x in rows.values() if x.source_group == group}) == 1
    assert rows["w0"].bucket == "H|short" and rows["w4"].bucket == "D|short"


def test_stored_table_comes_back_by_fold(spark, tmp_path):
    _, _, w, f = case(spark, n=9)
    table = en.training_table(w, f, MODELS, ["a"], 3)
    back = en.store_table(table, str(tmp_path / "t"))
    key = lambda d: sorted((r.window, r.fold, tuple(r.ranks), tuple(r.target)) for r in d.collect())
    assert key(back) == key(table)
    plan = back.where("fold = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(fold" in plan


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    _, _, w, f = case(spark)
    table = en.store_table(en.training_table(w, f, MODELS, ["a", "d"], 3), str(tmp_path_factory.mktemp("table") / "t"))
    return table, en.fitted_routers(table, 3, 3, trees=3, depth=2)


def test_cross_fitted_pools_beat_equal_weights(spark, fitted):
    table, routers = fitted
    gates = spark.createDataFrame(GATES, "bucket string, position int, bias double, coefficients array<double>")
    pooled = en.pooled_table(table, en.cross_scores(table, routers, 3), gates, ["H"])
    own, even = [], []
    for r in pooled.collect():
        y, q = np.array(r.target), np.array(r.core)
        own.append(np.abs(np.array(r.pools[r.fold + 1])[:, 4] - y).mean())
        even.append(np.abs(en.pool_values(q, np.ones((1, 3)))[0][:, 4] - y).mean())
    assert np.mean(own) < np.mean(even) and len(own) == 24
    mass = {r.router: r.mass for r in en.masses(pooled).collect()}
    assert set(mass) == {0, 1, 2, 3} and all(0 <= m <= 1 for m in mass.values())
    rows = pooled.collect()
    for k in range(4):
        best = [r.optima[k] for r in rows if r.optima and (k == 0 or r.fold != k - 1) and not math.isnan(r.optima[k])]
        assert math.isclose(np.mean(best), mass[k])
    out = {r.window: r for r in en.parents(pooled, en.masses(pooled), [1]).collect()}
    for r in rows:
        pool = np.array(r.pools[r.fold + 1])
        want = en.blended(pool, None if r.gated is None else np.array(r.gated), mass[r.fold + 1]) * r.magnitude
        assert np.allclose(out[r.window].parent, want) and len(out[r.window].candidates) == 4


def test_a_fold_router_does_not_see_its_fold(spark, fitted):
    """Other labels in a fold change every router but its own."""
    table, routers = fitted
    turned = table.withColumn("ranks", F.when(F.col("fold") == 1, F.transform("ranks", lambda r: 2 - r)).otherwise(F.col("ranks")))
    again = en.fitted_routers(turned, 3, 3, trees=3, depth=2)
    scores = lambda rs: np.array([r.scores for r in en.cross_scores(table, rs, 3).orderBy("window").collect()])
    a, b = scores(routers), scores(again)
    assert np.allclose(a[:, 2], b[:, 2]) and not np.allclose(a[:, 0], b[:, 0]) and not np.allclose(a[:, 1], b[:, 1])


def test_chain_is_its_parts_run_singly(spark, fitted):
    _, routers = fitted
    windows, forecasts, w, f = case(spark, n=6, lost={(1, "b"), (2, "d")})
    gates = spark.createDataFrame(GATES, "bucket string, position int, bias double, coefficients array<double>")
    score = en.router_scores(routers[0], 3)
    got = {r.window: r for r in en.components(w, f, MODELS, ["d"], ["a", "d"], score, gates, ["H"], 0.4).collect()}
    assert len(got) == 6
    core = {n: [x.get(m) for m in MODELS] for n, x in forecasts.items()}
    for n, qs in core.items():
        there = [q for q in qs if q is not None]
        core[n] = np.stack([np.mean(there, 0) if q is None else q for q in qs])
    feats = spark.createDataFrame([(n, ft.window_values(np.array(h), core[n], 24 if fr == "h" else 1, "hour" if fr == "h" else "day", "short").tolist()) for n, _, _, h, _, _, fr, *_ in windows], "window string, features array<double>")
    scores = {r.window: r.scores for r in score(feats).collect()}
    for n, *_, freq, _, gate in windows:
        pool = en.pool_values(core[n], en.weights_of(np.array(scores[n])[None]))[0]
        assert np.allclose(got[n].pool, pool)
        if freq == "D" or n == "w2":
            assert got[n].gated is None and np.allclose(got[n].reference, pool)
        else:
            z = np.array([0.1 * gate[1], 0.5 + 0.2 * gate[0]])
            g = np.exp(z) / np.exp(z).sum()
            right = np.maximum.accumulate(g[0] * forecasts[n]["a"] + g[1] * forecasts[n]["d"], 1)
            assert np.allclose(got[n].gated, right) and np.allclose(got[n].reference, 0.6 * pool + 0.4 * right)
        assert np.allclose(got[n].candidates[3], pool if n == "w2" else forecasts[n]["d"]) and np.allclose(got[n].candidates[1], core[n][1])


def test_chain_stops_where_no_core_forecast_is_whole(spark, fitted):
    _, _, w, f = case(spark, n=2, lost={(1, "a"), (1, "b"), (1, "c")})
    gates = spark.createDataFrame(GATES, "bucket string, position int, bias double, coefficients array<double>")
    with pytest.raises(Exception, match="every core forecaster failed"):
        en.components(w, f, MODELS, ["d"], ["a", "d"], en.router_scores(fitted[1][0], 3), gates, ["H"], 0.4).collect()


def test_gates_by_bucket(spark):
    rows = spark.createDataFrame([("a", "h", "short", [1.0, 2.0]), ("b", "h", "long", [1.0, 2.0]), ("c", "W", "short", [1.0, 2.0]), ("d", "1h", "short", [1.0, float("nan")]), ("e", "h", None, [1.0, 2.0])], "window string, freq string, term string, gate_features array<double>")
    gates = spark.createDataFrame([*GATES, ("W|short", 0, 0.0, [0.0, 0.0])], "bucket string, position int, bias double, coefficients array<double>")
    got = {r.window: r.gate_weights for r in en.gate_weights(rows, gates, ["H"]).collect()}
    z = np.exp([0.2, 0.7])
    assert np.allclose(got["a"], z / z.sum()) and [got[k] for k in "bcde"] == [None] * 4
