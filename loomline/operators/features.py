"""What a router learns from: 195 values of a window, 1,433 of a (window, forecaster); knots and folds of a training table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import arrays, by_row, lists
from ..functions.frequency import family, seasonality
from .correction import mean

FAMILIES, TERMS = ("minute", "hour", "day", "week", "month", "quarter", "year", "other"), ("short", "medium", "long")
GLOBAL, LOCAL = 19, 22
#: Rows of an expert table that are made at a time.
ROWS = 64


def forecast_arrays(forecasts: DataFrame) -> DataFrame:
    """window, models: a map from a model to its forecast, an array over steps of arrays of deciles. One shuffle, by window."""
    steps = F.array_sort(F.collect_list(F.struct("model", "step", "q")))
    names = F.array_distinct(F.transform("s", lambda x: x["model"]))
    of = lambda m: F.transform(F.filter("s", lambda x: x["model"] == m), lambda x: x["q"])
    return forecasts.groupBy("window").agg(steps.alias("s")).select("window", F.map_from_arrays(names, F.transform(names, of)).alias("models"))


def _diff_mean(x: np.ndarray, order: int = 1) -> np.ndarray:
    """Mean absolute difference along the last axis; 0 where it is too short."""
    return np.abs(np.diff(x, order)).mean(-1) if x.shape[-1] > order else np.zeros(x.shape[:-1])


def _lean(x: np.ndarray) -> np.ndarray:
    """Least-squares slope along the last axis over 0, 1, ...; 0 for one value."""
    t = np.arange(x.shape[-1]) - (x.shape[-1] - 1) / 2
    return (x - x.mean(-1, keepdims=True)) @ t / max(t @ t, 1e-12)


def _places(x: np.ndarray) -> np.ndarray:
    """Place in [0, 1] of each value among the others, ties in the middle."""
    below, same = (x[:, None] > x).sum(1), (x[:, None] == x).sum(1)
    return (below + (same - 1) / 2) / max(len(x) - 1, 1)


def window_values(v: np.ndarray, q: np.ndarray, m: int, kind: str, term: str | None) -> np.ndarray:
    """19 values of a window with finite observations v, then 22 of each of its forecasts q (forecaster, step, decile)."""
    n, h = len(v), q.shape[1]
    magnitude = max(np.abs(v).max(), 1.0)
    scaled = v / magnitude
    place = np.median(scaled)
    centred = scaled - place
    scale = max(1.4826 * np.median(np.abs(centred)), float(_diff_mean(scaled)), centred.std(), 1e-4 * abs(place), 1e-6)
    normal = np.clip(centred / scale, -50, 50)
    q = np.clip((q / magnitude - place) / scale, -100, 100)
    mid, wide, skew = q[..., 4], q[..., 8] - q[..., 0], q[..., 8] + q[..., 0] - 2 * q[..., 4]
    last, ahead = normal[-1], np.arange(h)
    trend = np.clip(last + _lean(normal[-64:]) * (ahead + 1), -100, 100)
    season = normal[n - m + ahead % m] if n >= m else np.full(h, last)
    rough, gap = _diff_mean(mid), lambda other: np.abs(mid - other).mean(1)
    whole = [np.log1p(n), np.log1p(h), np.log((n + 1) / (h + 1)), np.log1p(magnitude), place, scale, np.log1p(m), h / m]
    whole += [float(kind == k) for k in FAMILIES] + [float((term or "").lower() == t) for t in TERMS]
    own = [
        mid.mean(1), mid.std(1), mid[:, 0], mid[:, -1], _lean(mid), rough, _diff_mean(mid, 2), wide.mean(1), wide.std(1), wide.min(1), wide.max(1), wide[:, 0], wide[:, -1],
        skew.mean(1), skew.std(1), mid[:, 0] - last, gap(trend), gap(season), _places(mid.mean(1)), _places(wide.mean(1)), _places(rough), _places(gap(np.median(mid, 0))),
    ]
    return np.concatenate([whole, np.stack(own, 1).ravel()])


def described(v: np.ndarray | None, q: np.ndarray | None, m: int, kind: str, term: str | None, context: int) -> np.ndarray | None:
    """window_values of the last `context` observations; None where none of them is finite, or a forecast is not whole and finite."""
    if v is None or q is None or not q.size or not np.isfinite(q).all():
        return None
    v = v[-context:]
    v = v[np.isfinite(v)]
    return window_values(v, q, m, kind, term) if len(v) else None


def with_season(rows: DataFrame) -> DataFrame:
    """rows (freq, ...) with the season and the family of the frequency, for described()."""
    return rows.withColumns({"__m": F.coalesce(seasonality(F.col("freq")), F.lit(1)), "__kind": family(F.col("freq"))})


def router_features(windows: DataFrame, forecasts: DataFrame, context: int = 512) -> DataFrame:
    """window, features: 19 values of the window, then 22 of each forecaster in the order of model_index.

    windows: window, history, freq, term; forecasts: window, model_index, step, q. A row for each window whose last
    `context` observations have a finite value and whose forecasts are finite. One shuffle, by window.
    """
    each = forecast_arrays(forecasts.select("window", F.col("model_index").alias("model"), "step", "q"))
    recent = F.slice("history", F.greatest(F.size("history") - context + 1, F.lit(1)), F.lit(context)).alias("history")
    rows = windows.select("window", recent, "freq", "term").join(each.select("window", F.map_values("models").alias("core")), "window")
    out = by_row(with_season(rows), ["history", "core", "__m", "__kind", "term"], "features array<double>", lambda *x: (described(*x, context),))
    return out.where("features is not null").select("window", "features")


def expert_values(x: np.ndarray, models: int) -> np.ndarray:
    """Rows of router features to (row, forecaster, values): the window's values, the forecaster's own, all others', differences, spreads, ranks, identity."""
    rows = len(x)
    g, local = x[:, :GLOBAL], x[:, GLOBAL:].reshape(rows, models, LOCAL)
    ordered = np.sort(local, 1)
    rank = np.argsort(np.argsort(local, 1, kind="stable"), 1, kind="stable") / 7.0
    mean_, spread, lo, hi = local.mean(1), local.std(1), ordered[:, 0], ordered[:, -1]
    every = lambda a: np.broadcast_to(a.reshape(rows, 1, -1), (rows, models, a.size // max(rows, 1)))  # noqa: E731  the same for each forecaster
    minus = local[:, :, None] - local[:, None]
    flat = lambda a: a.reshape(rows, models, -1)
    me = np.eye(models)
    parts = [
        every(g), local, every(local), np.tile(local, (1, 1, models)), flat(minus), np.abs(flat(minus)), every(mean_), every(hi - lo), every(spread), every(lo), every(hi), every(np.median(local, 1)),
        (local - mean_[:, None]) / np.maximum(spread, 0.05)[:, None], rank, every(rank), np.broadcast_to(me, (rows, models, models)),
        flat(g[:, None, :, None] * me[None, :, None, :]), every(ordered),
    ]
    return np.concatenate(parts, 2)


def expert_features(rows: DataFrame, models: int = 8) -> DataFrame:
    """window, model_index, features: a row for each forecaster of a window (window, features of router_features)."""

    def run(parts):
        for part in parts:
            x = arrays(part.column(1), 1)
            for a in range(0, len(x), ROWS):
                some = x[a : a + ROWS]
                values = expert_values(np.stack(some), models).reshape(len(some) * models, -1)
                window = part.column(0).take(pa.array(np.repeat(np.arange(a, a + len(some)), models)))
                yield pa.RecordBatch.from_arrays([window, pa.array(np.tile(np.arange(models, dtype=np.int32), len(some))), lists(list(values), 1)], ["window", "model_index", "features"])

    kind = rows.schema["window"].dataType.simpleString()
    return rows.select("window", "features").mapInArrow(run, f"window {kind}, model_index int, features array<double>")


def knot_weights(horizon: Column, knots: Column) -> Column:
    """How many steps are nearest to each knot, the first of equally near ones."""
    nearest = F.transform(F.sequence(F.lit(0), (horizon - 1).cast("int")), lambda t: F.array_position(F.transform(knots, lambda k: F.abs(k - t)), F.array_min(F.transform(knots, lambda k: F.abs(k - t)))) - 1)
    return F.transform(knots, lambda _, i: F.size(F.filter(nearest, lambda n: n == i)))


def training_scale(history: Column, season: Column, magnitude: Column) -> Column:
    """Mean absolute difference at the season (at lag 1 where the history is not longer) over the magnitude; null where there is none or it is 0."""
    lag = F.when(F.size(history) > season, season).otherwise(1)
    n = F.greatest(F.size(history) - lag, F.lit(0)).cast("int")
    d = F.zip_with(F.slice(history, (lag + 1).cast("int"), n), F.slice(history, F.lit(1), n), lambda a, b: F.abs(a - b))
    s = F.when(n > 0, mean(d) / magnitude)
    return F.when(s > 0, s)


def fold_masses(optima: DataFrame, fold: str = "fold") -> DataFrame:
    """fold, mass: for each fold the mean optimum of the rows of all other folds (sums of the folds, so one shuffle)."""
    sums = optima.groupBy(fold).agg(F.sum("optimum").alias("s"), F.count("optimum").alias("n"))
    total = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))  # one row
    return sums.join(F.broadcast(total)).select(fold, ((F.col("all_s") - F.coalesce("s", F.lit(0.0))) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))).alias("mass"))


def fit_router(rows: DataFrame, features: str, label: str, trees: int = 20, depth: int = 5, seed: int = 1):
    """A gradient-boosted tree model of `label` over an array of features, and the vector stage before it."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    known = rows.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"))
    return GBTRegressor(maxIter=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8, stepSize=0.1).fit(known)


def routed_scores(model, rows: DataFrame, features: str) -> DataFrame:
    """rows with `score`, the model's prediction."""
    from pyspark.ml.functions import array_to_vector

    return model.transform(rows.withColumn("__v", array_to_vector(features)).withColumnRenamed(features, "__f").withColumnRenamed("__v", "features")).drop("features").withColumnRenamed("__f", features).withColumnRenamed("prediction", "score")


def cross_fitted(rows: DataFrame, features: str, label: str, folds: list[int], **recipe) -> DataFrame:
    """rows with `score`: each fold's from a model that did not see it."""
    out = None
    for k in folds:
        part = routed_scores(fit_router(rows.where(F.col("fold") != k), features, label, **recipe), rows.where(F.col("fold") == k), features)
        out = part if out is None else out.unionByName(part)
    return out
