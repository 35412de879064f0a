"""The reference forecast from requests to blend, and what it is trained from: a window is a row, its forecasts are arrays.

A forecast is an array over steps of nine deciles; a table of forecasts holds (window, model, step, q). Windows and
forecasts meet in one shuffle, by window; what follows is row by row, in numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import by_row
from ..functions.frequency import canonical, seasonality, supported
from . import curate
from .features import described, expert_features, fit_router, forecast_arrays, with_season

KNOTS = 8
#: Of the allocation of weights.
TEMPERATURE, FLOOR = 1.35, 0.15
LEVELS = np.arange(1, 10) / 10
_PATH, _DEEP = "array<array<double>>", "array<array<array<double>>>"


def whole(q: np.ndarray | None, horizon: int) -> bool:
    """Whether a forecast has all its steps of nine deciles, finite and under 1e30."""
    return q is not None and q.shape == (horizon, 9) and bool((np.isfinite(q) & (np.abs(q) < 1e30)).all())


def parts(named, names: list[str]) -> list[np.ndarray | None]:
    """The forecasts of `names` from a list of (model, steps); None where a model has none, or its steps are uneven."""
    held = dict(named or ())
    out = []
    for m in names:
        steps = held.get(m)
        even = steps is not None and all(s is not None and len(s) == len(steps[0] or ()) for s in steps)
        out.append(np.array(steps, float) if even else None)
    return out


def gathered(windows: DataFrame, forecasts: DataFrame, **groups: list[str]) -> DataFrame:
    """windows with an array of forecasts for each named group of models, in the order given; null where a model has none."""
    each = forecast_arrays(forecasts).withColumnRenamed("models", "__models")
    rows = windows.join(each, "window", "left")
    pick = lambda names: F.array(*[F.try_element_at("__models", F.lit(m)) for m in names]).cast(_DEEP)
    return rows.withColumns({k: pick(names) for k, names in groups.items()}).drop("__models")


def bucket(freq: Column, term: Column) -> Column:
    """Frequency (short, without suffix) and term, by which gates are kept."""
    return F.concat(F.substring_index(canonical(freq), "-", 1), F.lit("|"), term)


def gate_weights(rows: DataFrame, gates: DataFrame, known: list[str]) -> DataFrame:
    """rows (freq, term, gate_features, ...) with `gate_weights`: softmax of the linear gate of the row's bucket over the members.

    gates: bucket, position (of the member), bias, coefficients. Null where the frequency or the term is not supported
    (`known` frequencies; see frequency.supported), where no gate has the bucket, or where its form is not finite.
    """
    each = F.array_sort(F.collect_list(F.struct("position", "bias", "coefficients")))
    one = gates.groupBy(F.col("bucket").alias("__bucket")).agg(each.alias("g"))
    one = one.select("__bucket", F.transform("g", lambda g: g["bias"]).alias("__bias"), F.transform("g", lambda g: g["coefficients"]).alias("__coefficients"))
    key = F.when(supported(F.col("freq"), F.col("term"), known), bucket(F.col("freq"), F.col("term")))
    asked = rows.withColumn("__key", key).join(one, F.col("__key") == F.col("__bucket"), "left")

    def softmax(features, bias, coefficients):
        if features is None or bias is None or coefficients is None:
            return (None,)
        z = bias + coefficients @ features
        e = np.exp(z - z.max()) if np.isfinite(z).all() else None
        return (None if e is None else e / e.sum(),)

    out = by_row(asked, ["gate_features", "__bias", "__coefficients"], "gate_weights array<double>", softmax)
    return out.drop("__key", "__bucket", "__bias", "__coefficients")


def weights_of(scores: np.ndarray) -> np.ndarray:
    """Softmax of -z / TEMPERATURE of scores standardised along the last axis (deviation FLOOR at least)."""
    z = (scores - scores.mean(-1, keepdims=True)) / np.maximum(scores.std(-1, keepdims=True), FLOOR)
    e = np.exp(-(z - z.min(-1, keepdims=True)) / TEMPERATURE)
    return e / e.sum(-1, keepdims=True)


def pool_values(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Deciles (router, step, decile) of the mixture of forecasts q (model, step, decile) under weights w (router, model).

    A forecast that is not finite or not under 1e30 loses its weight. Of atoms of one value the first model's counts first.
    """
    ok = (np.isfinite(q) & (np.abs(q) < 1e30)).all((1, 2))
    w = w * ok
    w = w / w.sum(1, keepdims=True)
    atoms = np.where(ok[:, None, None], q, 0).transpose(1, 0, 2).reshape(q.shape[1], -1)
    order = np.argsort(atoms, 1, kind="stable")
    values = np.take_along_axis(atoms, order, 1)
    upto = np.round(np.cumsum(w[:, order // 9] / 9, axis=2), 12)
    first = np.stack([np.argmax(upto >= level, 2) for level in LEVELS], 2)
    return np.take_along_axis(np.broadcast_to(values, upto.shape), first, 2)


def gate_values(q: np.ndarray | None, w: np.ndarray | None) -> np.ndarray | None:
    """Deciles (step, decile) of members q weighted by w, never falling over the levels; None without weights or where a member is not whole."""
    if w is None or q is None or not q.size or not (np.isfinite(q) & (np.abs(q) < 1e30)).all():
        return None
    return np.maximum.accumulate(np.tensordot(w / w.sum(), q, 1), 1)


def blended(left: np.ndarray, right: np.ndarray | None, mass: float) -> np.ndarray:
    """Blend of two forecasts; at steps where right (made never falling) is missing or not finite, left."""
    if right is None:
        return left
    right = np.maximum.accumulate(right, 1)
    fine = np.isfinite(right).all(1, keepdims=True)
    return np.where(fine, (1 - mass) * left + mass * np.where(fine, right, 0), left)


# ---------------------------------------------------------------------- what is trained


def knots(horizon: int) -> np.ndarray:
    """Evenly spaced steps from 0 to horizon - 1, rounded half to even."""
    return np.round(np.arange(KNOTS) * (horizon - 1) / (KNOTS - 1)).astype(int)


def risks(q: np.ndarray, y: np.ndarray, scale: float) -> np.ndarray:
    """Empirical CRPS of each forecast (model, step, decile), in units of the scale."""
    spread = (q * ((2 * np.arange(1, 10) - 10) / 81)).sum(2).mean(1)
    return np.maximum(np.abs(q - y[:, None]).mean((1, 2)) - spread, 0) / max(scale, 1e-6)


def training_row(history, future, core, members, kind, term, m, season):
    """keep, magnitude, mase_valid, features, core, members, target, knot_weight, ranks of a window."""
    horizon = 0 if future is None else len(future)
    own = [] if core is None else list(core)
    if history is None or not len(history) or not horizon or not own or not all(whole(q, horizon) for q in own):
        return False, None, None, None, None, None, None, None, None
    magnitude = max(float(np.nanmax(np.abs(history))), 1.0)
    lag = season if len(history) > season else 1
    scale = float(np.mean(np.abs(history[lag:] - history[:-lag]))) / magnitude if len(history) > lag else np.nan
    fine, at = bool(np.isfinite(scale) and scale > 0), knots(horizon)
    near = np.abs(np.arange(horizon)[:, None] - at).argmin(1)
    some, target = core[:, at] / magnitude, future[at] / magnitude
    risk = np.round(risks(some, target, scale if fine else 1.0), 9)
    ranks = np.argsort(np.argsort(risk, kind="stable"), kind="stable")
    return True, magnitude, fine, described(history, core, m, kind, term, len(history)), some, members[:, at] / magnitude, target, np.bincount(near, minlength=KNOTS), ranks


def training_table(windows: DataFrame, forecasts: DataFrame, core: list[str], members: list[str], folds: int = 10) -> DataFrame:
    """One wide row for each window, from windows (window, source_group, block, history, future, freq, term, ...).

    fold (by source_group), keep (whether every core forecast is whole), bucket, label; and for kept ones magnitude,
    mase_valid, features (those of the router), core and members at the knots, target and knot_weight (how many steps are
    nearest to each knot), ranks of the core by their CRPS at the knots. Values are in units of the magnitude. A member
    without a whole forecast is NaN. Other columns stay.
    """
    c = F.col
    rows = gathered(windows, forecasts, core=core, members=members)
    # a member without a forecast, or with another number of steps, is NaN at every step: members then are one array
    missing = F.transform(F.sequence(F.lit(1), F.greatest(F.size("future"), F.lit(1))), lambda _: F.array_repeat(F.lit(float("nan")), 9))
    fits = lambda q: (F.size(q) == F.size("future")) & F.forall(q, lambda s: F.coalesce(F.size(s) == 9, F.lit(False)))
    rows = rows.withColumn("members", F.transform("members", lambda q: F.when(fits(q), q).otherwise(missing)))
    season = F.greatest(F.coalesce(seasonality(canonical(c("freq"))), F.lit(1)), F.lit(1))
    rows = with_season(rows).withColumns({"__season": season, "fold": curate.fold(c("source_group").cast("string"), folds), "bucket": bucket(c("freq"), c("term")), "label": F.concat(c("freq"), F.lit("|"), F.size("future"))})
    writes = f"keep boolean, magnitude double, mase_valid boolean, features array<double>, core {_DEEP}, members {_DEEP}, target array<double>, knot_weight array<double>, ranks array<double>"
    done = by_row(rows, ["history", "future", "core", "members", "__kind", "term", "__m", "__season"], writes, training_row)
    return done.withColumn("ranks", c("ranks").cast("array<int>")).drop("__m", "__kind", "__season")


def store_table(table: DataFrame, path: str) -> DataFrame:
    """The table written by fold and read back, so that a fold's rows are read without the others'."""
    table.repartition("fold", "window").write.partitionBy("fold").parquet(path)
    columns = [f for f in table.schema.fields if f.name != "fold"] + [table.schema["fold"]]
    return table.sparkSession.read.schema(type(table.schema)(columns)).parquet(path).select(*table.columns)


def labelled(table: DataFrame, models: int) -> DataFrame:
    """window, fold, model_index, features, label (log of 1 + rank): a row for each core forecast of kept windows."""
    kept = table.where("keep")
    labels = kept.select("window", "fold", F.posexplode("ranks").alias("model_index", "rank")).select("window", "fold", "model_index", F.log1p("rank").alias("label"))
    return expert_features(kept, models).join(labels, ["window", "model_index"])


def fitted_routers(table: DataFrame, models: int, folds: int, **recipe) -> list:
    """The router of all kept windows, then for each fold one that did not see the fold."""
    rows = labelled(table, models)
    return [fit_router(rows if k is None else rows.where(F.col("fold") != k), "features", "label", **recipe) for k in [None, *range(folds)]]


def cross_scores(table: DataFrame, routers: list, models: int) -> DataFrame:
    """window, scores: for each router, each core forecast's score; all routers in one pass over the expert rows."""
    from pyspark.ml.functions import array_to_vector

    rows = expert_features(table.where("keep"), models).select("window", "model_index", array_to_vector("features").alias("features"))
    for k, router in enumerate(routers):
        rows = router.copy().setPredictionCol(f"__s{k}").transform(rows)
    told = F.struct("model_index", F.array(*[f"__s{k}" for k in range(len(routers))]).alias("s"))
    each = rows.groupBy("window").agg(F.array_sort(F.collect_list(told)).alias("x"))
    return each.select("window", F.transform(F.sequence(F.lit(0), F.lit(len(routers) - 1)), lambda r: F.transform("x", lambda e: F.get(e["s"], r))).alias("scores"))


def optimum(left: np.ndarray, right: np.ndarray, target: np.ndarray, weight: np.ndarray) -> float | None:
    """Share of right, in [0, 1], of least weighted absolute error: a weighted median of roots; None where nothing moves."""
    fine = np.isfinite(left) & np.isfinite(right) & np.isfinite(target) & (left != right) & (weight > 0)
    if not fine.any():
        return None
    delta = (right - left)[fine]
    roots = np.clip((target - left)[fine] / delta, 0, 1)
    order = np.argsort(roots, kind="stable")
    roots, upto = roots[order], np.cumsum((np.abs(delta) * weight[fine])[order])
    half = upto[-1] / 2
    return float(roots[(upto >= half).argmax()] + roots[(upto > half).argmax()]) / 2


def pooled_row(core, members, scores, gate, target, weight, mase_valid):
    """pools, gated, optima of a row of the table."""
    pools, gated = pool_values(core, weights_of(scores)), gate_values(members, gate)
    if gated is None or not mase_valid:
        return pools, gated, None
    best = [optimum(p[:, 4], gated[:, 4], target, weight) for p in pools]
    return pools, gated, np.array([np.nan if b is None else b for b in best])


def pooled_table(table: DataFrame, scores: DataFrame, gates: DataFrame, known: list[str]) -> DataFrame:
    """Kept rows of the table with pools (of the full router, then of each fold's), gated, and optima, the best mass of each pool.

    In units of the magnitude. gated is null where no gate has the row's bucket or a member is not whole; optima are null
    there and where the scale is not valid, NaN where pool and gate are one.
    """
    rows = gate_weights(table.where("keep").join(scores, "window"), gates, known)
    out = by_row(rows, ["core", "members", "scores", "gate_weights", "target", "knot_weight", "mase_valid"], f"pools {_DEEP}, gated {_PATH}, optima array<double>", pooled_row)
    return out.drop("scores", "gate_weights")


def masses(pooled: DataFrame) -> DataFrame:
    """router (0: all, k + 1: without fold k), mass: mean optimum of the rows that the router was fitted on, with its own pool.

    As many rows as routers; a router without any usable row has none.
    """
    each = pooled.select("fold", F.posexplode("optima").alias("router", "best")).where("(router = 0 or fold <> router - 1) and not isnan(best)")
    return each.groupBy("router").agg(F.avg("best").alias("mass"))


def parent_row(core, members, pools, gated, target, magnitude, fold, mass, extras):
    """candidates, parent, target in the window's own units."""
    if mass is None:
        raise ValueError("no row of the other folds tells a blend weight")
    pool = pools[fold + 1]
    own = [members[k] if np.isfinite(members[k]).all() else pool for k in extras]
    return np.sort(np.stack([*core, *own]) * magnitude, 2), blended(pool, gated, mass) * magnitude, target * magnitude


def parents(pooled: DataFrame, mass: DataFrame, extras: list[int]) -> DataFrame:
    """window, fold, mass, candidates, parent, target, knot_weight, in the windows' own units.

    A window's parent is the blend of the gated forecast with the pool of the router that did not see its fold, by the
    mass that did not see it either (an equi-join on the router). Candidates are the core, then the members at the
    positions `extras`, sorted; a member without a forecast gives way to that pool. An error where a fold has no mass.
    """
    known = mass.select(F.col("router").alias("__router"), "mass")
    rows = pooled.join(known, F.col("fold") + 1 == F.col("__router"), "left")
    reads = ["core", "members", "pools", "gated", "target", "magnitude", "fold", "mass"]
    out = by_row(rows, reads, f"candidates {_DEEP}, parent {_PATH}, target array<double>", lambda *x: parent_row(*x, extras))
    return out.select("window", "fold", "mass", "candidates", "parent", "target", "knot_weight")


# ---------------------------------------------------------------------- what is forecast


def borrowed(core: list[np.ndarray | None], horizon: int) -> np.ndarray:
    """The forecasts, sorted, with the mean of the whole ones in place of the others; an error where none is whole."""
    ok = [whole(q, horizon) for q in core]
    if not any(ok):
        raise ValueError("every core forecaster failed on a request")
    sorted_ = [np.sort(q, 1) if f else None for q, f in zip(core, ok, strict=True)]
    mean = np.mean([q for q in sorted_ if q is not None], 0)
    return np.stack([mean if q is None else q for q in sorted_])


def router_scores(router, models: int) -> Callable[[DataFrame], DataFrame]:
    """What components() asks for its scores: a fitted router."""

    def score(rows: DataFrame) -> DataFrame:
        return cross_scores(rows.withColumn("keep", F.lit(True)), [router], models).select("window", F.col("scores")[0].alias("scores"))

    return score


def components(requests: DataFrame, forecasts: DataFrame, core: list[str], extras: list[str], members: list[str], score: Callable[[DataFrame], DataFrame], gates: DataFrame, known: list[str], mass: float) -> DataFrame:
    """window, candidates, pool, gated, reference, from requests (window, history, horizon, freq, term, gate_features, ready).

    In turn: sorted candidates; a failed core forecast borrows the mean of the others (an error where all failed); the
    router's features and, by score(window, features), its weights; the pool of the core; failed extras give way to the
    pool; the gated forecast of the members, or the request's `ready` one where it has one, null where neither is; their
    blend by `mass`, the pool alone where nothing is gated. term null is short; requests may lack `ready`.
    """
    c, every = F.col, [*dict.fromkeys([*core, *extras, *members])]
    if "ready" not in requests.columns:
        requests = requests.withColumn("ready", F.lit(None).cast(_PATH))
    each = forecast_arrays(forecasts).select("window", F.map_entries("models").alias("__models"))
    rows = with_season(requests.withColumn("term", F.coalesce("term", F.lit("short"))).join(each, "window", "left"))

    def first(models, history, horizon, m, kind, term):
        held = parts([(e["key"], e["value"]) for e in models or ()], every)
        own = borrowed([held[every.index(x)] for x in core], horizon)
        some = [held[every.index(x)] for x in members]
        extra = [held[every.index(x)] for x in extras]
        gap = np.full((horizon, 9), np.nan)
        of = lambda qs: np.stack([q if whole(q, horizon) else gap for q in qs])
        return own, of(some), np.sort(of(extra), 2) if extra else None, described(history, own, m, kind, term, 512)

    reads = ["__models", "history", "horizon", "__m", "__kind", "term"]
    rows = by_row(rows, reads, f"core {_DEEP}, members {_DEEP}, __extras {_DEEP}, features array<double>", first).drop("__models", "__m", "__kind")
    rows = gate_weights(rows.join(score(rows.select("window", "features")), "window"), gates, known)

    def last(own, some, extra, scores, gate, ready):
        pool = pool_values(own, weights_of(scores[None]))[0]
        extra = [] if extra is None else [q if np.isfinite(q).all() else pool for q in extra]
        right = np.maximum.accumulate(ready, 1) if ready is not None else gate_values(some, gate)
        return np.stack([*own, *extra]), pool, right, blended(pool, right, mass)

    out = by_row(rows, ["core", "members", "__extras", "scores", "gate_weights", "ready"], f"candidates {_DEEP}, pool {_PATH}, gated {_PATH}, reference {_PATH}", last)
    return out.select("window", "candidates", "pool", "gated", "reference")
