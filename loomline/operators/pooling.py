"""Quantile forecasts in long tables (window, model, step, q array of nine deciles): ranks, weights, pools, blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import is_finite

LEVELS = [k / 10 for k in range(1, 10)]


def valid(q: Column) -> Column:
    return F.forall(q, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e30))


def knots(horizon: Column, count: int = 8) -> Column:
    """Evenly spaced steps from 0 to horizon - 1, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.bround(k * (horizon - 1) / F.lit(float(count - 1))).cast("int"))


def crps_ranks(f: DataFrame) -> DataFrame:
    """window, model, risk, rank (0 lowest; ties by model) from rows with step, q, y and scale."""
    spread = F.aggregate(F.transform("q", lambda x, i: x * (2 * (i + 1) - 10) / 81.0), F.lit(0.0), lambda a, b: a + b)
    error = F.aggregate(F.transform("q", lambda x: F.abs(x - F.col("y"))), F.lit(0.0), lambda a, b: a + b) / 9.0
    out = f.groupBy("window", "model").agg((F.greatest(F.avg(error) - F.avg(spread), F.lit(0.0)) / F.greatest(F.first("scale"), F.lit(1e-6))).alias("risk"))
    return out.withColumn("rank", (F.row_number().over(W.partitionBy("window").orderBy(F.round("risk", 9), "model")) - 1).cast("long"))


def allocations(scores: DataFrame) -> DataFrame:
    """Softmax of -z / 1.35 of the scores standardised in each window (deviation 0.15 at least)."""
    w = W.partitionBy("window")
    z = (F.col("score") - F.avg("score").over(w)) / F.greatest(F.stddev_pop("score").over(w), F.lit(0.15))
    e = scores.withColumn("e", F.exp(-z / 1.35))
    return e.select("window", "model", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def pooled(f: DataFrame, weights: DataFrame) -> DataFrame:
    """window, step, q: quantiles of the weighted mixture of the models' atoms. An invalid model loses its weight for the window.

    The atoms of a (window, step) are few (nine a model), so they are sorted in an array: one shuffle, by window.
    """
    ok = f.groupBy("window", "model").agg(F.bool_and(valid(F.col("q"))).alias("ok")).where("ok").select("window", "model")
    used = f.join(ok, ["window", "model"]).join(weights, ["window", "model"])
    total = used.select("window", "model", "weight").distinct().groupBy("window").agg(F.sum("weight").alias("total"))
    atoms = used.join(total, "window").select("window", "step", F.posexplode("q").alias("level", "v"), "model", (F.col("weight") / F.col("total") / 9.0).alias("m"))
    mass = F.sum("m").over(W.partitionBy("window", "step").orderBy("v", "model", "level").rowsBetween(W.unboundedPreceding, 0))
    cum = atoms.withColumn("cum", F.round(mass, 12))
    first = [F.min(F.when(F.col("cum") >= p, F.col("v"))).alias(f"q{i + 1}") for i, p in enumerate(LEVELS)]
    return cum.groupBy("window", "step").agg(*first)


def blended(left: Column, right: Column, mass: float) -> Column:
    """(1 - mass) left + mass running maximum of right; left where right is missing."""
    top = F.transform(right, lambda _, i: F.array_max(F.slice(right, F.lit(1), i + 1)))
    return F.when(right.isNotNull() & valid(right), F.zip_with(left, top, lambda a, b: (1 - mass) * a + mass * b)).otherwise(left)


def row_optimum(rows: DataFrame) -> DataFrame:
    """Blend weight in [0, 1] of least weighted absolute error per window, from (window, left, right, y, weight): a weighted median of roots."""
    rows = rows.where(is_finite(F.col("left")) & is_finite(F.col("right")) & is_finite(F.col("y")))
    d = rows.where("right - left <> 0").select("window", F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") - F.col("left")) / (F.col("right") - F.col("left")))).alias("root"), (F.abs(F.col("right") - F.col("left")) * F.col("weight")).alias("mass"))
    w = W.partitionBy("window")
    d = d.withColumns({"cum": F.sum("mass").over(w.orderBy("root").rangeBetween(W.unboundedPreceding, 0)), "total": F.sum("mass").over(w)})
    low, high = F.min(F.when(F.col("cum") >= F.col("total") / 2, F.col("root"))), F.min(F.when(F.col("cum") > F.col("total") / 2, F.col("root")))
    return d.groupBy("window").agg(((low + F.coalesce(high, F.max("root"))) / 2).alias("optimum"))


def blend_mass(optima: DataFrame) -> float:
    """The mean of the rows' optima (nulls say nothing); an error where none is usable. One number goes to the driver."""
    mass = optima.agg(F.avg("optimum")).first()[0]
    if mass is None:
        raise ValueError("no row tells a blend weight")
    return mass


def routed(rows: DataFrame, text: str, full: str, weights: list[list[float]], bias: list[float], share: float = 0.5) -> DataFrame:
    """Softmax routing weights of a linear form of two state vectors."""
    v = F.zip_with(F.col(text), F.col(full), lambda a, b: (1 - share) * a.cast("double") + share * b.cast("double"))
    rows = rows.withColumn("__v", v)
    dot = lambda w, b: F.aggregate(F.zip_with("__v", F.array(*map(F.lit, w)), lambda a, c: a * c), F.lit(float(b)), lambda a, c: a + c)
    rows = rows.withColumns({f"__z{i}": dot(w, b) for i, (w, b) in enumerate(zip(weights, bias, strict=True))})
    top = F.greatest(*[F.col(f"__z{i}") for i in range(len(weights))])
    e = [F.exp(F.col(f"__z{i}") - top) for i in range(len(weights))]
    total = sum(e[1:], e[0])
    return rows.withColumns({f"w{i}": x / total for i, x in enumerate(e)}).drop("__v", *[f"__z{i}" for i in range(len(weights))])
