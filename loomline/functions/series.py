"""Series operators over long tables (series_id, pos, value): repair, runs, scales, measurements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow import arrays
from .measures import by_length, spectrum


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def guarded(a: Column, b: Column, least: float = 0.0) -> Column:
    """a / b, null where b is null or at most `least`."""
    return F.when(b > least, a / b)


def repair(s: DataFrame) -> DataFrame:
    """Linear interpolation of missing values by position; the ends are held; a series without values is dropped."""
    v = F.when(is_finite(F.col("value")), F.col("value"))
    back = W.partitionBy("series_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("series_id").orderBy("pos").rowsBetween(0, W.unboundedFollowing)
    at = F.when(v.isNotNull(), F.col("pos"))
    s = s.withColumns({"v0": F.last(v, True).over(back), "p0": F.last(at, True).over(back), "v1": F.first(v, True).over(ahead), "p1": F.first(at, True).over(ahead)})
    between = F.when(F.col("p0") == F.col("p1"), F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("pos") - F.col("p0")) / (F.col("p1") - F.col("p0")))
    return s.withColumn("value", F.coalesce(between, "v0", "v1")).drop("v0", "p0", "v1", "p1").where("value is not null")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is not inlined again."""
    return F.transform(F.array(value), body)[0]


def filled(v: Column) -> Column:
    """An array with its missing values on the line between the nearest finite ones by place, ends held; null where none is finite.

    The stretches between neighbouring finite values are laid out one after the other, so the work grows with the array.
    """
    points = F.filter(F.transform(v, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x"))), lambda p: is_finite(p["x"]))

    def stretch(a, b):
        return F.transform(F.sequence(F.lit(0), b["i"] - a["i"] - 1), lambda j: a["x"] + (b["x"] - a["x"]) * j / (b["i"] - a["i"]))

    def laid_out(known):
        ends = F.zip_with(F.slice(known, F.lit(1), F.size(known) - 1), F.slice(known, F.lit(2), F.size(known) - 1), stretch)
        first, last = known[0], F.element_at(known, -1)
        return F.concat(F.array_repeat(first["x"], first["i"]), F.flatten(ends), F.array_repeat(last["x"], F.size(v) - last["i"]))

    gap = F.exists(v, lambda x: ~is_finite(x))
    return F.when(~gap, v).when(F.exists(v, is_finite), let(points, laid_out))


def finite_runs(s: DataFrame, least: int = 12) -> DataFrame:
    """Maximal runs of finite values of at least `least`: series_id, run (from 0), start, length."""
    ok = s.where(is_finite(F.col("value")))
    island = ok.withColumn("g", F.col("pos") - F.row_number().over(W.partitionBy("series_id").orderBy("pos")))
    runs = island.groupBy("series_id", "g").agg(F.min("pos").alias("start"), F.count("*").alias("length")).where(F.col("length") >= least)
    return runs.select("series_id", (F.row_number().over(W.partitionBy("series_id").orderBy("start")) - 1).cast("long").alias("run"), "start", "length")


def _lag(k: int) -> Column:
    return F.lag("value", k).over(W.partitionBy("series_id").orderBy("pos"))


def seasonal_scale(s: DataFrame, m: int) -> DataFrame:
    """Mean absolute difference at lag m; null where there is none or it is zero."""
    d = s.withColumn("d", F.abs(F.col("value") - _lag(m))).groupBy("series_id").agg(F.avg("d").alias("scale"))
    return d.select("series_id", F.when(is_finite(F.col("scale")) & (F.col("scale") > 0), F.col("scale")).alias("scale"))


def magnitude_scaled(s: DataFrame) -> DataFrame:
    peak = s.groupBy("series_id").agg(F.greatest(F.max(F.abs("value")), F.lit(1.0)).alias("magnitude"))
    return s.join(peak, "series_id").withColumn("scaled", F.col("value") / F.col("magnitude"))


def channels(target: Column, rows_first: bool = False) -> Column:
    """One array for each channel of an array of channels, or (rows_first) of an array of rows; an array of numbers is wrapped by its caller."""
    if not rows_first:
        return target
    return F.transform(F.sequence(F.lit(0), F.size(target[0]) - 1), lambda j: F.transform(target, lambda r: F.get(r, j)))


def rescale(values: Column, most: float, peak: float = 1.0) -> Column:
    """(values, scale): where a value exceeds `most` in size, all are divided by their peak over `peak`; forecasts are multiplied by scale again."""
    top = F.array_max(F.transform(values, F.abs))
    scale = F.when(top > most, top / peak).otherwise(1.0)
    return F.struct(F.transform(values, lambda x: x / scale).alias("values"), scale.alias("scale"))


def edge_padded(history: Column, least: int = 4) -> Column:
    """An array padded on the left with its first value up to `least` values."""
    return F.when(F.size(history) >= least, history).otherwise(F.concat(F.array_repeat(F.get(history, F.lit(0)), least - F.size(history)), history))


def admissible(history: Column, future: Column) -> Column:
    """Finite, not empty, not all zero, and a future not far beyond what the history spans."""
    fine = lambda a: (F.size(a) > 0) & F.forall(a, is_finite)
    n = F.size(history)
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a))
    level = mean(F.transform(history, F.abs))
    sd = F.sqrt(F.greatest(mean(F.transform(history, lambda x: x * x)) - mean(history) * mean(history), F.lit(0.0)))
    steps = F.when(n > 1, mean(F.zip_with(F.slice(history, 2, F.greatest(n - 1, F.lit(1))), F.slice(history, 1, F.greatest(n - 1, F.lit(1))), lambda a, b: F.abs(a - b)))).otherwise(0.0)
    return fine(history) & fine(future) & F.exists(history, lambda x: x != 0) & (F.array_max(F.transform(future, F.abs)) / F.greatest(level, sd, 4 * steps, F.lit(1.0)) <= 1e6)


def summary(s: DataFrame) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    out = s.groupBy("series_id").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.min("value").alias("least"), q.alias("q"), F.max("value").alias("most"))
    return out.select("series_id", "n", "mean", "sd", "least", F.col("q")[0].alias("q10"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q90"), "most")


def _moments(a: Column, b: Column) -> dict[str, Column]:
    """Pairwise counts and moments of a and b where both are there."""
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a), F.when(both, b)
    return {"n": F.count(p), "ma": F.avg(p), "mb": F.avg(q), "va": F.var_pop(p), "vb": F.var_pop(q), "cab": F.covar_pop(p, q)}


def correlation(n: Column, va: Column, vb: Column, cab: Column) -> Column:
    """Pearson; 0 for fewer than 3 pairs or a standard deviation under 1e-12."""
    return F.when((n >= 3) & (F.sqrt(va) >= 1e-12) & (F.sqrt(vb) >= 1e-12), cab / F.sqrt(F.nullif(va * vb, F.lit(0.0)))).otherwise(0.0)


def autocorrelation(s: DataFrame, lags=(1, 2, 4, 8, 16, 32)) -> DataFrame:
    """acf of each lag, and diff_acf1 of the first differences; one window pass for all lags, one aggregation."""
    d = F.col("value") - F.col("l1")
    s = s.withColumns({f"l{k}": _lag(k) for k in {1, 2, *lags}}).withColumns({"d": d, "d1": F.col("l1") - F.col("l2")})
    aggs = [e.alias(f"{m}{k}") for k in lags for m, e in _moments(F.col("value"), F.col(f"l{k}")).items()]
    out = s.groupBy("series_id").agg(*aggs, *[e.alias(f"{m}d") for m, e in _moments(F.col("d"), F.col("d1")).items()])
    named = {**{f"acf{k}": k for k in lags}, "diff_acf1": "d"}
    return out.select("series_id", *[correlation(*(F.col(f"{m}{k}") for m in ("n", "va", "vb", "cab"))).alias(name) for name, k in named.items()])


def place() -> Column:
    """The place of a value in its series, from 0, whatever the gaps."""
    return F.row_number().over(W.partitionBy("series_id").orderBy("pos")) - 1


def slope(s: DataFrame) -> DataFrame:
    """Least-squares slope over the place of a value (0 to n - 1, gaps closed), 0 for fewer than two values; deviation of first differences."""
    s = s.withColumns({"d": F.col("value") - _lag(1), "t": place()})
    out = s.groupBy("series_id").agg(F.count("value").alias("n"), F.covar_pop("t", "value").alias("c"), F.var_pop("t").alias("v"), F.stddev_pop("d").alias("diff_sd"))
    return out.select("series_id", F.when(F.col("n") >= 2, guarded(F.col("c"), F.col("v"))).otherwise(0.0).alias("slope"), "diff_sd")


def outlier(s: DataFrame) -> DataFrame:
    """Largest deviation from the median over 1.4826 MAD (the standard deviation where that is under 1e-12), and where it first lies, from 0 to 1."""
    s = s.withColumn("t", place())
    mid = s.groupBy("series_id").agg(F.median("value").alias("med"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    dev = s.join(mid, "series_id").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    out = dev.groupBy("series_id").agg(F.median("dev").alias("mad"), F.first("sd").alias("sd"), F.first("n").alias("n"), F.max(F.struct("dev", (-F.col("t")).alias("back"))).alias("top"))
    scale = F.when(F.col("mad") > 1e-12, 1.4826 * F.col("mad")).otherwise(F.greatest("sd", F.lit(1e-12)))
    return out.select("series_id", (F.col("top.dev") / scale).alias("score"), (-F.col("top.back") / F.greatest(F.col("n") - 1, F.lit(1))).alias("place"))


def segments(s: DataFrame, parts: int = 8) -> DataFrame:
    """Mean, deviation and slope (over places) of near-equal parts, longer ones first."""
    s = s.withColumn("t", place()).withColumn("segment", F.ntile(parts).over(W.partitionBy("series_id").orderBy("pos")).cast("long"))
    out = s.groupBy("series_id", "segment").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), F.covar_pop("t", "value").alias("c"), F.var_pop("t").alias("v"))
    return out.select("series_id", "segment", "mean", "sd", F.coalesce(guarded(F.col("c"), F.col("v")), F.lit(0.0)).alias("slope"))


def with_reach(rows: DataFrame, reach) -> DataFrame:
    """Adds `reach`, from the number n of a pair's values."""
    return rows.join(rows.groupBy("pair").agg(F.count("*").alias("n")).select("pair", reach(F.col("n")).cast("int").alias("reach")), "pair")


def lead_lag(a: DataFrame, b: DataFrame, top: int = 3) -> DataFrame:
    """Correlations of a[t] with b[t + lag] for all lags in reach; the strongest, then the shortest, then the lowest lag.

    a and b have (pair, pos, value) and are as long as each other; only |lag| rows a value are joined, on pair and position.
    """
    reach = lambda n: F.greatest(F.lit(0), F.least(F.lit(128), n - F.greatest(F.lit(32), F.floor(n / 3))))
    near = with_reach(a, reach).select("pair", F.col("value").alias("x"), "pos", F.explode(F.sequence(-F.col("reach"), F.col("reach"))).alias("lag")).withColumn("at", F.col("pos") + F.col("lag"))
    joined = near.join(b.select("pair", F.col("pos").alias("at"), F.col("value").alias("y")), ["pair", "at"])
    out = joined.groupBy("pair", "lag").agg(*[e.alias(m) for m, e in _moments(F.col("x"), F.col("y")).items()])
    out = out.select("pair", F.col("lag").cast("long").alias("lag"), correlation(F.col("n"), F.col("va"), F.col("vb"), F.col("cab")).alias("r"))
    order = W.partitionBy("pair").orderBy(F.desc(F.round(F.abs("r"), 9)), F.abs("lag"), "lag")
    return out.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top)


def affine_fit(a: DataFrame, b: DataFrame) -> DataFrame:
    """R2 of b on a for each pair, 0 where either is constant."""
    j = a.select("pair", "pos", F.col("value").alias("x")).join(b.select("pair", "pos", F.col("value").alias("y")), ["pair", "pos"])
    out = j.groupBy("pair").agg(*[e.alias(m) for m, e in _moments(F.col("x"), F.col("y")).items()])
    r = correlation(F.col("n"), F.col("va"), F.col("vb"), F.col("cab"))
    return out.select("pair", (r * r).alias("r2"))


def gathered(s: DataFrame) -> DataFrame:
    """series_id, v: the values of each series as an array, in order of pos."""
    out = s.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return out.select("series_id", F.transform("v", lambda x: x["value"].cast("double")).alias("v"))


def dominant_period(s: DataFrame) -> DataFrame:
    """Period and share of the strongest frequency after removing a line; 0 for fewer than eight values (arrays of equal length at once)."""

    def run(parts):
        for part in parts:
            period, share = np.zeros(len(part)), np.zeros(len(part))
            for at, v in by_length(arrays(part.column(1), 1)):
                period[at], share[at] = spectrum(v)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(period), pa.array(share)], ["series_id", "period", "share"])

    return gathered(s).mapInArrow(run, "series_id string, period double, share double")


def predictive_gain(source: DataFrame, target: DataFrame) -> DataFrame:
    """pair, lag, gain: how much of what a value's predecessor leaves open the source at an earlier step explains.

    The relative fall of the squared error is the squared partial correlation, so moments by lag are enough. Of equal
    gains the first lag counts; lag 0 and gain 0 where nothing is gained.
    """
    reach = lambda n: F.least(F.lit(32), F.floor(n / 4))
    own = with_reach(target, reach).withColumn("z", F.lag("value").over(W.partitionBy("pair").orderBy("pos"))).where(F.col("pos") >= F.col("reach"))
    near = with_reach(source, reach).where("reach > 0").select("pair", F.col("value").alias("x"), "pos", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("lag")).withColumn("pos", F.col("pos") + F.col("lag"))
    j = own.select("pair", "pos", F.col("value").alias("y"), "z").join(near, ["pair", "pos"])
    both = {"yz": ("y", "z"), "yx": ("y", "x"), "zx": ("z", "x")}
    m = j.groupBy("pair", "lag").agg(*[e.alias(f"{k}_{name}") for k, (a, b) in both.items() for name, e in _moments(F.col(a), F.col(b)).items()])
    r = {k: correlation(*(F.col(f"{k}_{c}") for c in ("n", "va", "vb", "cab"))) for k in both}
    rest = (1 - r["yz"] * r["yz"]) * (1 - r["zx"] * r["zx"])
    gain = F.coalesce(guarded(F.pow(r["yx"] - r["yz"] * r["zx"], 2), rest, 1e-12), F.lit(0.0))
    g = m.select("pair", F.col("lag").cast("long").alias("lag"), gain.alias("gain"))
    best = g.groupBy("pair").agg(F.max_by(F.struct("lag", "gain"), F.struct(F.round("gain", 9), -F.col("lag"))).alias("b"))
    return best.select("pair", F.when(F.col("b.gain") > 0, F.col("b.lag")).otherwise(0).alias("lag"), "b.gain")


def polynomial(s: DataFrame) -> DataFrame:
    """linear_r2, quadratic_r2 and curve (coefficient of t squared for standardised values, t from -1 to 1); null for constant series.

    Even steps make t and t squared orthogonal once the mean is taken off, so each part is a correlation of its own.
    """
    whole = W.partitionBy("series_id")
    t = 2.0 * (F.row_number().over(whole.orderBy("pos")) - 1) / F.nullif(F.count("*").over(whole) - 1, F.lit(0)) - 1
    s = s.withColumn("t", t).withColumn("t2", F.col("t") * F.col("t"))
    out = s.groupBy("series_id").agg(*[e.alias(f"{k}_{c}") for k, c2 in (("a", "t"), ("b", "t2")) for c, e in _moments(F.col(c2), F.col("value")).items()])
    r1, r2 = (correlation(*(F.col(f"{k}_{c}") for c in ("n", "va", "vb", "cab"))) for k in ("a", "b"))
    some = F.sqrt(F.col("a_vb")) >= 1e-12
    return out.select("series_id", F.when(some, r1 * r1).alias("linear_r2"), F.when(some, r1 * r1 + r2 * r2).alias("quadratic_r2"), F.when(some, guarded(F.col("b_cab"), F.col("b_va")) / F.nullif(F.sqrt("b_vb"), F.lit(0.0))).alias("curve"))
