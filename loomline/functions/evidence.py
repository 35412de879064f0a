"""Measurements of one or two series as text, and of pairs and halves as tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..sources.stage import staged
from . import measures as ms
from . import series as sr
from .arrow import arrays
from .questions import sensor_table
from .text import formatted, formatted_all, measure, measured

#: Titles and conventions of measurements.
VALUES, MEASUREMENTS = "values (successive observations separated by spaces):\n", "Computed measurements:\n"
BY_CHANNEL = "\nComputed measurements for each temporal channel separately:\n"
PAIR_TITLE = "Pair convention: positive lag k means S1[t] aligns with S2[t+k] (S1 leads S2).\n"
TREND_TITLE = "Trend fits: time rescaled to [-1,1], values standardized; R2 is variance explained; quadratic_t2 is the coefficient of time squared."
SPECTRUM_TITLE = (
    "Local spectrum: consecutive first and second halves, each linearly detrended. FFT period is in samples; power_fraction is the fraction of non-DC spectral power at that peak. "
    "Peaks are estimates, not proof of periodicity."
)
LAGS = (1, 2, 4, 8, 16, 32)


def validated(s: DataFrame) -> DataFrame:
    """series_id, n, problem: fewer than 8 values, or one that is missing or not finite; null where none."""
    bad = F.count(F.when(~F.coalesce(sr.is_finite(F.col("value")), F.lit(False)), 1))
    out = s.groupBy("series_id").agg(F.count("*").alias("n"), bad.alias("bad"))
    return out.select("series_id", "n", F.when(F.col("n") < 8, "short").when(F.col("bad") > 0, "not finite").alias("problem"))


def half_spectrum(s: DataFrame) -> DataFrame:
    """series_id, half (1, 2), n, period, share: the dominant period of the first and of the second half (the first is longer)."""
    half = F.ntile(2).over(W.partitionBy("series_id").orderBy("pos"))
    parts = s.withColumn("half", half).withColumn("series_id", F.concat("series_id", F.lit("\u0001"), "half"))
    out = sr.dominant_period(parts).join(parts.groupBy("series_id").agg(F.count("*").alias("n")), "series_id")
    at = F.split("series_id", "\u0001")
    return out.select(at[0].alias("series_id"), at[1].cast("int").alias("half"), "n", "period", "share")


def differences(s: DataFrame) -> DataFrame:
    """First differences of (pair, pos, value)."""
    return s.withColumn("value", F.col("value") - F.lag("value").over(W.partitionBy("pair").orderBy("pos"))).where("value is not null")


def pair_summary(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, corr0, top (lag and r of the three strongest shifts), diff_lag, diff_r, r2, gains and their lags both ways.

    a and b (pair, pos, value) are cut to their common positions first.
    """
    common = a.select("pair", "pos").join(b.select("pair", "pos"), ["pair", "pos"])
    a, b = (x.join(common, ["pair", "pos"]).select("pair", "pos", "value") for x in (a, b))
    shifts = sr.lead_lag(a, b)
    top = shifts.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("place", "lag", "r"))).alias("t")).select("pair", F.transform("t", lambda x: F.struct(x["lag"].alias("lag"), x["r"].alias("r"))).alias("top"))
    both = a.select("pair", "pos", F.col("value").alias("x")).join(b.select("pair", "pos", F.col("value").alias("y")), ["pair", "pos"])
    m = both.groupBy("pair").agg(*[e.alias(k) for k, e in sr._moments(F.col("x"), F.col("y")).items()])
    corr = m.select("pair", sr.correlation(*(F.col(k) for k in ("n", "va", "vb", "cab"))).alias("corr0"))
    diff = sr.lead_lag(differences(a), differences(b), 1).select("pair", F.col("lag").alias("diff_lag"), F.col("r").alias("diff_r"))
    there = sr.predictive_gain(a, b).select("pair", F.col("lag").alias("lag12"), F.col("gain").alias("gain12"))
    back = sr.predictive_gain(b, a).select("pair", F.col("lag").alias("lag21"), F.col("gain").alias("gain21"))
    out = corr
    for t in (top, diff, sr.affine_fit(a, b), there, back):
        out = out.join(t, "pair", "left")
    return out


def _said(v: np.ndarray) -> list[tuple[str, str, str]]:
    """For series of one length (rows of v, 8 values at least) the texts single, trend and halves, under the name S1."""
    n = v.shape[1]
    d = np.diff(v)
    q = np.quantile(v, (0.1, 0.5, 0.9), axis=1)
    first = {"mean": v.mean(axis=1), "sd": v.std(axis=1), "min": v.min(axis=1), "q10": q[0], "median": q[1], "q90": q[2], "max": v.max(axis=1), "slope": ms.slope(v), "diff_sd": d.std(axis=1), "diff_acf1": ms.correlation(d[:, :-1], d[:, 1:])}
    acf = {k: ms.correlation(v[:, :-k], v[:, k:]) for k in LAGS if n > k}
    last = dict(zip(("fft_period", "fft_power_fraction", "largest_robust_z", "at_fraction"), (*ms.spectrum(v), *ms.outlier(v)), strict=True))
    texts = lambda x: [measured(y) for y in x.tolist()]
    named = lambda m: [" ".join(p) for p in zip(*([f"{k}={y}" for y in texts(x)] for k, x in m.items()), strict=True)]
    lags = [",".join(p) for p in zip(*([f"{k}:{y}" for y in texts(x)] for k, x in acf.items()), strict=True)]
    parts = [[f"w{i}(mean={a},sd={b},slope={c})" for a, b, c in zip(*map(texts, p), strict=True)] for i, p in enumerate(ms.segments(v), 1)]
    single = [f"S1: n={n} {a} raw_acf[{b}] {c}\nS1_eight_windows: {' '.join(p)}" for a, b, c, *p in zip(named(first), lags, named(last), *parts, strict=True)]
    fits = [f"linear_R2={a:.5g} quadratic_R2={b:.5g} quadratic_t2={c:.5g}" if a == a else "unavailable (constant series)" for a, b, c in zip(*(x.tolist() for x in ms.polynomial(v)), strict=True)]
    half = []
    for name, h in zip(("first", "second"), np.array_split(v, 2, axis=1), strict=True):
        found = zip(*(x.tolist() for x in ms.spectrum(h)), strict=True)
        half.append([f"S1_{name}_half: n={h.shape[1]} " + (f"fft_period={p:.5g} power_fraction={s:.5g}" if s else "unavailable (constant or insufficient signal)") for p, s in found])
    return [(s, f"S1_trend_fits: {t}", f"{a}\n{b}") for s, t, a, b in zip(single, fits, *half, strict=True)]


def with_lines(rows: DataFrame, channels: str) -> DataFrame:
    """rows with single, trend, halves: for each channel of the column `channels` (an array of arrays) its measurement texts under the name S1.

    All three are null where a channel has fewer than 8 values, or one that is missing or not finite. Rows are measured
    where they are, those of one length at once; nothing is shuffled.
    """
    names = ("single", "trend", "halves")
    schema = StructType([*rows.schema.fields, *(StructField(k, ArrayType(StringType())) for k in names)])
    place = rows.columns.index(channels)

    def run(parts):
        for part in parts:
            column = part.column(place)
            ends, inner = column.offsets.to_numpy(), column.values
            told = [None] * len(inner)
            values = arrays(inner, 1)
            fine = [i for i, v in enumerate(values) if v is not None and len(v) >= 8 and np.isfinite(v).all()]
            for at, v in ms.by_length([values[i] for i in fine]):
                for i, x in zip(at.tolist(), _said(v), strict=True):
                    told[fine[i]] = x
            of = [None if null else told[a:b] for null, a, b in zip(column.is_null().to_pylist(), ends[:-1], ends[1:], strict=True)]
            whole = [x if x and None not in x else None for x in of]
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([x and [y[k] for y in x] for x in whole], pa.list_(pa.string())) for k in range(3))], schema.names)

    return rows.mapInArrow(run, schema)


def analysis_evidence(s: DataFrame) -> DataFrame:
    """series_id, evidence: values, measurements, trend fits and half spectra of each valid series."""
    g = sr.gathered(s)
    rows = with_lines(g.withColumn("c", F.array("v")), "c").where("single is not null").withColumn("t", formatted_all(F.col("v")))
    text = F.concat_ws("\n", F.concat(F.lit("Time series " + VALUES), F.array_join("t", " ")), F.concat(F.lit(MEASUREMENTS), F.col("single")[0]), F.lit(TREND_TITLE), F.col("trend")[0], F.lit(SPECTRUM_TITLE), F.col("halves")[0])
    return rows.select("series_id", text.alias("evidence"))


def channels(rows: DataFrame, key: str, values: str, stride: Column, names: str = "XYZ") -> DataFrame:
    """series_id (key/name), pos, value: an array dealt to `stride` channels in turn (one channel, S1, where stride is 1)."""
    at = rows.select(key, stride.alias("stride"), F.posexplode(values).alias("i", "value"))
    name = F.when(F.col("stride") == 1, "S1").otherwise(F.substring(F.lit(names), F.pmod("i", "stride") + 1, F.lit(1)))
    return at.select(F.concat_ws("/", F.col(key).cast("string"), name).alias("series_id"), F.expr("i div stride").alias("pos"), F.col("value").cast("double").alias("value"))


def lines(s: DataFrame) -> DataFrame:
    """series_id, single, trend, halves: the measurement texts of series under the name S1, without titles; valid series only."""
    rows = with_lines(sr.gathered(s).select("series_id", F.array("v").alias("c")), "c").where("single is not null")
    return rows.select("series_id", *[F.col(k)[0].alias(k) for k in ("single", "trend", "halves")])


def _renamed(text: Column, name: Column) -> Column:
    """Lines that begin with S1 under another name."""
    return F.regexp_replace(text, F.lit("(?m)^S1(?=[_:])"), name)


def _joined(column: str, sep: str = "\n") -> Column:
    return F.array_join(F.transform("c", lambda x: x[column]), sep)


def source_evidence(rows: DataFrame) -> DataFrame:
    """rows (values, question, shape, ...) with `evidence`: what a source declares, and the measurements of each of its channels.

    shape series: the values and their measurements; axes: readings of X, Y and Z in turn as a table, each axis measured
    as a channel of its own, trend fits and spectra under the axes' names; places: the table alone. Rows of another shape,
    and those with a channel of fewer than 8 values or one that is not finite, have none. No row leaves its task.
    """
    axis = lambda j: F.filter("values", lambda x, i: i % 3 == j)
    dealt = F.when(F.col("shape") == "series", F.array("values")).when(F.col("shape") == "axes", F.array(*map(axis, range(3))))
    told = with_lines(rows.withColumn("__c", F.transform(dealt, lambda c: c.cast("array<double>"))), "__c").withColumn("__t", formatted_all(F.when(F.col("shape").isin("series", "axes", "places"), F.col("values"))))
    names = F.array(*map(F.lit, "XYZ"))
    own = lambda c: F.array_join(F.zip_with(c, names, lambda x, name: _renamed(x, name)), "\n")
    rest = lambda trend, halves: F.concat(F.lit("\n" + TREND_TITLE + "\n"), trend, F.lit("\n" + SPECTRUM_TITLE + "\n"), halves)
    each = F.array_join(F.zip_with("single", names, lambda x, name: F.concat(name, F.lit(" channel:\n"), x)), "\n")
    table = sensor_table(F.col("values"), F.col("question"), F.col("__t"))
    plain = F.concat(F.lit("Time series " + VALUES), F.array_join("__t", " "), F.lit("\n" + MEASUREMENTS), F.col("single")[0], rest(F.col("trend")[0], F.col("halves")[0]))
    text = F.when(F.col("shape") == "series", plain).when(F.col("shape") == "axes", F.concat(table, F.lit(BY_CHANNEL), each, rest(own("trend"), own("halves")))).when(F.col("shape") == "places", table)
    return told.withColumn("evidence", text).drop("__c", "__t", "single", "trend", "halves")


def pair_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """pair, text: the measurements of pairs in one line, with their convention."""
    m = lambda c: measure(F.coalesce(c, F.lit(0.0)))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    p = pair_summary(a, b)
    top = p.select("pair", F.posexplode("top").alias("i", "x")).select("pair", "i", F.concat(F.lit("lag="), F.col("x.lag").cast("string"), F.lit(":r="), m(F.col("x.r"))).alias("t"))
    top = top.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), ", ").alias("shifts"))
    text = F.concat(
        F.lit(PAIR_TITLE + "Pair: corr0="), m(F.col("corr0")), F.lit("; top_shifted_corr=["), F.coalesce("shifts", F.lit("")), F.lit("]; best_diff_corr=lag="), whole("diff_lag"), F.lit(":r="), m(F.col("diff_r")),
        F.lit("; affine_S1_to_S2_R2="), m(F.col("r2")), F.lit("; incremental_prediction_S1_to_S2=gain="), m(F.col("gain12")), F.lit(",lag="), whole("lag12"),
        F.lit("; incremental_prediction_S2_to_S1=gain="), m(F.col("gain21")), F.lit(",lag="), whole("lag21"), F.lit("."),
    )
    return p.join(top, "pair", "left").select("pair", text.alias("text"))


def question_evidence(s: DataFrame) -> DataFrame:
    """id, evidence, series_problem from (id, place, pos, value): one series or two a question (place tells them apart).

    The values of each, their measurements, those of the pair (cut to the length of the shorter one), then trend fits and
    half spectra. More than two series, and one that is short or not finite, are a problem.
    """
    s = s.withColumn("series_id", F.concat_ws("/", F.col("id").cast("string"), F.col("place").cast("string")))
    order = F.dense_rank().over(W.partitionBy("id").orderBy("place"))
    names = s.select("id", "place", "series_id").distinct().withColumn("no", order)
    checked = names.join(validated(s.select("series_id", "pos", "value")), "series_id")
    told = checked.groupBy("id").agg(F.count("*").alias("many"), F.max("problem").alias("bad"))
    told = told.select("id", "many", F.when(F.col("many") > 2, "more than two series").when(F.col("bad").isNotNull(), "invalid series").alias("series_problem"))
    good = told.where("series_problem is null").select("id", "many")
    s = s.join(names.select("series_id", "no"), "series_id").join(good, "id").withColumn("pos", F.row_number().over(W.partitionBy("series_id").orderBy("pos")))
    values = s.select("id", "no", "many", "series_id", "pos", formatted(F.col("value"), ".4g", float("inf")).alias("t")).groupBy("id", "no", "many", "series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("v"))
    name = F.concat(F.lit("S"), F.col("no").cast("string"))
    head = F.concat(F.lit("Time series "), F.when(F.col("many") > 1, F.concat("no", F.lit(" "))).otherwise(""), F.lit(VALUES), F.array_join(F.transform("v", lambda x: x["t"]), " "))
    each = values.join(lines(s.select("series_id", "pos", "value")), "series_id")
    each = each.select("id", "no", head.alias("head"), *[_renamed(F.col(c), name).alias(c) for c in ("single", "trend", "halves")])
    each = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("no", "head", "single", "trend", "halves"))).alias("c"))
    two = s.where("many = 2")
    side = lambda k: two.where(F.col("no") == k).select(F.col("id").alias("pair"), "pos", "value")
    both = pair_text(staged(side(1)), staged(side(2))).select(F.col("pair").alias("id"), F.col("text").alias("pair"))
    text = F.concat(_joined("head"), F.lit("\n" + MEASUREMENTS), F.concat_ws("\n", _joined("single"), "pair"), F.lit("\n" + TREND_TITLE + "\n"), _joined("trend"), F.lit("\n" + SPECTRUM_TITLE + "\n"), _joined("halves"))
    out = each.join(both, "id", "left").select("id", text.alias("evidence"))
    return told.select("id", "series_problem").join(out, "id", "left")
