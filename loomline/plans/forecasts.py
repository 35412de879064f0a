"""Queries of measurements, texts, pools and scores (E, D, G, H) over the hourly and daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import ALLOC, DAILY, FORECASTS, REPAIRED, allocated, query, rounded, scaled_forecasts
from ..functions import series as sr
from ..functions import text as tx
from ..operators import curate, paths, pooling, scoring
from ..sources import fixtures as fx


def pairs(spark, sf):
    return fx.pairs(fx.repaired(spark, sf))


FIRST = "(SELECT min(series_id) FROM rep)"


@query("c14_folds", "WITH h AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders) SELECT o_orderkey, CAST((" + " + ".join(f"{1 if i == 0 else 6} * CAST('0x' || substr(h, {2 * i + 1}, 2) AS BIGINT)" for i in range(8)) + ") % 10 AS BIGINT) AS fold FROM h")
def c14(spark, sf):
    return fx.read(spark, sf, "orders").select("o_orderkey", curate.fold(F.col("o_orderkey").cast("string")).alias("fold"))


@query("e10_predictive_gain", f"WITH {REPAIRED}, b AS (SELECT pos, value AS x FROM rep WHERE series_id = {FIRST}), t AS (SELECT series_id AS pair, pos, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM rep WHERE series_id > {FIRST}), c AS (SELECT pair, k.lag, corr(y, z) AS yz, corr(y, x) AS yx, corr(z, x) AS zx FROM t CROSS JOIN range(1, 33) k(lag) JOIN b ON b.pos = t.pos - k.lag WHERE t.pos >= 32 GROUP BY 1, 2), g AS (SELECT pair, lag, greatest((yx - yz * zx) * (yx - yz * zx) / ((1 - yz * yz) * (1 - zx * zx)), 0) AS gain FROM c) SELECT pair, CAST(lag AS BIGINT) AS lag, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(gain, 9) DESC, lag) AS r FROM g) x WHERE r = 1")
def e10(spark, sf):
    return rounded(sr.predictive_gain(*pairs(spark, sf)))


@query("e11_affine_fit", f"WITH {REPAIRED} SELECT b.series_id AS pair, round(coalesce(corr(a.value, b.value) * corr(a.value, b.value), 0), 6) AS r2 FROM rep a JOIN rep b ON a.pos = b.pos WHERE a.series_id = {FIRST} AND b.series_id > {FIRST} GROUP BY 1")
def e11(spark, sf):
    return rounded(sr.affine_fit(*pairs(spark, sf)))


@query("e13_polynomial", f"WITH {DAILY}, t AS (SELECT series_id, 2.0 * (row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1) / (count(*) OVER (PARTITION BY series_id) - 1) - 1 AS t, value AS y FROM daily), m AS (SELECT series_id, avg(t * t) AS t2 FROM t GROUP BY 1), c AS (SELECT t.series_id, corr(t, y) AS r1, corr(t * t - t2, y) AS r2, regr_slope(y, t * t - t2) / stddev_pop(y) AS curve FROM t JOIN m ON t.series_id = m.series_id GROUP BY 1) SELECT series_id, round(r1 * r1, 6) AS linear_r2, round(r1 * r1 + r2 * r2, 6) AS quadratic_r2, round(curve, 6) AS curve FROM c")
def e13(spark, sf):
    return rounded(sr.polynomial(fx.daily(spark, sf)))


@query("d1_numbers", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN v >= 1e6 THEN format('{:.0f}', v) ELSE format('{:.6g}', v) END AS text FROM (SELECT l_orderkey, l_linenumber, l_extendedprice * l_discount * CASE l_linenumber WHEN 1 THEN 1e-6 WHEN 2 THEN 1e4 WHEN 3 THEN -1e4 WHEN 4 THEN 1e36 ELSE 1.0 END AS v FROM lineitem) x")
def d1(spark, sf):
    v = F.col("l_extendedprice") * F.col("l_discount") * F.when(F.col("l_linenumber") == 1, 1e-6).when(F.col("l_linenumber") == 2, 1e4).when(F.col("l_linenumber") == 3, -1e4).when(F.col("l_linenumber") == 4, 1e36).otherwise(1.0)
    return fx.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), tx.number(v).alias("text"))


def completions(spark, sf):
    """window, stamps, text: each window's future as a completion, after an empty block; the mean model's lacks its last line."""
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).where("model in ('last', 'mean')")
    lines = f.groupBy("window", "model").agg(F.array_sort(F.collect_list(F.struct("step", F.concat(F.lit("t+"), F.col("step")).alias("stamp"), F.round("y", 6).cast("string").alias("text")))).alias("p"))
    lines = lines.withColumn("said", F.when(F.col("model") == "mean", F.slice("p", F.lit(1), F.size("p") - 1)).otherwise(F.col("p")))
    text = F.concat(F.lit("So <forecast></forecast>, or rather\n"), tx.block(F.col("said")))
    return lines.select("window", "model", F.transform("p", lambda x: x["stamp"]).alias("stamps"), text.alias("text"))


@query("d2_d8_d9_parsed", f"WITH {FORECASTS} SELECT series_id || '/' || cutoff AS \"window\", step, round(y, 6) AS value, CAST(NULL AS VARCHAR) AS problem FROM pts UNION ALL SELECT DISTINCT series_id || '/' || cutoff, 0, NULL, 'missing stamp' FROM pts")
def d9(spark, sf):
    got = tx.parsed(completions(spark, sf), "text", "stamps")
    out = got.select("window", "problem", F.posexplode_outer("values").alias("at", "value"))
    return rounded(out.select("window", F.coalesce(F.col("at") + 1, F.lit(0)).cast("long").alias("step"), "value", "problem"))


@query("d10_choices", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE -1 END AS choice FROM conversations")
def d10(spark, sf):
    options = F.array(F.lit("User"), F.lit("Assistant"))
    letter = F.when(F.col("role") == "user", "a) ").when(F.col("role") == "assistant", "b) ").otherwise("z) ")
    said = F.concat(F.lit("I choose "), letter, F.col("role"), F.lit("."))
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(tx.choice(said, options), F.lit(-1)).alias("choice"))


@query("d16_listed", "SELECT l_orderkey, round(sum(l_quantity), 4) AS total, count(*) AS n, 'Is SERIES flat?' AS question FROM lineitem GROUP BY 1")
def d16(spark, sf):
    text = F.concat(F.lit("Is ["), F.array_join(F.collect_list(F.col("l_quantity").cast("string")), ", "), F.lit("] flat?"))
    asked = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(text.alias("text"))
    v = tx.listed(F.col("text"))
    return rounded(asked.select("l_orderkey", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(v).cast("long").alias("n"), tx.unlisted(F.col("text"), "SERIES").alias("question")), 4)


@query("g8_borrowed", f"WITH {FORECASTS}, v AS (SELECT *, q > 0 AS ok FROM (SELECT a.*, min(q) OVER (PARTITION BY win, model, step) AS least FROM atoms a) x), m AS (SELECT win, step, k, avg(CASE WHEN least > 0 THEN q END) AS mean FROM v GROUP BY 1, 2, 3) SELECT v.win AS \"window\", v.model, v.step, v.k AS level, round(CASE WHEN least > 0 THEN q ELSE mean END, 8) AS q FROM v JOIN m ON v.win = m.win AND v.step = m.step AND v.k = m.k WHERE mean IS NOT NULL")
def g8(spark, sf):
    f = fx.baseline_forecasts(fx.repaired(spark, sf))
    return rounded(paths.borrowed(f, F.array_min("q") > 0), 8)


@query("g10_mid_ranks", f"WITH {FORECASTS}, p AS (SELECT win, step, model, round(point, 6) AS v FROM fc) SELECT win AS \"window\", step, model, round((rank() OVER (PARTITION BY win, step ORDER BY v) - 1 + (count(*) OVER (PARTITION BY win, step, v) - 1) / 2.0) / (count(*) OVER (PARTITION BY win, step) - 1), 6) AS place FROM p")
def g10(spark, sf):
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).select("window", "step", "model", F.round(F.col("q")[4], 6).alias("v"))
    return rounded(paths.mid_ranks(f, ["window", "step"], "v").drop("v"))


@query("g20_g21_gated", ALLOC + ", g AS (SELECT a.win, a.step, a.k, sum(l.weight * a.q) / sum(l.weight) AS q FROM atoms a JOIN al l ON a.win = l.win AND a.model = l.model GROUP BY 1, 2, 3) SELECT win AS \"window\", step, k AS level, round(max(q) OVER (PARTITION BY win, step ORDER BY k), 6) AS q FROM g")
def g20(spark, sf):
    return rounded(paths.gated(scaled_forecasts(spark, sf), allocated(spark, sf)))


@query("g41_sample_deciles", "WITH s AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, k AS level, v[1 + CAST(round_even((len(v) - 1) * (k / 10.0), 0) AS INT)] AS q FROM s CROSS JOIN range(1, 10) t(k)")
def g41(spark, sf):
    return paths.sample_deciles(fx.read(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity")


@query("g42_draws", f"WITH {FORECASTS}, u AS (SELECT win, model, step, point, y, d.draw, CAST('0x' || substr(sha256('5' || chr(1) || win || chr(1) || model || chr(1) || step || chr(1) || d.draw), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM fc CROSS JOIN range(5) d(draw)) SELECT win AS \"window\", model, step, CAST(draw AS BIGINT) AS draw, round(point + (greatest(0.1, least(0.9, u)) * 10 - 5) * 0.5, 8) AS value FROM u")
def g42(spark, sf):
    return rounded(paths.draws(fx.baseline_forecasts(fx.repaired(spark, sf)), 5, 5), 8)


@query("h2_coverage", f"WITH {FORECASTS} SELECT series_id AS cell, count(*) AS forecasts, count(DISTINCT win) * 120 AS expected FROM fc GROUP BY 1")
def h2(spark, sf):
    rep = fx.repaired(spark, sf)
    return scoring.coverage(fx.baseline_forecasts(rep).withColumnRenamed("series_id", "cell"), fx.rolling_windows(rep).withColumnRenamed("series_id", "cell"), 120)
