"""Queries of the ensemble: its training table, cross-fitted pools and parents, and the chain from requests to reference (G15, G19, G21, G25-G28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FORECASTS, query, rounded
from ..operators import ensemble as en
from ..operators import features as ft
from ..sources import fixtures as fx
from ..sources.stage import folder
from .texts import asked

CORE, MEMBERS, EXTRAS, FOLDS = ["last", "mean", "seasonal"], ["last", "mean", "recent", "trend"], ["recent", "trend"], 3
KNOWN = ["H"]


def windows(spark, sf):
    """Requests with their futures: the clicks are called daily, which no gate supports; every other window has a long term, for which none is kept."""
    rep = fx.repaired(spark, sf)
    points = fx.baseline_forecasts(rep).where("model = 'last'").groupBy("window", F.col("series_id").alias("source_group")).agg(F.array_sort(F.collect_list(F.struct("step", "y"))).alias("f"))
    rows = asked(spark, sf).select("window", "cutoff", "history").join(points, "window")
    freq = F.when(F.col("source_group") == "click", "D").otherwise("h")
    term = F.when(F.col("cutoff") % 48 == 0, "long").otherwise("short")
    return rows.select("window", "cutoff", "source_group", F.lit("cells").alias("block"), "history", F.transform("f", lambda x: x["y"]).alias("future"), freq.alias("freq"), term.alias("term"), F.array(F.lit(1.0), F.log1p(F.size("history"))).alias("gate_features"))


def forecasts(spark, sf):
    """The baselines; of the third last windows the views lack the mean, all others the trend."""
    f, third = fx.baseline_forecasts(fx.repaired(spark, sf)), F.col("cutoff") % 72 == 0
    lost = F.when(F.col("series_id") == "view", "mean").otherwise("trend")
    return f.where(~(third & (F.col("model") == lost))).select("window", "model", "step", "q")


def gates(spark, sf):
    """A linear gate for hours and short terms over the members, by the number of events of a type."""
    e = fx.read(spark, sf, "events").select(F.lit("H|short").alias("bucket")).distinct()
    j = F.col("position")
    return e.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(len(MEMBERS) - 1))).alias("position")).select("bucket", "position", (0.1 * j).alias("bias"), F.array(F.lit(0.0), 0.01 * j).alias("coefficients"))


def table(spark, sf):
    return en.training_table(windows(spark, sf), forecasts(spark, sf), CORE, MEMBERS, FOLDS)


def known_scores(rows):
    """Scores of four routers that the ranks give: what fitted ones would say, but for SQL to follow."""
    routers = F.sequence(F.lit(0), F.lit(FOLDS))
    return rows.where("keep").select("window", F.transform(routers, lambda r: F.transform("ranks", lambda x: F.log1p((x + r) % 3))).alias("scores"))


TABLE = FORECASTS + """, held AS (SELECT * FROM atoms WHERE NOT (cutoff % 72 = 0 AND model = CASE WHEN series_id = 'view' THEN 'mean' ELSE 'trend' END)),
tw AS (SELECT w.series_id || '/' || w.cutoff AS win, w.series_id, w.cutoff, greatest(max(abs(r.value)), 1) AS mag, NOT (w.series_id = 'view' AND w.cutoff % 72 = 0) AS keep, CASE WHEN w.series_id = 'click' THEN 1 ELSE 24 END AS season,
 CASE WHEN w.series_id = 'click' THEN 'D' ELSE 'H' END || '|' || CASE WHEN w.cutoff % 48 = 0 THEN 'long' ELSE 'short' END AS bucket, (""" + " + ".join(f"CAST('0x' || substr(sha256(w.series_id), {2 * i + 1}, 2) AS BIGINT)" for i in range(8)) + f""") % {FOLDS} AS fold FROM win w JOIN rep r ON r.series_id = w.series_id AND r.pos < w.cutoff GROUP BY 1, 2, 3),
sc AS (SELECT t.win, avg(abs(a.value - b.value)) / min(t.mag) AS scale FROM tw t JOIN rep a ON a.series_id = t.series_id AND a.pos < t.cutoff JOIN rep b ON b.series_id = t.series_id AND b.pos = a.pos - t.season GROUP BY 1),
kn AS (SELECT i, CAST(round_even(i * 23 / 7.0, 0) AS BIGINT) AS knot FROM range(8) t(i)),
kw AS (SELECT i, count(*) AS weight FROM (SELECT t, min_by(i, abs(knot - t) * 100 + i) AS i FROM kn CROSS JOIN range(24) s(t) GROUP BY 1) x GROUP BY 1),
ka AS (SELECT h.win, h.model, k.i, h.k, h.q / t.mag AS q, h.y / t.mag AS y FROM held h JOIN kn k ON h.step = k.knot + 1 JOIN tw t ON t.win = h.win),
rk AS (SELECT win, model, row_number() OVER (PARTITION BY win ORDER BY risk, model) - 1 AS rank FROM (SELECT a.win, a.model, round(greatest(avg(abs(a.q - a.y)) - sum(a.q * (2 * a.k - 10) / 81.0) / 8, 0) / greatest(min(s.scale), 1e-6), 9) AS risk FROM ka a JOIN sc s ON s.win = a.win JOIN tw t ON t.win = a.win AND t.keep WHERE a.model IN ('last', 'mean', 'seasonal') GROUP BY 1, 2) x)"""


@query("g25_training_table", f"""WITH {TABLE}
SELECT t.win AS "window", t.fold, t.keep, t.bucket, a.model, a.i AS knot, CASE WHEN t.keep THEN round(t.mag, 6) END AS magnitude, CAST(r.rank AS BIGINT) AS rank, CASE WHEN a.i IS NOT NULL THEN kw.weight END AS weight, round(a.y, 8) AS target, round(a.q, 8) AS median
FROM tw t LEFT JOIN (SELECT * FROM ka WHERE k = 5 AND model IN ('last', 'mean', 'seasonal')) a ON a.win = t.win AND t.keep LEFT JOIN rk r ON r.win = a.win AND r.model = a.model LEFT JOIN kw ON kw.i = a.i""")
def g25(spark, sf):
    """The table is written by fold and read back; a window with a failed core forecast is not kept."""
    stored = en.store_table(table(spark, sf), folder(spark))
    each = stored.select("*", F.posexplode_outer("core").alias("m", "q")).select("*", F.posexplode_outer("q").alias("knot", "deciles"))
    own = lambda c: F.get(c, F.col("knot"))
    out = each.select("window", "fold", "keep", "bucket", F.get(F.array(*map(F.lit, CORE)), F.col("m")).alias("model"), F.col("knot").cast("long").alias("knot"), F.round("magnitude", 6).alias("magnitude"), F.get("ranks", F.col("m")).cast("long").alias("rank"), own(F.col("knot_weight")).cast("long").alias("weight"), own(F.col("target")).alias("target"), F.col("deciles")[4].alias("median"))
    return rounded(out, 8)


POOLS = TABLE + f""", rs AS (SELECT win, model, r.r, ln(1 + (rank + r.r) % 3) AS s FROM rk CROSS JOIN range({FOLDS + 1}) r(r)),
rw AS (SELECT win, model, r, e / sum(e) OVER (PARTITION BY win, r) AS weight FROM (SELECT win, model, r, exp(-(s - avg(s) OVER p) / greatest(stddev_pop(s) OVER p, 0.15) / 1.35) AS e FROM rs WINDOW p AS (PARTITION BY win, r)) x),
cu AS (SELECT a.win, w.r, a.i, a.q, round(sum(w.weight / 9.0) OVER (PARTITION BY a.win, w.r, a.i ORDER BY a.q, a.model, a.k ROWS UNBOUNDED PRECEDING), 12) AS cum FROM ka a JOIN rw w ON w.win = a.win AND w.model = a.model),
pl AS (SELECT win, r, i, l.k, min(CASE WHEN cum >= l.k / 10.0 THEN q END) AS q FROM cu CROSS JOIN range(1, 10) l(k) GROUP BY 1, 2, 3, 4),
gw AS (SELECT win, j, e / sum(e) OVER (PARTITION BY win) AS weight FROM (SELECT win, j, exp(0.1 * j + 0.01 * j * ln(1 + cutoff)) AS e FROM tw CROSS JOIN range(4) m(j) WHERE bucket = 'H|short') x),
full_ AS (SELECT win FROM held GROUP BY 1 HAVING count(DISTINCT model) = 5),
gs AS (SELECT a.win, a.i, a.k, sum(g.weight * a.q) AS q FROM ka a JOIN gw g ON g.win = a.win AND (['last', 'mean', 'recent', 'trend'])[g.j + 1] = a.model JOIN full_ f ON f.win = a.win GROUP BY 1, 2, 3),
gt AS (SELECT win, i, k, max(q) OVER (PARTITION BY win, i ORDER BY k) AS q FROM gs),
mv AS (SELECT p.win, p.r, greatest(0, least(1, (y.y - p.q) / (g.q - p.q))) AS root, abs(g.q - p.q) * w.weight AS mass FROM pl p JOIN gt g ON g.win = p.win AND g.i = p.i AND g.k = 5 JOIN (SELECT DISTINCT win, i, y FROM ka) y ON y.win = p.win AND y.i = p.i JOIN kw w ON w.i = p.i WHERE p.k = 5 AND g.q <> p.q),
mc AS (SELECT win, r, root, sum(mass) OVER (PARTITION BY win, r ORDER BY root RANGE UNBOUNDED PRECEDING) AS cum, sum(mass) OVER (PARTITION BY win, r) AS total FROM mv),
op AS (SELECT win, r, (min(CASE WHEN cum >= total / 2 THEN root END) + coalesce(min(CASE WHEN cum > total / 2 THEN root END), max(root))) / 2 AS optimum FROM mc GROUP BY 1, 2),
ms AS (SELECT o.r, avg(o.optimum) AS mass FROM op o JOIN tw t ON t.win = o.win WHERE o.r = 0 OR t.fold <> o.r - 1 GROUP BY 1)"""


def pooled(spark, sf):
    rows = table(spark, sf)
    return en.pooled_table(rows, known_scores(rows), gates(spark, sf), KNOWN)


@query("g21_g26_pools", f'WITH {POOLS} SELECT p.win AS "window", p.r AS router, p.i AS knot, p.k AS level, round(p.q, 8) AS pool, round(g.q, 8) AS gated FROM pl p LEFT JOIN gt g ON g.win = p.win AND g.i = p.i AND g.k = p.k')
def g26_pools(spark, sf):
    """Pools of the full and of each fold's router, and the bucket's gate; null where the bucket has none or a member is missing."""
    p = pooled(spark, sf).select("window", "gated", F.posexplode("pools").alias("router", "pool")).select("window", "gated", "router", F.posexplode("pool").alias("knot", "q"))
    p = p.select("window", "router", "knot", F.get("gated", F.col("knot")).alias("g"), F.posexplode("q").alias("level", "pool"))
    return rounded(p.select("window", F.col("router").cast("long").alias("router"), F.col("knot").cast("long").alias("knot"), (F.col("level") + 1).cast("long").alias("level"), "pool", F.get("g", F.col("level")).alias("gated")), 8)


@query("g27_masses", f"WITH {POOLS} SELECT r AS router, round(mass, 6) AS mass FROM ms")
def g27_masses(spark, sf):
    return rounded(en.masses(pooled(spark, sf)).withColumn("router", F.col("router").cast("long")))


@query("g27_parents", f"""WITH {POOLS}, pb AS (SELECT p.win, p.i, p.k, p.q AS pool, coalesce((1 - m.mass) * p.q + m.mass * g.q, p.q) * t.mag AS parent, m.mass, t.mag, t.fold FROM pl p JOIN tw t ON t.win = p.win AND p.r = t.fold + 1 JOIN ms m ON m.r = p.r LEFT JOIN gt g ON g.win = p.win AND g.i = p.i AND g.k = p.k)
SELECT b.win AS "window", b.fold, round(b.mass, 5) AS mass, b.i AS knot, b.k AS level, round(b.parent, 5) AS parent, round(coalesce(a.q, b.pool) * b.mag, 5) AS trend, round(s.q * b.mag, 5) AS seasonal, round(s.y * b.mag, 5) AS target
FROM pb b LEFT JOIN ka a ON a.win = b.win AND a.i = b.i AND a.k = b.k AND a.model = 'trend' JOIN ka s ON s.win = b.win AND s.i = b.i AND s.k = b.k AND s.model = 'seasonal'""")
def g27_parents(spark, sf):
    """Each fold's own mass and pool; the trend is the last candidate, or the pool where it failed."""
    rows = pooled(spark, sf)
    out = en.parents(rows, en.masses(rows), [2, 3])
    each = out.select("*", F.posexplode("parent").alias("knot", "s")).select("*", F.posexplode("s").alias("at", "value"))
    of = lambda c: F.get(F.get(F.get("candidates", F.lit(c)), F.col("knot")), F.col("at"))
    each = each.select("window", "fold", "mass", F.col("knot").cast("long").alias("knot"), (F.col("at") + 1).cast("long").alias("level"), F.col("value").alias("parent"), of(4).alias("trend"), of(2).alias("seasonal"), F.get("target", F.col("knot")).alias("target"))
    return rounded(each, 5)


@query("g14_g15_g26_cross_fitted")
def g26(spark, sf):
    """Routers fitted on all kept windows and without each fold, scored in one pass: the pooled medians of each at the knots."""
    stored = en.store_table(table(spark, sf), folder(spark))
    routers = en.fitted_routers(stored, len(CORE), FOLDS, trees=3, depth=3)
    rows = en.pooled_table(stored, en.cross_scores(stored, routers, len(CORE)), gates(spark, sf), KNOWN)
    each = rows.select("window", "fold", F.posexplode("pools").alias("router", "pool")).select("window", "fold", "router", F.posexplode("pool").alias("knot", "q"))
    return rounded(each.select("window", "fold", F.col("router").cast("long").alias("router"), F.col("knot").cast("long").alias("knot"), F.col("q")[4].alias("median")), 8)


CHAIN = TABLE + """, whole AS (SELECT win, model, step, k, q FROM held),
core AS (SELECT win, model, step, k, q FROM whole WHERE model IN ('last', 'mean', 'seasonal') UNION ALL SELECT win, 'mean', step, k, avg(q) FROM whole WHERE model IN ('last', 'seasonal') AND win IN (SELECT win FROM tw WHERE NOT keep) GROUP BY ALL),
av AS (SELECT win, model, round(avg(q), 9) AS m FROM core WHERE k = 5 GROUP BY 1, 2),
sr AS (SELECT win, model, (rank() OVER (PARTITION BY win ORDER BY m) - 1 + (count(*) OVER (PARTITION BY win, m) - 1) / 2.0) / 2 AS s FROM av),
sw AS (SELECT win, model, e / sum(e) OVER (PARTITION BY win) AS weight FROM (SELECT win, model, exp(-(s - avg(s) OVER p) / greatest(stddev_pop(s) OVER p, 0.15) / 1.35) AS e FROM sr WINDOW p AS (PARTITION BY win)) x),
cc AS (SELECT c.win, c.step, c.q, round(sum(w.weight / 9.0) OVER (PARTITION BY c.win, c.step ORDER BY c.q, c.model, c.k ROWS UNBOUNDED PRECEDING), 12) AS cum FROM core c JOIN sw w ON w.win = c.win AND w.model = c.model),
pool AS (SELECT win, step, l.k, min(CASE WHEN cum >= l.k / 10.0 THEN q END) AS q FROM cc CROSS JOIN range(1, 10) l(k) GROUP BY 1, 2, 3),
gl AS (SELECT win, j, exp(0.1 * j + 0.01 * j * ln(1 + cutoff)) AS e FROM tw CROSS JOIN range(4) m(j) WHERE bucket = 'H|short' AND win IN (SELECT win FROM held GROUP BY 1 HAVING count(DISTINCT model) = 5)),
ga AS (SELECT h.win, h.step, h.k, sum(g.e * h.q) / sum(g.e) AS q FROM held h JOIN gl g ON g.win = h.win AND (['last', 'mean', 'recent', 'trend'])[g.j + 1] = h.model GROUP BY 1, 2, 3),
gr AS (SELECT win, step, k, max(q) OVER (PARTITION BY win, step ORDER BY k) AS q FROM ga UNION ALL SELECT win, step, k, max(CASE WHEN k % 4 = 0 THEN q - 3 ELSE q + 1 END) OVER (PARTITION BY win, step ORDER BY k) FROM held WHERE model = 'recent' AND cutoff % 48 = 0)"""


@query("g28_components", f"""WITH {CHAIN} SELECT p.win AS "window", p.step, p.k AS level, round(p.q, 8) AS pool, round(g.q, 8) AS gated, round(coalesce((2 * p.q + g.q) / 3.0, p.q), 8) AS reference, round(m.q, 8) AS mean, round(coalesce(t.q, p.q), 8) AS trend
FROM pool p LEFT JOIN gr g ON g.win = p.win AND g.step = p.step AND g.k = p.k JOIN core m ON m.win = p.win AND m.step = p.step AND m.k = p.k AND m.model = 'mean' LEFT JOIN held t ON t.win = p.win AND t.step = p.step AND t.k = p.k AND t.model = 'trend'""")
def g28(spark, sf):
    """Scores are the mid-ranks of the medians' means, which are among the router's features; long terms bring a forecast of their own, whose deciles fall at every fourth level."""
    rows = windows(spark, sf).withColumn("horizon", F.size("future"))
    own = fx.baseline_forecasts(fx.repaired(spark, sf)).where("model = 'recent' and cutoff % 48 = 0")
    own = own.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("step", "q"))).alias("s"))
    ready = F.transform("s", lambda x: F.transform(x["q"], lambda v, i: F.when((i + 1) % 4 == 0, v - 3).otherwise(v + 1)))
    place = F.array(*[F.col("features")[ft.GLOBAL + ft.LOCAL * m + 18] for m in range(len(CORE))])
    score = lambda r: r.select("window", place.alias("scores"))
    out = en.components(rows.join(own.select("window", ready.alias("ready")), "window", "left"), forecasts(spark, sf), CORE, EXTRAS, MEMBERS, score, gates(spark, sf), KNOWN, 1 / 3)
    each = out.select("*", F.posexplode("pool").alias("t", "s")).select("*", F.posexplode("s").alias("at", "value"))
    of = lambda c: F.get(F.get(c, F.col("t")), F.col("at"))
    candidate = lambda k: of(F.get("candidates", F.lit(k)))
    return rounded(each.select("window", (F.col("t") + 1).cast("long").alias("step"), (F.col("at") + 1).cast("long").alias("level"), F.col("value").alias("pool"), of(F.col("gated")).alias("gated"), of(F.col("reference")).alias("reference"), candidate(1).alias("mean"), candidate(4).alias("trend")), 8)
