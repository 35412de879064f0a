"""All registered queries of the time-series engine and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import frequency as fq
from .functions import series as sr
from .operators import curate, pooling, scoring
from .sources import fixtures as fx

QUERIES: dict = {}
SQL: dict = {}

HOURLY = """cal AS (SELECT e.series_id, CAST(t.i AS BIGINT) AS pos FROM (SELECT DISTINCT event_type AS series_id FROM events) e CROSS JOIN range(720) t(i)),
sums AS (SELECT event_type AS series_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 3600) AS BIGINT) AS pos, round(sum(value), 4) AS value FROM events GROUP BY 1, 2),
hourly AS (SELECT c.series_id, c.pos, s.value FROM cal c LEFT JOIN sums s ON c.series_id = s.series_id AND c.pos = s.pos)"""
REPAIRED = HOURLY + """, near AS (SELECT h.series_id, h.pos, max(a.pos) AS p0 FROM hourly h LEFT JOIN sums a ON a.series_id = h.series_id AND a.pos <= h.pos GROUP BY 1, 2),
far AS (SELECT h.series_id, h.pos, min(a.pos) AS p1 FROM hourly h LEFT JOIN sums a ON a.series_id = h.series_id AND a.pos >= h.pos AND a.pos < 720 GROUP BY 1, 2),
rep AS (SELECT n.series_id, n.pos, CASE WHEN n.p0 IS NULL THEN b.value WHEN f.p1 IS NULL OR n.p0 = f.p1 THEN a.value ELSE a.value + (b.value - a.value) * (n.pos - n.p0) / (f.p1 - n.p0) END AS value
 FROM near n JOIN far f ON n.series_id = f.series_id AND n.pos = f.pos LEFT JOIN sums a ON a.series_id = n.series_id AND a.pos = n.p0 LEFT JOIN sums b ON b.series_id = n.series_id AND b.pos = f.p1)"""
DAILY = "daily AS (SELECT l_returnflag AS series_id, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS pos, round(sum(l_quantity), 4) AS value FROM lineitem GROUP BY 1, 2)"
FORECASTS = REPAIRED + """, len AS (SELECT series_id, count(*) AS n FROM rep GROUP BY 1), win AS (SELECT series_id, n - lag * 24 AS cutoff FROM len CROSS JOIN (VALUES (1), (2), (3)) l(lag) WHERE n - lag * 24 >= 4),
steps AS (SELECT w.series_id, w.cutoff, CAST(t.i AS BIGINT) AS step FROM win w CROSS JOIN range(1, 25) t(i)),
means AS (SELECT w.series_id, w.cutoff, avg(r.value) AS mean, avg(CASE WHEN r.pos >= w.cutoff - 24 THEN r.value END) AS recent, max(CASE WHEN r.pos = w.cutoff - 1 THEN r.value END) AS last, regr_slope(CASE WHEN r.pos >= w.cutoff - 64 THEN r.value END, r.pos) AS slope FROM win w JOIN rep r ON r.series_id = w.series_id AND r.pos < w.cutoff GROUP BY 1, 2),
pts AS (SELECT s.series_id, s.cutoff, s.step, y.value AS y, m.last, m.mean, z.value AS seasonal, m.recent, m.last + m.slope * s.step AS trend FROM steps s JOIN means m ON s.series_id = m.series_id AND s.cutoff = m.cutoff
 JOIN rep y ON y.series_id = s.series_id AND y.pos = s.cutoff + s.step - 1 JOIN rep z ON z.series_id = s.series_id AND z.pos = s.cutoff - 24 + s.step - 1),
fc AS (SELECT series_id || '/' || cutoff AS win, series_id, cutoff, step, y, 'last' AS model, last AS point FROM pts UNION ALL SELECT series_id || '/' || cutoff, series_id, cutoff, step, y, 'mean', mean FROM pts
 UNION ALL SELECT series_id || '/' || cutoff, series_id, cutoff, step, y, 'seasonal', seasonal FROM pts UNION ALL SELECT series_id || '/' || cutoff, series_id, cutoff, step, y, 'recent', recent FROM pts UNION ALL SELECT series_id || '/' || cutoff, series_id, cutoff, step, y, 'trend', trend FROM pts),
scales AS (SELECT series_id, avg(abs(d)) AS scale FROM (SELECT a.series_id, a.value - b.value AS d FROM rep a JOIN rep b ON a.series_id = b.series_id AND b.pos = a.pos - 24) x GROUP BY 1),
atoms AS (SELECT f.*, l.k, f.point + (l.k - 5) * 0.5 AS q FROM fc f CROSS JOIN range(1, 10) l(k))"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def scaled_forecasts(spark, sf):
    rep = fx.repaired(spark, sf)
    return fx.baseline_forecasts(rep).join(sr.seasonal_scale(rep, 24), "series_id")


MASE_CRPS = f"""WITH {FORECASTS}, m AS (SELECT f.series_id, f.model, avg(abs(f.point - f.y) / nullif(s.scale, 0)) AS mase, sum(abs(f.y)) AS level FROM fc f JOIN scales s ON f.series_id = s.series_id GROUP BY 1, 2),
c AS (SELECT series_id, model, sum(2 * greatest(k / 10.0 * (y - q), (k / 10.0 - 1) * (y - q))) AS loss FROM atoms GROUP BY 1, 2)
SELECT m.series_id, m.model, round(m.mase, 6) AS mase, round(c.loss / 9 / greatest(m.level, 1e-8), 6) AS crps FROM m JOIN c ON m.series_id = c.series_id AND m.model = c.model"""


@query("flagship_rolling_scores", MASE_CRPS)
def flagship(spark, sf):
    return rounded(scoring.cell_scores(scaled_forecasts(spark, sf), ["series_id", "model"]))


@query("a3_contiguous_shard", "WITH p AS (SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS position, count(*) OVER () AS n FROM orders) SELECT o_orderkey, position FROM p WHERE position >= n * 1 // 4 AND position < n * 2 // 4")
def a3(spark, sf):
    return curate.contiguous_shard(fx.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1, 4)


@query("b2_repair", f"WITH {REPAIRED} SELECT series_id, pos, round(value, 6) AS value FROM rep")
def b2(spark, sf):
    return rounded(fx.repaired(spark, sf).select("series_id", "pos", "value"))


UNITS = ["h", "min", "D", "W", "ME", "QS", "Y", "S", "B", "T", "X", "W-SUN", "QE-DEC", "MS", "hourly", "monthly", "YE-DEC", "H", "q", "??"]
FREQS = "(SELECT DISTINCT (o_orderkey % 7 + 1) || ([" + ", ".join(f"'{u}'" for u in UNITS) + f"])[o_orderkey % {len(UNITS)} + 1] AS freq FROM orders) f"
#: What each unit is, written out.
UNIT_TABLE = "(VALUES " + ", ".join(
    f"('{u}', {r}, {c}, {s}, '{f}')"
    for u, r, c, s, f in [
        ("h", "'hour'", "'H'", 24, "hour"), ("min", "'minute'", "'T'", 1440, "minute"), ("D", "'day'", "'D'", 1, "day"), ("W", "'week'", "'W'", 1, "week"), ("ME", "'month'", "'M'", 12, "month"),
        ("QS", "NULL", "'QS'", 4, "quarter"), ("Y", "'year'", "'A'", 1, "year"), ("S", "'second'", "'S'", 3600, "other"), ("B", "NULL", "'B'", 5, "day"), ("T", "'minute'", "'T'", 1440, "minute"),
        ("X", "NULL", "'X'", 1, "other"), ("W-SUN", "'week'", "'W-SUN'", 1, "week"), ("QE-DEC", "'quarter'", "'Q-DEC'", 4, "quarter"), ("MS", "NULL", "'M'", 12, "month"), ("hourly", "NULL", "'HOURLY'", 24, "hour"),
        ("monthly", "NULL", "'MONTHLY'", 12, "month"), ("YE-DEC", "'year'", "'A-DEC'", 1, "year"), ("H", "'hour'", "'H'", 24, "hour"), ("q", "'quarter'", "'Q'", 4, "quarter"), ("??", "NULL", "NULL", "NULL", "other"),
    ]
) + ") u(unit, regime, short, season, family)"
FREQ_ROWS = f"SELECT f.freq, CAST(substr(freq, 1, 1) AS BIGINT) AS k, u.* FROM {FREQS} JOIN {UNIT_TABLE} ON substr(f.freq, 2) = u.unit"


def frequencies(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("o_orderkey") % len(UNITS) + 1).cast("int"))
    return fx.read(spark, sf, "orders").select(F.concat((F.col("o_orderkey") % 7 + 1).cast("string"), unit).alias("freq")).distinct()


@query("b4_b5_frequencies", f"SELECT freq, regime, CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END || short AS canonical FROM ({FREQ_ROWS}) x")
def b4(spark, sf):
    f = F.col("freq")
    return frequencies(spark, sf).select("freq", fq.regime(f).alias("regime"), fq.canonical(f).alias("canonical"))


@query("b7_seasonality", f"SELECT freq, CAST(CASE WHEN season % k = 0 THEN season // k ELSE 1 END AS BIGINT) AS season FROM ({FREQ_ROWS}) x WHERE season IS NOT NULL")
def b7(spark, sf):
    return frequencies(spark, sf).select("freq", fq.seasonality(F.col("freq")).alias("season")).where("season is not null")


@query("b6_b8_names", f"SELECT freq, CASE WHEN freq LIKE '%min' OR freq LIKE '%T' THEN 'minute' ELSE 'other' END AS numbered, family, CASE unit WHEN 'Y' THEN 'A' WHEN 'h' THEN 'H' WHEN 'min' THEN 'T' WHEN 'ME' THEN 'M' WHEN 'W-SUN' THEN 'W' WHEN 'QE-DEC' THEN 'Q' WHEN 'YE-DEC' THEN 'A' ELSE unit END AS board, 'X/y' AS named FROM ({FREQ_ROWS}) x")
def b6(spark, sf):
    unit = F.substring("freq", 2, 20)
    return frequencies(spark, sf).select("freq", fq.family(F.col("freq")).alias("numbered"), fq.family(unit).alias("family"), fq.board_name(F.lit("demo"), unit).alias("board"), fq.board_name(F.lit("demo/X/y"), unit).alias("named"))


@query("b20_supported", f"SELECT freq, term, coalesce(CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END || string_split(short, '-')[1] IN ('H', '5T', 'D', 'W') AND (term = 'short' OR CASE WHEN k = 1 THEN '' ELSE CAST(k AS VARCHAR) END || short IN ('H', '5T')), false) AS supported FROM ({FREQ_ROWS}) x CROSS JOIN (VALUES ('short'), ('medium'), ('long')) t(term)")
def b20(spark, sf):
    rows = frequencies(spark, sf).withColumn("term", F.explode(F.array(*map(F.lit, ("short", "medium", "long")))))
    return rows.withColumn("supported", F.coalesce(fq.supported(F.col("freq"), F.col("term"), ["H", "5T", "D", "W-SUN"]), F.lit(False)))


@query("b9_term_horizons", f"WITH b AS (SELECT freq, CASE regime WHEN 'year' THEN 6 WHEN 'quarter' THEN 8 WHEN 'month' THEN 12 WHEN 'week' THEN 8 WHEN 'day' THEN 30 WHEN 'hour' THEN 48 WHEN 'minute' THEN 48 WHEN 'second' THEN 60 END AS h FROM ({FREQ_ROWS}) x) SELECT freq, term, CAST(h * k AS BIGINT) AS horizon FROM b CROSS JOIN (VALUES ('short', 1), ('medium', 10), ('long', 15)) t(term, k) WHERE h * k <= 900")
def b9(spark, sf):
    return fq.term_horizons(frequencies(spark, sf))


@query("b10_finite_runs", f"WITH {HOURLY}, g AS (SELECT series_id, pos, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS g FROM hourly WHERE value IS NOT NULL), r AS (SELECT series_id, g, min(pos) AS start, count(*) AS length FROM g GROUP BY 1, 2 HAVING count(*) >= 12) SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY start) - 1 AS BIGINT) AS run, start, length FROM r")
def b10(spark, sf):
    return sr.finite_runs(fx.hourly(spark, sf))


@query("b12_seasonal_scale", f"WITH {FORECASTS} SELECT series_id, round(scale, 6) AS scale FROM scales")
def b12(spark, sf):
    return rounded(sr.seasonal_scale(fx.repaired(spark, sf), 24))


@query("b13_magnitude_scaled", f"WITH {DAILY}, m AS (SELECT series_id, greatest(max(abs(value)), 1.0) AS magnitude FROM daily GROUP BY 1) SELECT d.series_id, d.pos, round(d.value / m.magnitude, 6) AS scaled FROM daily d JOIN m ON d.series_id = m.series_id")
def b13(spark, sf):
    return rounded(sr.magnitude_scaled(fx.daily(spark, sf)).select("series_id", "pos", "scaled"))


@query("c4_rolling_windows", f"WITH {FORECASTS} SELECT series_id, CAST(cutoff AS BIGINT) AS cutoff FROM win")
def c4(spark, sf):
    return fx.rolling_windows(fx.repaired(spark, sf))


@query("c5_excluded", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def c5(spark, sf):
    held = fx.read(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return curate.excluded(fx.read(spark, sf, "orders").select("o_orderkey"), held, ["o_orderkey"])


@query("c9_first_of_digest", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def c9(spark, sf):
    return curate.first_of(fx.read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("c10_interleaved", "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('7' || chr(1) || o_orderkey), o_orderkey) AS depth FROM orders")
def c10(spark, sf):
    return curate.interleaved(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], 7, "o_orderkey")


@query("c12_capped", "SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('3' || chr(1) || o_orderkey), o_orderkey) AS rank FROM orders) x WHERE rank <= 2")
def c12(spark, sf):
    return curate.capped(fx.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], 2, 3, "o_orderkey")


@query("c28_label_vocabulary", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label FROM orders")
def c28(spark, sf):
    # distinct labels are ranked (as many as there are labels), then joined back: no window over all rows
    orders = fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    labels = curate_labels(orders.select("o_orderpriority").distinct())
    return orders.join(labels, "o_orderpriority").select("o_orderkey", "label")


def curate_labels(labels):
    from pyspark.sql import Window as W

    return labels.withColumn("label", (F.row_number().over(W.orderBy("o_orderpriority")) - 1).cast("long"))


@query("e1_summary", f"WITH {DAILY} SELECT series_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, min(value) AS least, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90, max(value) AS most FROM daily GROUP BY 1")
def e1(spark, sf):
    return rounded(sr.summary(fx.daily(spark, sf)))


@query("e2_e5_slope", f"WITH {DAILY}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS t FROM daily) SELECT series_id, round(coalesce(covar_pop(t, value) / nullif(var_pop(t), 0), 0), 6) AS slope, round(stddev_pop(d), 6) AS diff_sd FROM d GROUP BY 1")
def e2(spark, sf):
    return rounded(sr.slope(fx.daily(spark, sf)))


@query("e4_autocorrelation", f"WITH {REPAIRED}, " + "l AS (SELECT *, " + ", ".join(f"lag(value, {k}) OVER (PARTITION BY series_id ORDER BY pos) AS l{k}" for k in (1, 2, 4, 8, 16, 32)) + " FROM rep) SELECT series_id, " + ", ".join(f"round(coalesce(corr(value, l{k}), 0), 6) AS acf{k}" for k in (1, 2, 4, 8, 16, 32)) + ", round(coalesce(corr(value - l1, l1 - l2), 0), 6) AS diff_acf1 FROM l GROUP BY 1")
def e4(spark, sf):
    return rounded(sr.autocorrelation(fx.repaired(spark, sf)))


@query("e7_outlier", f"WITH {DAILY}, m AS (SELECT series_id, median(value) AS med, stddev_pop(value) AS sd, count(*) AS n FROM daily GROUP BY 1), d AS (SELECT d.series_id, row_number() OVER (PARTITION BY d.series_id ORDER BY d.pos) - 1 AS pos, abs(d.value - m.med) AS dev, m.sd, m.n FROM daily d JOIN m ON d.series_id = m.series_id), a AS (SELECT series_id, median(dev) AS mad, max(dev) AS top, min(sd) AS sd, min(n) AS n FROM d GROUP BY 1), f AS (SELECT d.series_id, min(d.pos) AS pos FROM d JOIN a ON d.series_id = a.series_id AND d.dev = a.top GROUP BY 1) SELECT a.series_id, round(coalesce(a.top / nullif(CASE WHEN mad > 1e-12 THEN 1.4826 * mad ELSE greatest(sd, 1e-12) END, 0), 0), 6) AS score, round(f.pos / greatest(a.n - 1, 1), 6) AS place FROM a JOIN f ON a.series_id = f.series_id")
def e7(spark, sf):
    return rounded(sr.outlier(fx.daily(spark, sf)))


@query("e8_segments", f"WITH {DAILY}, s AS (SELECT *, ntile(8) OVER (PARTITION BY series_id ORDER BY pos) AS segment, row_number() OVER (PARTITION BY series_id ORDER BY pos) AS t FROM daily) SELECT series_id, CAST(segment AS BIGINT) AS segment, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS sd, round(coalesce(covar_pop(t, value) / nullif(var_pop(t), 0), 0), 6) AS slope FROM s GROUP BY 1, 2")
def e8(spark, sf):
    return rounded(sr.segments(fx.daily(spark, sf)))


DFT = "z AS (SELECT g.series_id, g.t, g.n, g.value - (r.a + r.b * g.t) AS v FROM g JOIN (SELECT series_id, regr_intercept(value, t) AS a, regr_slope(value, t) AS b FROM g GROUP BY 1) r ON g.series_id = r.series_id), p AS (SELECT series_id, k.k, max(n) AS n, pow(sum(v * cos(2 * pi() * k.k * t / n)), 2) + pow(sum(v * sin(2 * pi() * k.k * t / n)), 2) AS power FROM z CROSS JOIN range(1, 2000) k(k) WHERE k.k <= n // 2 GROUP BY 1, 2), q AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY power DESC, k) AS r, sum(power) OVER (PARTITION BY series_id) AS total FROM p)"


@query("e6_dominant_period", f"WITH {REPAIRED}, g AS (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY pos) - 1 AS t, count(*) OVER (PARTITION BY series_id) AS n FROM rep), {DFT} SELECT series_id, round(n / CAST(k AS DOUBLE), 6) AS period, round(power / total, 6) AS share FROM q WHERE r = 1")
def e6(spark, sf):
    return rounded(sr.dominant_period(fx.repaired(spark, sf)))


@query("e9_lead_lag", f"WITH {REPAIRED}, p AS (SELECT b.series_id AS pair, CAST(k.lag AS BIGINT) AS lag, count(*) AS n, corr(a.value, b.value) AS r FROM rep a JOIN rep b ON b.series_id > a.series_id AND a.series_id = (SELECT min(series_id) FROM rep) CROSS JOIN range(-128, 129) k(lag) WHERE b.pos = a.pos + k.lag GROUP BY 1, 2), r AS (SELECT pair, lag, coalesce(r, 0) AS r, row_number() OVER (PARTITION BY pair ORDER BY round(abs(coalesce(r, 0)), 9) DESC, abs(lag), lag) AS place FROM p) SELECT pair, lag, round(r, 6) AS r, place FROM r WHERE place <= 3")
def e9(spark, sf):
    return rounded(sr.lead_lag(*fx.pairs(fx.repaired(spark, sf))))


@query("g5_knots", "SELECT n AS horizon, list(CAST(round_even(k * (n - 1) / 7.0, 0) AS INTEGER) ORDER BY k) AS knots FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n FROM lineitem) h CROSS JOIN range(8) t(k) GROUP BY 1")
def g5(spark, sf):
    return fx.read(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("horizon")).distinct().select("horizon", pooling.knots(F.col("horizon")).alias("knots"))


RISK = f"WITH {FORECASTS}, e AS (SELECT a.win, a.model, greatest(avg(abs(a.q - a.y)) - sum(a.q * (2 * a.k - 10) / 81.0) / count(DISTINCT a.step), 0) / greatest(min(s.scale), 1e-6) AS risk FROM atoms a JOIN scales s ON a.series_id = s.series_id GROUP BY 1, 2), r AS (SELECT win, model, risk, row_number() OVER (PARTITION BY win ORDER BY round(risk, 9), model) - 1 AS rank FROM e)"


@query("g12_crps_ranks", RISK + " SELECT win AS \"window\", model, round(risk, 6) AS risk, CAST(rank AS BIGINT) AS rank FROM r")
def g12(spark, sf):
    return rounded(pooling.crps_ranks(scaled_forecasts(spark, sf)))


ALLOC = RISK + ", z AS (SELECT win, model, exp(-(ln(1 + rank) - avg(ln(1 + rank)) OVER w) / greatest(stddev_pop(ln(1 + rank)) OVER w, 0.15) / 1.35) AS e FROM r WINDOW w AS (PARTITION BY win)), al AS (SELECT win, model, e / sum(e) OVER (PARTITION BY win) AS weight FROM z)"


def allocated(spark, sf):
    return pooling.allocations(pooling.crps_ranks(scaled_forecasts(spark, sf)).select("window", "model", F.log1p("rank").alias("score")))


@query("g13_g16_allocations", ALLOC + " SELECT win AS \"window\", model, round(weight, 6) AS weight FROM al")
def g16(spark, sf):
    return rounded(allocated(spark, sf))


@query("g17_pooled", ALLOC + ", c AS (SELECT a.win, a.step, a.q, round(sum(l.weight / 9.0) OVER (PARTITION BY a.win, a.step ORDER BY a.q, a.model, a.k ROWS UNBOUNDED PRECEDING), 12) AS cum FROM atoms a JOIN al l ON a.win = l.win AND a.model = l.model) SELECT win AS \"window\", step, " + ", ".join(f"round(min(CASE WHEN cum >= {k / 10} THEN q END), 8) AS q{k}" for k in range(1, 10)) + " FROM c GROUP BY 1, 2")
def g17(spark, sf):
    return rounded(pooling.pooled(scaled_forecasts(spark, sf), allocated(spark, sf)), 8)


OPTIMA = f"WITH {FORECASTS}, d AS (SELECT win, greatest(0, least(1, (y - last) / (seasonal - last))) AS root, abs(seasonal - last) AS mass FROM (SELECT series_id || '/' || cutoff AS win, y, last, seasonal FROM pts) x WHERE seasonal <> last), c AS (SELECT win, root, sum(mass) OVER (PARTITION BY win ORDER BY root RANGE UNBOUNDED PRECEDING) AS cum, sum(mass) OVER (PARTITION BY win) AS total FROM d), o AS (SELECT win, (min(CASE WHEN cum >= total / 2 THEN root END) + coalesce(min(CASE WHEN cum > total / 2 THEN root END), max(root))) / 2 AS optimum FROM c GROUP BY 1)"


def optima(spark, sf):
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).where("model in ('last', 'seasonal')")
    wide = f.groupBy("window", "step").agg(F.max(F.when(F.col("model") == "last", F.col("q")[4])).alias("left"), F.max(F.when(F.col("model") == "seasonal", F.col("q")[4])).alias("right"), F.max("y").alias("y")).withColumn("weight", F.lit(1.0))
    return pooling.row_optimum(wide)


@query("g23_row_optimum", OPTIMA + " SELECT win AS \"window\", round(optimum, 5) AS optimum FROM o")
def g23(spark, sf):
    return rounded(optima(spark, sf), 5)


@query("g24_blend_mass", OPTIMA + " SELECT round(avg(optimum), 5) AS mass, count(*) AS rows FROM o")
def g24(spark, sf):
    rows = optima(spark, sf)
    return rounded(rows.agg(F.count("optimum").alias("rows")).withColumn("mass", F.lit(pooling.blend_mass(rows))), 5)


@query("g22_blended", f"WITH {FORECASTS}, w AS (SELECT a.win, a.step, a.k, a.q AS l, b.q AS r FROM atoms a JOIN atoms b ON a.win = b.win AND a.step = b.step AND a.k = b.k AND a.model = 'last' AND b.model = 'trend') SELECT win AS \"window\", step, k AS level, round(CASE WHEN step % 5 = 0 THEN l ELSE 0.75 * l + 0.25 * max(CASE WHEN k % 3 = 0 THEN r - 2 ELSE r END) OVER (PARTITION BY win, step ORDER BY k) END, 6) AS q FROM w")
def g22(spark, sf):
    """The right side falls at every third level (its running maximum counts) and is missing at every fifth step."""
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).where("model in ('last', 'trend')")
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("q")))
    wide = f.groupBy("window", "step").agg(side("last").alias("l"), side("trend").alias("r"))
    right = F.when(F.col("step") % 5 != 0, F.transform("r", lambda x, i: F.when((i + 1) % 3 == 0, x - 2).otherwise(x)))
    return rounded(wide.select("window", "step", F.posexplode(pooling.blended(F.col("l"), right, 0.25)).alias("at", "q")).select("window", "step", (F.col("at") + 1).cast("long").alias("level"), "q"))


BOARD_SQL = f"""WITH {FORECASTS}, b AS (SELECT f.series_id AS cell, f.model, round(avg(abs(f.point - f.y) / nullif(s.scale, 0)), 6) AS mase FROM fc f JOIN scales s ON f.series_id = s.series_id GROUP BY 1, 2),
r AS (SELECT cell, model, mase, rank() OVER (PARTITION BY cell ORDER BY mase) + (count(*) OVER (PARTITION BY cell, mase) - 1) / 2.0 AS rank FROM b)
SELECT model, round(avg(rank), 6) AS mean_rank, round(exp(avg(ln(greatest(mase, 1e-12)))), 6) AS geometric_mase FROM r GROUP BY 1"""


@query("h6_h7_h8_board", BOARD_SQL)
def h8(spark, sf):
    board = flagship(spark, sf).select(F.col("series_id").alias("cell"), "model", "mase")
    return rounded(scoring.board_report(scoring.tie_ranks(scoring.complete_peers(board))))


@query("h9_sample_crps", "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS s, 25.0 AS y FROM lineitem), n AS (SELECT l_orderkey, avg(abs(s - y)) AS err, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1), p AS (SELECT a.l_orderkey, sum(abs(a.s - b.s)) AS spread FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey GROUP BY 1) SELECT n.l_orderkey, round(n.err - p.spread / (2 * n.n * (n.n - 1)), 6) AS crps FROM n JOIN p ON n.l_orderkey = p.l_orderkey")
def h9(spark, sf):
    paths = fx.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("s"), F.lit(25.0).alias("y"))
    many = paths.groupBy("l_orderkey").count().where("count > 1").select("l_orderkey")
    return rounded(scoring.sample_crps(paths.join(many, "l_orderkey"), ["l_orderkey"]))


@query("h10_capped_score", "SELECT round(sum(l_quantity * least(l_tax * 100, 5)) / sum(l_quantity), 6) AS score, count(*) AS n FROM lineitem")
def h10(spark, sf):
    return rounded(scoring.capped_score(fx.read(spark, sf, "lineitem").select(F.col("l_quantity").alias("weight"), (F.col("l_tax") * 100).alias("metric"))))


@query("d13_line_removal", "SELECT conv_id, turn, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT starts_with(x, 'The')), chr(10)) AS text FROM conversations")
def d13(spark, sf):
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.startswith(x, F.lit("The"))), "\n").alias("text"))


from .plans import ensemble, examples, forecasts, prepare, stores, texts  # noqa: E402, F401  (they register their queries)


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return SQL
