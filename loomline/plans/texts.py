"""Queries of requests, questions, evidence and corrections (B, D, E, G)."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..catalog import DFT, FORECASTS, REPAIRED, query, rounded
from ..functions import evidence as ev
from ..functions import questions as qs
from ..functions import requests as rq
from ..functions import series as sr
from ..operators import correction as co
from ..operators import features as ft
from ..operators import members as mb
from ..operators import pooling
from ..sources import files
from ..sources import fixtures as fx

SYSTEM = "Answer briefly."
HEAD = "'I have a time series forecasting task for you.' || chr(10) || chr(10)"


def asked(spark, sf):
    """window, cutoff, history, past, future (stamps), context: a forecasting request for each window of the hourly series; one in two has a context."""
    rep = fx.repaired(spark, sf)
    arrays = rep.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    w = fx.rolling_windows(rep).join(arrays, "series_id").withColumn("h", F.slice("v", F.lit(1), F.col("cutoff").cast("int")))
    stamp = lambda p: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + p * 3600).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    future = F.transform(F.sequence(F.col("cutoff"), F.col("cutoff") + 23), stamp)
    context = F.when(F.col("cutoff") % 48 == 0, F.concat(F.lit(" About "), "series_id", F.lit("\n")))
    return w.select(F.concat_ws("/", "series_id", "cutoff").alias("window"), "cutoff", F.transform("h", lambda x: x["value"]).alias("history"), F.transform("h", lambda x: stamp(x["pos"])).alias("past"), future.alias("future"), context.alias("context"))


def messages(spark, sf):
    rows = asked(spark, sf)
    fields = rq.forecast_fields(F.col("history"), F.col("past"), F.col("future"), F.col("context"))
    return rq.rendered(rows.select("window", "future", *[v.alias(k) for k, v in fields.items()]))


MESSAGE_SQL = FORECASTS + f""", hist AS (SELECT w.series_id || '/' || w.cutoff AS win, w.series_id, w.cutoff, string_agg('(' || strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(r.pos AS INTEGER)), '%Y-%m-%d %H:%M:%S') || ', ' || format('{{:.6g}}', r.value) || ')', chr(10) ORDER BY r.pos) AS h FROM win w JOIN rep r ON r.series_id = w.series_id AND r.pos < w.cutoff AND r.pos >= w.cutoff - 168 GROUP BY 1, 2, 3),
fut AS (SELECT series_id || '/' || cutoff AS win, string_agg(strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(cutoff + i AS INTEGER)), '%Y-%m-%d %H:%M:%S'), chr(10) ORDER BY i) AS f FROM win CROSS JOIN range(24) t(i) GROUP BY 1),
msg AS (SELECT hist.win, {HEAD} || CASE WHEN cutoff % 48 = 0 THEN 'Context:' || chr(10) || '<context>' || chr(10) || 'About ' || series_id || chr(10) || '</context>' || chr(10) || chr(10) ELSE '' END AS head, 'Historical time series in (timestamp, value) format:' || chr(10) || '<history>' || chr(10) || h || chr(10) || '</history>' || chr(10) || chr(10) || 'Future timestamps:' || chr(10) || f AS tail FROM hist JOIN fut ON hist.win = fut.win)"""
CHAT_SQL = "'<|im_start|>system' || chr(10) || 'Answer briefly.' || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)", "'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"


@query("d3_d4_messages", f"WITH {MESSAGE_SQL} SELECT win AS \"window\", head || tail AS message FROM msg")
def d4(spark, sf):
    return messages(spark, sf).select("window", "message")


@query("d6_d7_views", f"WITH {MESSAGE_SQL} SELECT win AS \"window\", length({CHAT_SQL[0]} || head || tail || {CHAT_SQL[1]}) AS chars, {CHAT_SQL[0]} || rtrim(head, chr(10)) || {CHAT_SQL[1]} AS view FROM msg")
def d7(spark, sf):
    prompt = rq.chat(F.col("message"), SYSTEM)
    return messages(spark, sf).select("window", F.char_length(prompt).cast("long").alias("chars"), rq.routing_view(prompt).alias("view"))


@query("b23_normalised", "WITH q AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN TIMESTAMP '2000-01-03' ELSE o_orderdate END AS ts, CAST(o_orderkey % 5 AS INT) AS u FROM orders), s AS (SELECT k, n, CASE u WHEN 0 THEN date_trunc('hour', ts) + n * INTERVAL 1 hour WHEN 1 THEN date_trunc('day', ts) + n * INTERVAL 1 day WHEN 2 THEN date_trunc('week', ts) + 2 * n * INTERVAL 1 week WHEN 3 THEN date_trunc('month', ts) + n * INTERVAL 1 month END AS t FROM q CROSS JOIN range(5) r(n)), "
    "x AS (SELECT k, string_agg(CASE WHEN strftime(t, '%H:%M:%S') = '00:00:00' THEN strftime(t, '%Y-%m-%d') ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END, ',' ORDER BY n) AS stamps FROM s GROUP BY 1) "
    "SELECT k AS o_orderkey, CASE WHEN k % 3 = 0 THEN '2000-01-03 00:00:00' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS start, CASE WHEN k % 2 = 0 THEN 'short' ELSE 'long' END AS term, CASE WHEN k % 7 = 0 THEN 'a,b,c,d,e' ELSE stamps END AS stamps, CASE WHEN k % 11 = 0 THEN 'given' WHEN k % 7 > 0 AND stamps IS NULL THEN NULL ELSE 'rendered' END AS message, k % 11 > 0 AND k % 7 > 0 AND stamps IS NULL AS rejected FROM q JOIN x USING (k)")
def b23(spark, sf):
    """Every third request lacks a start, every second a term; every seventh has stamps of its own, every eleventh a message; one frequency in five is unknown."""
    k = F.col("o_orderkey")
    given = lambda *t: F.when(k % 7 == 0, F.array(*map(F.lit, t)))
    rows = fx.read(spark, sf, "orders").select(
        "o_orderkey", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("history"), F.lit(2).alias("horizon"), F.get(F.array(F.lit("h"), F.lit("D"), F.lit("2W"), F.lit("ME"), F.lit("??")), (k % 5).cast("int")).alias("freq"),
        F.when(k % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("start"), F.when(k % 2 != 0, "long").alias("term"), given("a", "b", "c").alias("past"), given("d", "e").alias("future"), F.lit(None).cast("string").alias("context"), F.when(k % 11 == 0, "given").alias("message"),
    )
    out = rq.normalised(rows)
    said = F.when(F.col("message") == "given", "given").when(F.col("message").contains("Future timestamps"), "rendered")
    return out.select("o_orderkey", "start", "term", F.array_join(F.concat("past", "future"), ",").alias("stamps"), said.alias("message"), F.col("problem").isNotNull().alias("rejected"))


@query("d23_exam", "WITH n AS (SELECT n_nationkey, n_regionkey, n_name FROM nation) SELECT n_nationkey AS id, n_name AS question, string_agg(r_name || ': region ' || r_regionkey || '.', chr(10) ORDER BY i) AS concept_definitions FROM n CROSS JOIN range(3) t(i) JOIN region ON r_regionkey = (n_regionkey + i) % 5 GROUP BY 1, 2")
def d23(spark, sf):
    asked_ = fx.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("question"), F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("n_regionkey") + i) % 5).cast("long")).alias("concepts"))
    known = fx.read(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"), F.concat(F.lit("region "), "r_regionkey").alias("description"))
    return rq.exam(asked_, known).select("id", "question", "concept_definitions")


@query("d24_scenarios", "SELECT o_orderkey, 'Background: ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN '' ELSE chr(10) || 'Constraints: ' || o_orderstatus END || chr(10) || 'Scenario: ' || o_custkey AS context, CAST(CAST('0x' || substr(sha256(o_orderpriority || '|' || o_orderkey), 1, 15) AS BIGINT) % 2147483648 AS BIGINT) AS seed FROM orders")
def d24(spark, sf):
    fields = {"background": F.col("o_orderpriority"), "constraints": F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")), "scenario": F.col("o_custkey").cast("string")}
    return fx.read(spark, sf, "orders").select("o_orderkey", rq.scenario(fields).alias("context"), rq.seed_of(F.col("o_orderpriority"), F.col("o_orderkey")).alias("seed"))


@query("d17_d19_options", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE ['a', 'b', 'c'][o_orderkey % 3 + 1] END AS label, CASE o_orderkey % 3 WHEN 0 THEN 'The value increased' WHEN 1 THEN 'a falling line' END AS answer, o_orderkey % 2 = 0 AS four, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE 'B' END AS explained, '1.5 and x' AS clean, 'rest ' || o_orderkey AS rest, CASE o_orderkey % 3 WHEN 0 THEN 'periods' WHEN 1 THEN 'spikes' ELSE 'rest' END AS kind FROM orders")
def d17(spark, sf):
    k = F.col("o_orderkey")
    # the third option has the second's meaning on every third row, so that its answer is not unique
    prompt = F.concat(F.lit("What?\n(a) The value increased\n(b) a falling line\n(c) "), F.when(k % 3 == 2, "Falling line").otherwise("flat"))
    label = F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (k % 3).cast("int"))
    found = qs.answered(qs.lettered_options(prompt), label)
    four = qs.four_options(qs.lettered_options(F.concat(F.lit("A: one\nB: two\nC: three\nD: "), F.when(k % 2 == 0, "four").otherwise("Two ")), "A-D", ": ", ""))
    said = F.concat(F.lit("So the correct answer is B."), F.when(k % 4 == 1, " Or the correct answer is C.").otherwise(""))
    correct = F.when(k % 3 == 0, "a period length of 3").when(k % 3 == 1, "Spikes occur at 4").otherwise("x")
    return fx.read(spark, sf, "orders").select("o_orderkey", found["label"].alias("label"), found["text"].alias("answer"), four.isNotNull().alias("four"), qs.explained(said).alias("explained"), qs.template_answer(F.lit("np.float64(1.5) and x")).alias("clean"), qs.without_prefix(F.concat(F.lit("prefix rest "), k), "prefix ").alias("rest"), qs.answer_kind(correct).alias("kind"))


@query("d21_sensors", "WITH v AS (SELECT l_orderkey, CAST(min(l_quantity) AS INTEGER) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN 'Accelerometer observations at successive times (20 Hz).' || chr(10) || 'Observation | X | Y | Z' || (SELECT string_agg(chr(10) || t || ' | ' || (q + 3 * t) || ' | ' || (q + 3 * t + 1) || ' | ' || (q + 3 * t + 2), '' ORDER BY t) FROM range(10) r(t)) WHEN 1 THEN 'Sensor measurements (mg), not a sequence of nine times:' || chr(10) || 'Location | Horizontal forward | Vertical | Horizontal lateral' || (SELECT string_agg(chr(10) || (['Ankle (lower leg)', 'Thigh (above the knee)', 'Hip'])[t + 1] || ' | ' || (q + 3 * t) || ' | ' || (q + 3 * t + 1) || ' | ' || (q + 3 * t + 2), '' ORDER BY t) FROM range(3) r(t)) END AS evidence FROM v")
def d21(spark, sf):
    rows = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").cast("int").alias("q"))
    kind = F.col("l_orderkey") % 3
    n = F.when(kind == 1, 9).otherwise(30)
    question = F.when(kind == 0, f"Data, {qs.ACTIVITY}").when(kind == 1, f"Data of {qs.SENSORS}").otherwise("Data")
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("q") + i)
    return rows.select("l_orderkey", qs.sensor_table(values, question, F.transform(values, lambda x: x.cast("string"))).alias("evidence"))


@query("d11_discussions", "SELECT conv_id, turn, CASE WHEN length(t) - length(replace(t, ' ', '')) + 1 >= 20 THEN left(t, 300) END AS text FROM (SELECT conv_id, turn, trim(regexp_replace('.SHORT TERM... ' || text, '\\s+', ' ', 'g')) AS t FROM conversations) x")
def d11(spark, sf):
    raw = F.concat(F.lit("HEADER\n.SHORT TERM... "), "text", F.lit("\r&&\nIssued at noon\n.MARINE...waves and more"))
    return fx.read(spark, sf, "conversations").select("conv_id", "turn", qs.discussion(raw, 20, 300).alias("text"))


BOUND = "CAST('0x' || substr(sha256('{}' || chr(1) || l_orderkey), 1, 8) AS BIGINT)"


@query("d14_bounds", f"WITH h AS (SELECT l_orderkey, list(l_quantity) AS v FROM lineitem GROUP BY 1 HAVING count(*) > 2), u AS (SELECT l_orderkey, v, {BOUND.format(1)} % 3 AS mode, 0.1 + 0.8 * {BOUND.format(2)} / 4294967296.0 AS u1, 0.1 + 0.8 * {BOUND.format(3)} / 4294967296.0 AS u2 FROM h), q AS (SELECT l_orderkey, mode, (SELECT quantile_cont(x, 0.5) FROM (SELECT 1 AS x)) AS one, u1, u2, v FROM u), s AS (SELECT l_orderkey, mode, list_sort(v) AS s, (len(v) - 1) * u1 AS a1, (len(v) - 1) * u2 AS a2 FROM q), p AS (SELECT l_orderkey, mode, s[CAST(floor(a1) AS INT) + 1] + (s[least(CAST(floor(a1) AS INT) + 2, len(s))] - s[CAST(floor(a1) AS INT) + 1]) * (a1 - floor(a1)) AS q1, s[CAST(floor(a2) AS INT) + 1] + (s[least(CAST(floor(a2) AS INT) + 2, len(s))] - s[CAST(floor(a2) AS INT) + 1]) * (a2 - floor(a2)) AS q2 FROM s) SELECT l_orderkey, round(CASE mode WHEN 0 THEN q1 WHEN 2 THEN least(q1, q2) END, 6) AS lower, round(CASE mode WHEN 1 THEN q1 WHEN 2 THEN greatest(q1, q2) END, 6) AS upper FROM p")
def d14(spark, sf):
    h = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v")).where(F.size("v") > 2)
    from ..operators.cells import number

    mode = F.get(F.array(F.lit("lower"), F.lit("upper"), F.lit("both")), (number(1, "l_orderkey") % 3).cast("int"))
    u = lambda k: 0.1 + 0.8 * number(k, "l_orderkey") / 4294967296.0
    lower, upper = qs.bounds(F.col("v"), F.col("mode"), u(2), u(3))
    return rounded(h.withColumn("mode", mode).select("l_orderkey", lower.alias("lower"), upper.alias("upper")))


@query("d14_d15_contexts", "SELECT o_orderkey, length(CASE o_orderkey % 3 WHEN 0 THEN 'a minimum of 1' WHEN 1 THEN 'a maximum of 2' ELSE 'a minimum of 1 and a maximum of 2' END) AS chars, 'X_t in (0, b_t)' || chr(10) || 'b_t (upper support; time index, value):' || chr(10) || '(1, ' || o_orderkey || ')' || chr(10) || '(2, x)' AS support FROM orders")
def d15(spark, sf):
    k = F.col("o_orderkey")
    text = qs.bounds_context(F.when(k % 3 != 1, "1"), F.when(k % 3 != 0, "2"))
    rest = F.char_length(qs.bounds_context(F.lit(""), F.lit(None))) - len("a minimum of ")
    limits = F.array(F.struct(F.lit(1).alias("t"), k.cast("string").alias("text")), F.struct(F.lit(2).alias("t"), F.lit("x").alias("text")))
    return fx.read(spark, sf, "orders").select("o_orderkey", (F.char_length(text) - rest).cast("long").alias("chars"), qs.support_context(limits).alias("support"))


@query("e14_half_spectrum", f"WITH {REPAIRED}, h AS (SELECT series_id, pos, value, ntile(2) OVER (PARTITION BY series_id ORDER BY pos) AS half FROM rep), g AS (SELECT series_id || '/' || half AS series_id, value, row_number() OVER (PARTITION BY series_id, half ORDER BY pos) - 1 AS t, count(*) OVER (PARTITION BY series_id, half) AS n FROM h), {DFT} SELECT string_split(series_id, '/')[1] AS series_id, CAST(string_split(series_id, '/')[2] AS BIGINT) AS half, n, round(n / CAST(k AS DOUBLE), 6) AS period, round(power / total, 6) AS share FROM q WHERE r = 1")
def e14(spark, sf):
    return rounded(ev.half_spectrum(fx.repaired(spark, sf)).withColumn("half", F.col("half").cast("long")))


@query("e15_validated", "SELECT l_orderkey AS series_id, count(*) AS n, CASE WHEN count(*) < 8 THEN 'short' WHEN count(*) FILTER (l_quantity > 45) > 0 THEN 'not finite' END AS problem FROM (SELECT l_partkey AS l_orderkey, l_quantity FROM lineitem) x GROUP BY 1")
def e15(spark, sf):
    return ev.validated(fx.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("series_id"), F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("value")))


PAIR = f"""{REPAIRED}, f AS (SELECT min(series_id) AS s FROM rep), df AS (SELECT series_id, pos, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS value FROM rep),
sh AS (SELECT b.series_id AS pair, k.lag, coalesce(corr(a.value, b.value), 0) AS r FROM df a JOIN df b ON b.series_id > a.series_id AND a.series_id = (SELECT s FROM f) AND a.value IS NOT NULL AND b.value IS NOT NULL CROSS JOIN range(-128, 129) k(lag) WHERE b.pos = a.pos + k.lag GROUP BY 1, 2),
best AS (SELECT pair, lag, r FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(abs(r), 9) DESC, abs(lag), lag) AS p FROM sh) x WHERE p = 1),
c0 AS (SELECT b.series_id AS pair, corr(a.value, b.value) AS corr0 FROM rep a JOIN rep b ON a.pos = b.pos AND a.series_id = (SELECT s FROM f) AND b.series_id > a.series_id GROUP BY 1),
lg AS (SELECT series_id, pos, value AS y, lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS z FROM rep),
gb AS (SELECT pair, lag, greatest(pow(yx - yz * zx, 2) / ((1 - yz * yz) * (1 - zx * zx)), 0) AS gain FROM (SELECT x.series_id AS pair, k.lag, corr(y, z) AS yz, corr(y, x.value) AS yx, corr(z, x.value) AS zx FROM lg t JOIN rep x ON t.series_id = (SELECT s FROM f) AND x.series_id > t.series_id CROSS JOIN range(1, 33) k(lag) WHERE x.pos = t.pos - k.lag AND t.pos >= 32 GROUP BY 1, 2) y),
g AS (SELECT pair, lag, gain FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(gain, 9) DESC, lag) AS p FROM gb) x WHERE p = 1)"""


@query("e12_pair_summary", f"WITH {PAIR} SELECT c0.pair, round(corr0, 6) AS corr0, round(corr0 * corr0, 6) AS r2, CAST(best.lag AS BIGINT) AS diff_lag, round(best.r, 6) AS diff_r, CAST(g.lag AS BIGINT) AS lag21, round(g.gain, 6) AS gain21 FROM c0 JOIN best ON c0.pair = best.pair JOIN g ON c0.pair = g.pair")
def e12(spark, sf):
    return rounded(ev.pair_summary(*fx.pairs(fx.repaired(spark, sf))).select("pair", "corr0", "r2", "diff_lag", "diff_r", "lag21", "gain21"))


@query("e16_d5_evidence")
def d5(spark, sf):
    return ev.analysis_evidence(fx.repaired(spark, sf))


@query("e17_channel_trends", "WITH v AS (SELECT l_orderkey, l_quantity AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), c AS (SELECT l_orderkey || '/' || CASE WHEN n % 3 = 0 THEN substr('XYZ', CAST(i % 3 + 1 AS INT), 1) ELSE 'S1' END AS series_id, value FROM v) SELECT series_id, count(*) AS n, round(sum(value), 4) AS total FROM c GROUP BY 1")
def e17(spark, sf):
    lines = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v")).withColumn("v", F.transform("v", lambda x: x["l_quantity"]))
    out = ev.channels(lines, "l_orderkey", "v", F.when(F.size("v") % 3 == 0, 3).otherwise(1))
    return rounded(out.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


def sides(spark, sf):
    """window, step, ref (the mean member), cands (all members in order of name)."""
    f = fx.baseline_forecasts(fx.repaired(spark, sf))
    each = f.groupBy("window", "step").agg(F.max(F.when(F.col("model") == "mean", F.col("q"))).alias("ref"), F.array_sort(F.collect_list(F.struct("model", "q"))).alias("m"), F.max("y").alias("y"))
    return each.select("window", "step", "ref", F.transform("m", lambda x: x["q"]).alias("cands"), "y")


SIDES = FORECASTS + ", d AS (SELECT *, list_sort([abs(last - mean), 0.0, abs(seasonal - mean), abs(recent - mean), abs(trend - mean)])[3] AS dis, greatest(abs(mean) * 1e-4, 1e-3) AS floor FROM pts), s AS (SELECT *, series_id || '/' || cutoff AS win, greatest(dis, 0.5, floor) AS scale, pow(greatest(2.0, floor), 2) AS variance FROM d)"


@query("g30_g35_step_scale", f"WITH {SIDES} SELECT win AS \"window\", step, round(scale, 8) AS scale, round(variance / (variance + dis * dis), 8) AS gate FROM s")
def g30(spark, sf):
    return rounded(sides(spark, sf).select("window", "step", co.step_scale(F.col("ref"), F.col("cands")).alias("scale"), co.gate(F.col("ref"), F.col("cands")).alias("gate")), 8)


CLIP = "greatest(-20, least(20, {}))"


@query("g31_g32_descriptor", f"WITH {SIDES} SELECT win AS \"window\", step, CAST(34 - 0 AS BIGINT) - 5 AS width, round({CLIP.format('(last - mean) / scale')}, 6) AS last_offset, round({CLIP.format('sin(2 * pi() * (step - 1) / 23.0)')}, 6) AS wave, round(({' + '.join(CLIP.format(f'({m} - mean) / scale') for m in ('last', 'mean', 'recent', 'seasonal', 'trend'))}) / 5, 6) AS offset_mean FROM s")
def g31(spark, sf):
    rows = sides(spark, sf).withColumn("scale", co.step_scale(F.col("ref"), F.col("cands")))
    d = co.descriptor(F.col("ref"), F.col("cands"), F.col("step"), F.lit(24), F.col("scale"))
    rows = rows.select("window", "step", d.alias("d"), co.offset_summary(F.col("ref"), F.col("cands"), F.col("scale"), 4).alias("o"))
    return rounded(rows.select("window", "step", F.size("d").cast("long").alias("width"), F.col("d")[9].alias("last_offset"), F.col("d")[25].alias("wave"), F.col("o.all_mean").alias("offset_mean")))


@query("g33_resampled", "WITH h AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS horizon FROM lineitem WHERE l_quantity > 1), p AS (SELECT horizon, t, t * 7 / (horizon - 1.0) AS w FROM h CROSS JOIN range(50) r(t) WHERE t < horizon), k AS (SELECT *, CAST(floor(w) AS INT) AS low FROM p) SELECT horizon, CAST(t AS BIGINT) AS t, round(low * low + ((least(low + 1, 7) * least(low + 1, 7)) - low * low) * (w - low), 6) AS v FROM k")
def g33(spark, sf):
    h = fx.read(spark, sf, "lineitem").where("l_quantity > 1").select(F.col("l_quantity").cast("long").alias("horizon")).distinct()
    squares = F.array(*[F.lit(float(i * i)) for i in range(8)])
    return rounded(h.select("horizon", F.posexplode(co.resampled(squares, F.col("horizon"))).alias("t", "v")).withColumn("t", F.col("t").cast("long")))


@query("g34_g36_corrected", f"WITH {SIDES}, c AS (SELECT *, 0.5 * tanh(1.0) * tanh(((last + mean + recent + seasonal + trend) / 5 - mean) / scale) AS cor FROM s), l AS (SELECT win, step, cor, scale, mean, abs(cor - greatest(-0.5, least(0.5, (y - mean) / scale))) AS d FROM c) SELECT win AS \"window\", round((sum(CASE WHEN d < 0.05 THEN 0.5 * d * d / 0.05 ELSE d - 0.025 END * step) + 0.2 * sum(cor * cor * step)) / sum(step), 6) AS loss FROM l GROUP BY 1")
def g34(spark, sf):
    rows = sides(spark, sf).withColumn("scale", co.step_scale(F.col("ref"), F.col("cands")))
    head = F.array(F.lit(1.0), *[F.lit(0.25)] * 5)
    rows = rows.select("window", "y", "scale", F.col("ref")[4].alias("median"), F.col("step").cast("double").alias("weight"), co.correction(head, F.col("ref"), F.col("cands"), F.col("scale")).alias("correction"))
    return rounded(co.correction_loss(rows, ["window"]))


@query("g4_relevelled", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_quantity, 6) AS q1, round(l_quantity + (0.5 - 0.2) / 0.6 * l_tax, 6) AS q5, round(l_quantity + l_tax, 6) AS q9 FROM lineitem")
def g4(spark, sf):
    q = mb.relevelled(F.array(F.col("l_quantity"), F.col("l_quantity") + F.col("l_tax")), [0.2, 0.8])
    return rounded(fx.read(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), q[0].alias("q1"), q[4].alias("q5"), q[8].alias("q9")))


@query("g18_g19_gate", "SELECT l_orderkey AS \"window\", CAST(l_linenumber AS VARCHAR) AS model, round(exp(l_tax) / sum(exp(l_tax)) OVER (PARTITION BY l_orderkey), 6) AS weight FROM lineitem")
def g19(spark, sf):
    logits = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("window"), F.col("l_linenumber").cast("string").alias("model"), F.col("l_tax").alias("logit"))
    return rounded(mb.gate_weights(logits))


@query("g18_frame", "SELECT o_orderkey AS \"window\", o_totalprice, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 END AS DOUBLE) AS priority FROM orders")
def g18(spark, sf):
    rows = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("window"), "o_totalprice", F.col("o_orderpriority").alias("priority"))
    return mb.gating_frame(rows, ["o_totalprice", "priority"], {"priority": ["1-URGENT", "2-HIGH"]}).withColumn("priority", F.col("priority").cast("double"))


@query("g29_equal_pool", f"WITH {FORECASTS}, c AS (SELECT a.win, a.step, a.q, round(sum(1 / 45.0) OVER (PARTITION BY a.win, a.step ORDER BY a.q, a.model, a.k ROWS UNBOUNDED PRECEDING), 9) AS cum FROM atoms a) SELECT win AS \"window\", step, round(min(CASE WHEN cum >= 0.5 THEN q END), 8) AS q5 FROM c GROUP BY 1, 2")
def g29(spark, sf):
    f = fx.baseline_forecasts(fx.repaired(spark, sf))
    return rounded(pooling.pooled(f, mb.equal_weights(f)).select("window", "step", "q5"), 8)


@query("g1_g2_members", f"WITH {REPAIRED} SELECT w.series_id || '/' || w.cutoff AS \"window\", m.model, CAST(t.i AS BIGINT) AS step, round(r.value + m.add, 6) AS q5 FROM (SELECT series_id, count(*) - l.lag * 24 AS cutoff FROM rep CROSS JOIN (VALUES (1), (2), (3)) l(lag) GROUP BY series_id, l.lag) w JOIN rep r ON r.series_id = w.series_id AND r.pos = w.cutoff - 1 CROSS JOIN (VALUES ('flat', 0), ('high', 1)) m(model, add) CROSS JOIN range(1, 25) t(i)")
def g1(spark, sf):
    requests = asked(spark, sf).select("window", "history", F.lit(24).alias("horizon"), F.lit("H").alias("freq"))
    flat = lambda add: lambda frame: [[[h[-1] + add + k for k in range(-4, 5)] for _ in range(24)] for h in frame.history]
    out = mb.fan_out(requests, {"flat": flat(0), "high": flat(1)}, batch=4)
    return rounded(out.select("window", "model", F.col("step").cast("long").alias("step"), F.col("q")[4].alias("q5")))


@query("g28_reference", f"WITH {FORECASTS} SELECT win AS \"window\", a.step, a.k AS level, round(0.7 * a.q + 0.3 * (CASE WHEN a.cutoff % 48 = 0 THEN a.q + 1 ELSE b.q END), 6) AS q FROM (SELECT *, win AS w FROM atoms WHERE model = 'mean') a JOIN (SELECT win AS w, step, k, q FROM atoms WHERE model = 'recent') b USING (w) WHERE a.step = b.step AND a.k = b.k")
def g28(spark, sf):
    """The mean member as the pool, the recent one as the gate; every other window has a forecast ready in the gate's place."""
    f = fx.baseline_forecasts(fx.repaired(spark, sf))
    of = lambda m: f.where(F.col("model") == m).select("window", "cutoff", "step", "q")
    ready = of("mean").where("cutoff % 48 = 0").select("window", "step", F.transform("q", lambda x: x + 1).alias("q"))
    out = mb.reference(of("mean"), of("recent"), 0.3, ready)
    return rounded(out.select("window", "step", F.posexplode("q").alias("at", "q")).select("window", "step", (F.col("at") + 1).cast("long").alias("level"), "q"))


STATE = "SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL"


@query("g37_g38_g40_routes", f"WITH s AS ({STATE}), z AS (SELECT vec_id, 0.8 * v[1] + 0.2 * v[2] AS a, 0.8 * v[2] + 0.2 * v[3] AS b FROM s) SELECT vec_id, round(1 / (1 + exp(-(a - b))), 6) AS w0, round(1 / (1 + exp(-(2 * a - b + 0.5))), 6) AS chance, CASE WHEN 1 / (1 + exp(-(a - b))) > 0.5 THEN 0 ELSE 1 END AS kind, round(ln(1 + exp(-(2 * a - b + 0.5))), 6) AS loss FROM z")
def g37(spark, sf):
    rows = fx.read(spark, sf, "embeddings").where("embedding is not null")
    rows = rows.select("vec_id", F.slice("embedding", 1, 2).alias("text"), F.slice("embedding", 2, 2).alias("full"))
    rows = pooling.routed(rows, "text", "full", [[1.0, 0.0], [0.0, 1.0]], [0.0, 0.0], 0.2)
    rows = rows.withColumn("chance", mb.selected(F.col("text"), F.col("full"), [2.0, -1.0], 0.5, 0.2))
    return rounded(rows.select("vec_id", "w0", "chance", mb.kind_of(F.array("w0", "w1")).alias("kind"), mb.log_loss(F.col("chance"), F.lit(1)).alias("loss")))


@query("g39_encoded_once", "SELECT o_orderkey, length(o_orderpriority) AS size FROM orders")
def g39(spark, sf):
    rows = fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return mb.encoded_once(rows, "o_orderpriority", lambda v: v.withColumn("size", F.char_length("o_orderpriority").cast("long"))).select("o_orderkey", "size")


ROUTES, ROUTE_BIAS = [[0.5, -1.0, 0.25, 1.0], [-0.5, 1.0, 0.75, -1.0]], [0.1, 0.0]


@query("g44_forecast_batch", "WITH s AS (SELECT vec_id, list_transform(range(1, 5), lambda i: 0.5 * CAST(embedding[i] AS DOUBLE) + 0.5 * CAST(embedding[i + 4] AS DOUBLE)) AS v FROM embeddings), "
    "z AS (SELECT vec_id, " + ", ".join(f"{b} + " + " + ".join(f"{w} * v[{i + 1}]" for i, w in enumerate(ws)) + f" AS z{k}" for k, (ws, b) in enumerate(zip(ROUTES, ROUTE_BIAS, strict=True))) + " FROM s), k AS (SELECT vec_id, CASE WHEN z0 > z1 THEN 0 ELSE 1 END AS kind FROM z) "
    "SELECT vec_id AS position, kind, CASE WHEN kind = 0 AND vec_id % 5 > 0 THEN CAST(vec_id + 0.5 AS DOUBLE) WHEN kind = 1 AND vec_id % 7 > 0 THEN CAST(vec_id * 2 AS DOUBLE) END AS first, CASE WHEN kind = 0 AND vec_id % 5 = 0 THEN 'no forecast' WHEN kind = 1 AND vec_id % 7 = 0 THEN 'missing stamp' END AS problem FROM k")
def g44_batch(spark, sf):
    """Requests whose states are parts of the embeddings; every fifth lacks a numerical forecast, every seventh completion a stamp."""
    e = fx.read(spark, sf, "embeddings")
    k = F.col("vec_id")
    requests = e.select(k.alias("position"), F.concat(F.lit("r"), k).alias("request"), F.slice("embedding", 1, 4).alias("text_state"), F.slice("embedding", 5, 4).alias("full_state"), F.array(F.lit("t1"), F.lit("t2")).alias("stamps"))
    numerical = e.where("vec_id % 5 > 0").select(F.concat(F.lit("r"), k).alias("request"), F.array(k + 0.5, k + 1.5).alias("values"))
    texts = e.select(F.concat(F.lit("r"), k).alias("request"), F.concat(F.lit("<forecast>\n(t1, "), (k * 2).cast("string"), F.lit(")\n"), F.when(k % 7 > 0, "(t2, 1)\n").otherwise(""), F.lit("</forecast>")).alias("text"))
    out = mb.forecast_batch(requests, numerical, texts, ROUTES, ROUTE_BIAS)
    return out.select("position", "kind", F.get("values", F.lit(0)).alias("first"), "problem")


@query("g45_answer_batch", "WITH t AS (SELECT DISTINCT event_type AS id FROM events), r AS (SELECT id, row_number() OVER (ORDER BY id) AS no FROM t) SELECT id, CASE WHEN no NOT IN (2, 3) THEN no % 2 END AS choice, CASE WHEN no = 2 THEN 'invalid series' WHEN no = 3 THEN 'no option named' END AS problem, no <> 2 AS rendered FROM r")
def g45_batch(spark, sf):
    """A question for each type of event; the second one's series is cut short, the third one's answer names no option."""
    from pyspark.sql import Window as W

    rep = fx.repaired(spark, sf)
    names = rep.select(F.col("series_id").alias("id")).distinct().withColumn("no", F.row_number().over(W.orderBy("id")))  # five rows
    series = rep.withColumnRenamed("series_id", "id").join(names, "id").where("no <> 2 or pos < 5").select("id", F.lit(1).alias("place"), "pos", "value")
    questions = names.select("id", F.lit("Rising?").alias("question"), F.array(F.lit("Yes"), F.lit("No")).alias("options"))
    texts = names.select("id", F.when(F.col("no") == 3, "perhaps").when(F.col("no") % 2 == 0, "A) yes").otherwise("B) No").alias("text"))
    out = mb.answer_batch(questions, series, texts)
    return out.select("id", F.col("choice").cast("long").alias("choice"), "problem", F.col("message").isNotNull().alias("rendered"))


@query("g43_g44_g45_answers", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS kind, CASE WHEN turn % 2 = 0 THEN 2.5 WHEN conv_id % 2 = 0 THEN 4.0 END AS value, CASE WHEN turn % 2 = 1 AND conv_id % 2 = 1 THEN 'no block' END AS problem, CAST(CASE WHEN role = 'user' THEN 1 END AS DOUBLE) AS choice FROM conversations")
def g44(spark, sf):
    c = fx.read(spark, sf, "conversations").select("conv_id", "turn", F.struct("conv_id", "turn").alias("request"), "role")
    asked_ = c.select("request", F.when(F.col("turn") % 2 == 0, 0).otherwise(1).alias("kind"), F.array(F.lit("t1")).alias("stamps"))
    paths = c.select("request", mb.trajectories(F.lit(None).cast("array<double>"), F.array(F.lit(2.5))).alias("values"))
    texts = c.select("request", F.when(F.col("conv_id") % 2 == 0, "<forecast>\n(t1, 4.0)\n</forecast>").otherwise("none").alias("text"))
    out = mb.routed_forecasts(asked_, paths, texts).select("request", "kind", F.get("values", F.lit(0)).alias("value"), "problem")
    said = c.select(F.col("request").alias("question"), F.concat(F.lit("B) "), "role").alias("text"))
    ask = c.select(F.col("request").alias("question"), F.lit("which?").alias("message"), F.array(F.lit("assistant"), F.lit("user")).alias("options"))
    answers = mb.routed_answers(ask, said).select(F.col("question").alias("request"), "choice")
    return out.join(answers, "request").select("request.conv_id", "request.turn", "kind", "value", "problem", F.col("choice").cast("double").alias("choice"))


def feature_windows(spark, sf):
    rows = asked(spark, sf).select("window", "history", F.lit("h").alias("freq"), F.lit("short").alias("term"))
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).withColumn("model_index", F.array_position(F.array(*map(F.lit, sorted(fx.MODELS))), F.col("model")))
    return rows, f.select("window", "model_index", "step", "q")


@query("g9_router_features", f"WITH {FORECASTS}, t AS (SELECT w.series_id, w.cutoff, r.pos, r.value / greatest(max(abs(r.value)) OVER x, 1) AS s, greatest(max(abs(r.value)) OVER x, 1) AS mag FROM win w JOIN rep r ON r.series_id = w.series_id AND r.pos < w.cutoff AND r.pos >= w.cutoff - 512 WINDOW x AS (PARTITION BY w.series_id, w.cutoff)), l AS (SELECT series_id, cutoff, max(mag) AS mag, count(*) AS n, median(s) AS loc FROM t GROUP BY 1, 2), d AS (SELECT t.series_id, t.cutoff, abs(t.s - l.loc) AS c, t.s - l.loc AS e, abs(t.s - lag(t.s) OVER (PARTITION BY t.series_id, t.cutoff ORDER BY t.pos)) AS r FROM t JOIN l ON t.series_id = l.series_id AND t.cutoff = l.cutoff), k AS (SELECT series_id, cutoff, greatest(1.4826 * median(c), avg(r), stddev_pop(e)) AS sc FROM d GROUP BY 1, 2), m AS (SELECT series_id, cutoff, avg(last) AS p FROM pts GROUP BY 1, 2) SELECT l.series_id || '/' || l.cutoff AS \"window\", CAST(129 AS BIGINT) AS width, round(ln(1 + n), 6) AS log_n, round(ln(1 + mag), 6) AS log_mag, round(loc, 6) AS loc, round(greatest(sc, 1e-4 * abs(loc), 1e-6), 6) AS scale, round(ln(25), 6) AS log_m, round((p / mag - loc) / greatest(sc, 1e-4 * abs(loc), 1e-6), 4) AS last_mean FROM l JOIN k ON l.series_id = k.series_id AND l.cutoff = k.cutoff JOIN m ON l.series_id = m.series_id AND l.cutoff = m.cutoff")
def g9(spark, sf):
    f = ft.router_features(*feature_windows(spark, sf)).withColumn("x", F.col("features"))
    at = lambda i, d=6: F.round(F.col("x")[i], d)
    return f.select("window", F.size("x").cast("long").alias("width"), at(0).alias("log_n"), at(3).alias("log_mag"), at(4).alias("loc"), at(5).alias("scale"), at(6).alias("log_m"), at(19, 4).alias("last_mean"))


@query("g6_knot_weights", "WITH h AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS horizon FROM lineitem), k AS (SELECT horizon, i, CAST(round_even(i * (horizon - 1) / 7.0, 0) AS BIGINT) AS knot FROM h CROSS JOIN range(8) r(i)), n AS (SELECT k.horizon, t.t, min_by(k.i, abs(k.knot - t.t) * 100 + k.i) AS i FROM k CROSS JOIN range(50) t(t) WHERE t.t < k.horizon GROUP BY 1, 2) SELECT k.horizon, CAST(k.i AS BIGINT) AS i, count(n.t) AS steps FROM k LEFT JOIN n ON k.horizon = n.horizon AND k.i = n.i GROUP BY 1, 2")
def g6(spark, sf):
    h = fx.read(spark, sf, "lineitem").select(F.col("l_quantity").cast("long").alias("horizon")).distinct()
    return h.select("horizon", F.posexplode(ft.knot_weights(F.col("horizon"), pooling.knots(F.col("horizon")))).alias("i", "steps")).select("horizon", F.col("i").cast("long").alias("i"), F.col("steps").cast("long").alias("steps"))


@query("g25_training_scale", "WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1), m AS (SELECT l_orderkey, v, greatest(list_max(v), 1) AS mag, CASE WHEN len(v) > 3 THEN 3 ELSE 1 END AS lag FROM h), d AS (SELECT l_orderkey, mag, CASE WHEN len(v) > lag THEN list_avg([abs(v[i] - v[i - lag]) FOR i IN range(lag + 1, len(v) + 1)]) / mag END AS s FROM m) SELECT l_orderkey, round(mag, 6) AS magnitude, round(CASE WHEN s > 0 THEN s END, 6) AS scale FROM d")
def g25(spark, sf):
    h = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v")).withColumn("v", F.transform("v", lambda x: x["l_quantity"]))
    h = h.withColumn("magnitude", F.greatest(F.array_max(F.transform("v", F.abs)), F.lit(1.0)))
    return rounded(h.select("l_orderkey", "magnitude", ft.training_scale(F.col("v"), F.lit(3), F.col("magnitude")).alias("scale")))


@query("g27_fold_masses", "WITH o AS (SELECT o_custkey % 10 AS fold, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1e6 END AS optimum FROM orders), f AS (SELECT DISTINCT fold FROM o) SELECT f.fold, round(avg(o.optimum), 9) AS mass FROM f JOIN o ON o.fold <> f.fold GROUP BY 1")
def g27(spark, sf):
    rows = fx.read(spark, sf, "orders").select((F.col("o_custkey") % 10).alias("fold"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 1e6).alias("optimum"))
    return rounded(ft.fold_masses(rows), 9)


@query("b1_channels", "SELECT o_orderkey, CAST(c AS BIGINT) AS channel, [o_orderkey * 10 + c, o_orderkey * 10 + c + 2] AS v FROM orders CROSS JOIN range(2) t(c)")
def b1(spark, sf):
    k = F.col("o_orderkey")
    rows = fx.read(spark, sf, "orders").select("o_orderkey", F.array(F.array(k * 10, k * 10 + 1), F.array(k * 10 + 2, k * 10 + 3)).alias("target"))
    return rows.select("o_orderkey", F.posexplode(sr.channels(F.col("target"), rows_first=True)).alias("channel", "v")).withColumn("channel", F.col("channel").cast("long"))


@query("b3_prepared", "WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN [0.0 FOR i IN range(greatest(len(v), 8))] WHEN len(v) < 4 THEN list_concat([v[1] FOR i IN range(4 - len(v))], v) ELSE v[-5:] END AS v FROM h")
def b3(spark, sf):
    h = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    v = F.transform("v", lambda x: F.when(F.col("l_orderkey") % 3 != 0, x["l_quantity"]))
    short = F.when(F.col("l_orderkey") % 3 == 0, files.prepared(v)).otherwise(files.prepared(v, 5))
    return h.select("l_orderkey", short.alias("v"))


@query("b18_rescaled", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN o_totalprice / 1e6 ELSE 1.0 END AS scale, round(CASE WHEN o_totalprice > 200000 THEN 1e6 ELSE o_totalprice END, 4) AS scaled FROM orders")
def b18(spark, sf):
    rows = fx.read(spark, sf, "orders").withColumn("v", F.array("o_totalprice"))
    s = sr.rescale(F.col("v"), 200000.0, 1e6)
    return rows.select("o_orderkey", s["scale"].alias("scale"), F.round(F.get(s["values"], F.lit(0)), 4).alias("scaled"))


