"""Queries of training examples (D2, D5, D12, D14, D16-D22, E17) over line items, orders and events."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import examples as ex
from ..sources import fixtures as fx

#: Every part in turn goes to one of the makers; the remainders by 10 that follow are damaged.
LINES = "p AS (SELECT l_partkey AS k, list_transform(list(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity), x -> CAST(x AS INT)) AS v FROM lineitem GROUP BY 1)".replace("x -> CAST(x AS INT)", "lambda x: CAST(x AS INT)")


def raw(spark, sf):
    """key, kind, raw: JSON of five makers from the quantities of each part; some lack a list, an answer, four options or a known layout."""
    lines = fx.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    lines = lines.select("key", F.transform("s", lambda x: x["l_quantity"].cast("int")).alias("v"))
    k = F.col("key")
    text = F.concat(F.lit("["), F.array_join("v", ", "), F.lit("]"))
    lists = F.concat(F.lit("["), text, F.when(k % 10 == 2, ", [1]").otherwise(""), F.lit("]"))
    asked = F.concat(F.lit("Is "), text, F.lit(" rising?"), F.when(k % 10 == 0, F.concat(F.lit(" Or "), text, F.lit("?"))).otherwise(""))
    pair = lambda name, value: F.concat(F.lit(f'"{name}": "'), F.regexp_replace(value, '"', '\\\\\\\\"'), F.lit('"'))
    made = {
        0: ("listed", F.to_json(F.struct(F.concat(pair("question", asked), F.lit(", "), pair("answer", F.lit(" No. "))).alias("QA_list")))),
        1: ("lettered", F.to_json(F.struct(text.alias("Series"), F.concat(F.lit("What?\n(a) The value increased\n(b) a falling line\n(c) "), F.when(k % 10 == 6, "Falling line").otherwise("flat")).alias("Question"), F.lit("(b)").alias("Answer")))),
        2: ("described", F.concat(F.lit('{"timeseries": '), lists, F.lit(', "prompt_1": " Describe it. ", "answer_1": '), F.when(k % 10 == 7, "null").otherwise('"It varies."'), F.lit("}"))),
        3: ("pattern", F.to_json(F.struct(F.concat(F.lit("["), text, F.lit("]")).alias("timeseries"), F.concat(F.lit("Options: A. one\nB. two\nC. three\nD. "), F.when(k % 10 == 3, "TWO").otherwise("four")).alias("option"), F.lit("C").alias("truth")))),
        4: ("templated", F.concat(F.lit('{"timeseries": ['), text, F.lit('], "input": "There is a time series of length 512: <ts><ts/>. Its mean?", "output": "About np.float64(2.5) here."}'))),
    }
    kind, json = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, text_) in made.items():
        kind, json = F.when(k % 5 == i, name).otherwise(kind), F.when(k % 5 == i, text_).otherwise(json)
    return lines.select("key", kind.alias("kind"), json.alias("raw"))


@query("d16_d22_converted", f"""WITH {LINES}, c AS (SELECT k, len(v) AS n, k % 5 AS m, k % 10 AS d FROM p),
e AS (SELECT *, CASE WHEN d = 0 OR d = 2 THEN 'no single series' WHEN d = 3 THEN 'ambiguous options' WHEN d = 6 THEN 'no single answer' WHEN d = 7 THEN 'no answer' WHEN n < 8 THEN 'invalid series' END AS problem,
 ['listed', 'lettered', 'described', 'pattern', 'templated'][m + 1] AS kind FROM c)
SELECT kind || ':' || k AS row_id, problem, CASE WHEN m IN (1, 3) THEN 'abcd_analysis' ELSE 'freeform_analysis' END AS mold,
 CASE WHEN problem IS NULL THEN CASE m WHEN 0 THEN 'No.' WHEN 1 THEN 'B) a falling line' WHEN 2 THEN 'It varies.' WHEN 3 THEN 'C) three' ELSE 'About 2.5 here.' END END AS target,
 CASE WHEN problem IS NULL THEN 'Question:' || chr(10) || CASE m WHEN 0 THEN 'Is the supplied time-series evidence rising?' WHEN 1 THEN 'What?' WHEN 2 THEN 'Describe it.' WHEN 3 THEN '{ex.PATTERN}' ELSE 'Its mean?' END
  || CASE m WHEN 1 THEN chr(10) || chr(10) || 'Options:' || chr(10) || 'A) The value increased' || chr(10) || 'B) a falling line' || chr(10) || 'C) flat' WHEN 3 THEN chr(10) || chr(10) || 'Options:' || chr(10) || 'A) one' || chr(10) || 'B) two' || chr(10) || 'C) three' || chr(10) || 'D) four' ELSE '' END
  || chr(10) || chr(10) || 'Requested output:' || chr(10) || CASE WHEN m IN (1, 3) THEN '{ex.rq.CHOICE_OUTPUT}' ELSE '{ex.rq.FREEFORM_OUTPUT}' END END AS asked,
 CASE WHEN problem IS NULL THEN (SELECT string_agg(CAST(x AS VARCHAR), ' ' ORDER BY i) FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM p q WHERE q.k = e.k)) END AS shown FROM e""")
def d16(spark, sf):
    """Whole messages are rendered; what follows the evidence and the values shown in it are compared."""
    out = ex.converted(raw(spark, sf))
    at = F.instr("message", F.lit("Question:\n"))
    shown = F.regexp_extract("message", r"separated by spaces\):\n([^\n]*)\n", 1)
    return out.select("row_id", "problem", "mold", "target", F.when(at > 0, F.substr("message", at)).alias("asked"), F.when(at > 0, shown).alias("shown"))


def readings(spark, sf):
    """key, kind, raw: sensor questions of thirty and of nine readings, and one that fits neither."""
    lines = fx.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    v = F.transform("s", lambda x: x["l_quantity"].cast("int"))
    many = F.when(F.col("key") % 3 == 1, 9).otherwise(30)
    said = F.when(F.col("key") % 3 == 0, f"with {ex.qs.ACTIVITY}").when(F.col("key") % 3 == 1, f"with {ex.qs.SENSORS}").otherwise("of some kind")
    lines = lines.select("key", F.slice(F.flatten(F.array_repeat(v, 30)), F.lit(1), many).alias("v"), said.alias("said"))
    question = F.concat(F.lit("Data "), "said", F.lit(" ["), F.array_join("v", ","), F.lit("] of what?"))
    return lines.select("key", F.lit("listed").alias("kind"), F.to_json(F.struct(F.lit("classification").alias("task"), F.concat(F.lit('"question": "'), question, F.lit('", "answer": "walking"')).alias("QA_list"))).alias("raw"))


@query("e17_d21_channels", f"""WITH {LINES}, r AS (SELECT k, list_transform(range(CASE WHEN k % 3 = 1 THEN 9 ELSE 30 END), lambda i: v[i % len(v) + 1]) AS v, k % 3 AS d FROM p),
u AS (SELECT k, d, unnest(v) AS y, generate_subscripts(v, 1) - 1 AS i FROM r WHERE d = 0),
f AS (SELECT k, i % 3 AS axis, regr_r2(y, i // 3) AS r2, stddev_pop(y) AS sd FROM u GROUP BY 1, 2)
SELECT 'listed:' || k AS row_id, CASE WHEN d = 2 THEN 'unrecognized sensor layout' END AS problem, CASE WHEN d = 0 THEN 'X,Y,Z' WHEN d = 1 THEN '' END AS channels,
 CASE WHEN d = 0 THEN '9 | ' || v[28] || ' | ' || v[29] || ' | ' || v[30] WHEN d = 1 THEN 'Hip | ' || v[7] || ' | ' || v[8] || ' | ' || v[9] END AS last_row,
 (SELECT CASE WHEN sd = 0 THEN 'constant' ELSE round(r2, 2)::VARCHAR END FROM f WHERE f.k = r.k AND axis = 1) AS y_fit FROM r""")
def e17(spark, sf):
    """Tables of readings, each axis with a fit of its own (the second one's R2 is compared)."""
    out = ex.converted(readings(spark, sf))
    rows = F.regexp_extract("evidence", r"\n((?:9|Hip) \|[^\n]*)", 1)
    names = F.array_join(F.regexp_extract_all("evidence", F.lit(r"(?m)^(\w)_trend_fits: "), 1), ",")
    fit = F.regexp_extract("evidence", r"\nY_trend_fits: linear_R2=(\S+)", 1)
    said = F.when(F.col("evidence").contains("Y_trend_fits: unavailable"), "constant").when(fit != "", F.round(fit.try_cast("double"), 2).cast("string"))
    return out.select("row_id", "problem", F.when(F.col("evidence").isNotNull(), names).alias("channels"), F.when(F.col("evidence").isNotNull(), rows).alias("last_row"), said.alias("y_fit"))


def forecasts(spark, sf):
    """Histories of each part with the rest of its quantities as future; every seventh lacks a stamp."""
    lines = fx.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    v = F.transform("s", lambda x: x["l_quantity"])
    n = F.size("v")
    lines = lines.withColumn("v", v).where(n >= 4)
    stamps = lambda a, b: F.transform(F.sequence(a, b), lambda i: F.concat(F.lit("t"), i.cast("string")))
    more = F.when(F.col("key") % 7 == 0, 1).otherwise(0)
    return lines.select("key", F.slice("v", F.lit(1), n - 2).alias("history"), stamps(F.lit(1), n - 2).alias("past"), F.slice("v", n - 1, F.lit(2)).alias("future"), stamps(n - 1, n - more).alias("stamps"), F.when(F.col("key") % 2 == 0, " Orders of a part. ").alias("context"))


@query("d2_d14_examples", f"""WITH {LINES}, q AS (SELECT k, v, len(v) AS n, v[len(v) - 1] AS y1, v[len(v)] AS y2, k % 7 = 0 AS bad FROM p WHERE len(v) >= 4)
SELECT k AS key, CASE WHEN bad THEN 'no target' END AS problem, CASE WHEN NOT bad THEN '<forecast>' || chr(10) || '(t' || (n - 1) || ', ' || y1 || ')' || chr(10) || '(t' || n || ', ' || y2 || ')' || chr(10) || '</forecast>' END AS target,
 CASE WHEN NOT bad THEN '<forecast>' || chr(10) || '(t' || (n - 1) || ', ' || greatest(10, least(30, y1)) || ')' || chr(10) || '(t' || n || ', ' || greatest(10, least(30, y2)) || ')' || chr(10) || '</forecast>' END AS bounded,
 CASE WHEN NOT bad THEN 'I have a time series forecasting task for you.' || chr(10) || chr(10) || CASE WHEN k % 2 = 0 THEN 'Context:' || chr(10) || '<context>' || chr(10) || 'Orders of a part.' || chr(10) || '</context>' || chr(10) || chr(10) ELSE '' END
  || 'Historical time series in (timestamp, value) format:' || chr(10) || '<history>' || chr(10) || (SELECT string_agg('(t' || i || ', ' || v[i] || ')', chr(10) ORDER BY i) FROM (SELECT unnest(range(greatest(1, n - 2 - 167), n - 1)) AS i))
  || chr(10) || '</history>' || chr(10) || chr(10) || 'Future timestamps:' || chr(10) || 't' || (n - 1) || chr(10) || 't' || n END AS message, CASE WHEN NOT bad THEN 2 END AS limits FROM q""")
def d2(spark, sf):
    out = ex.forecast_example(forecasts(spark, sf))
    limits = F.lit("10"), F.lit("30")
    kept = ex.bounded_example(out.select("*"), *limits).select("key", F.col("target").alias("bounded"), F.when(F.col("message").isNotNull(), F.size(F.regexp_extract_all("message", F.lit("(minimum of 10|maximum of 30)"), 1)).cast("long")).alias("limits"))
    return out.select("key", "problem", "target", "message").join(kept, "key")


@query("d12_reports", """WITH e AS (SELECT event_type AS office, ts, event_id, value, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, epoch_us(ts) AS us FROM events),
r AS (SELECT office, ts AS issued, 'Report ' || event_id AS text, us, row_number() OVER (PARTITION BY office, day ORDER BY abs(us % 86400000000 / 3600000000.0 - 12), us, 'Report ' || event_id) AS place FROM e WHERE event_id % 5 = 0),
h AS (SELECT office, (us + 1800000000) // 3600000000 AS hour, us, value, row_number() OVER (PARTITION BY office, (us + 1800000000) // 3600000000 ORDER BY abs(us - (us + 1800000000) // 3600000000 * 3600000000), us, value) AS place FROM e WHERE value BETWEEN -100 AND 140),
j AS (SELECT r.office, r.issued, r.text, r.us // 3600000000 + 1 AS anchor, h.hour, h.value FROM r JOIN h ON r.place = 1 AND h.place = 1 AND h.office = r.office AND h.hour BETWEEN r.us // 3600000000 + 1 - 4 AND r.us // 3600000000 + 4),
s AS (SELECT office, issued, text, anchor, string_agg(strftime(make_timestamp(hour * 3600000000), '%Y-%m-%dT%H:%M:%S+00:00') || ' ' || round(value, 6)::DOUBLE, ';' ORDER BY hour) AS joined, count(*) AS n FROM j GROUP BY 1, 2, 3, 4 HAVING count(*) = 8)
SELECT office || '-' || strftime(issued, '%Y%m%d%H%M') AS row_id, CAST(NULL AS VARCHAR) AS problem, joined,
 'Measured variable: value' || chr(10) || 'Units: units' || chr(10) || 'Office: ' || office || chr(10) || 'Report issued at: ' || strftime(issued, '%Y-%m-%dT%H:%M:%S+00:00') || chr(10) || chr(10) || text AS context FROM s""")
def d12(spark, sf):
    """Of each type of event every fifth is a report; the values are observations of which four hours before and after are joined."""
    e = fx.read(spark, sf, "events").select(F.col("event_type").alias("office"), "ts", "event_id", "value")
    reports = e.where("event_id % 5 = 0").select("office", F.col("ts").alias("issued"), F.concat(F.lit("Report "), F.col("event_id").cast("string")).alias("text"))
    found = ex.reported(reports, e.select("office", "ts", "value"), hours=4)
    said = ex.report_examples(found, "value", "units")
    at = lambda v, t: F.transform(F.arrays_zip(F.col(t).alias("t"), F.col(v).alias("v")), lambda x: F.concat(x["t"], F.lit(" "), F.round(x["v"], 6).cast("string")))
    row_id = F.concat_ws("-", "office", F.date_format("issued", "yyyyMMddHHmm"))
    joined = found.select(row_id.alias("row_id"), F.array_join(F.concat(at("history", "past"), at("future", "stamps")), ";").alias("joined"))
    return said.select("row_id", "problem", F.regexp_extract("message", r"(?s)<context>\n(.*)\n</context>", 1).alias("context")).join(joined, "row_id").select("row_id", "problem", "joined", "context")


@query("d5_messages", """WITH t AS (SELECT DISTINCT event_type AS id FROM events), r AS (SELECT id, row_number() OVER (ORDER BY id) AS no, count(*) OVER () AS n FROM t)
SELECT id, CASE WHEN no = n THEN 'more than two series' WHEN no = 2 THEN 'invalid series' END AS problem,
 CASE WHEN no = n OR no = 2 THEN NULL WHEN no = 1 THEN '1 S1' ELSE '2 S1,S2,Pair' END AS measured,
 CASE WHEN no = n OR no = 2 THEN NULL ELSE 'Supplied concept definitions:' || chr(10) || 'flat: level.' || chr(10) || chr(10) || 'Question:' || chr(10) || 'Is it flat?'
  || CASE WHEN no % 2 = 1 THEN chr(10) || chr(10) || 'Options:' || chr(10) || 'A) Yes' || chr(10) || 'B) No' || chr(10) || chr(10) || 'Requested output:' || chr(10) || 'Return exactly one line as LETTER) exact option text.'
   ELSE chr(10) || chr(10) || 'Requested output:' || chr(10) || 'Answer the analytical question directly.' END END AS asked FROM r""")
def d5_messages(spark, sf):
    """A question for each type of event: about its hourly series and, but for the first, the first one's; the second is cut short, the last has a third."""
    rep = fx.repaired(spark, sf)
    names = rep.select(F.col("series_id").alias("id")).distinct()
    ranked = names.withColumn("no", F.row_number().over(W.orderBy("id"))).withColumn("n", F.count("*").over(W.partitionBy()))  # five rows
    wanted = F.when(F.col("no") == F.col("n"), F.array(F.lit(0), F.lit(1), F.lit(2))).when(F.col("no") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    first = F.first("id").over(W.orderBy("no"))
    asked = ranked.withColumn("first", first).withColumn("place", F.explode(wanted)).withColumn("of", F.when(F.col("place") == 0, F.col("id")).otherwise(F.col("first")))
    short = (F.col("no") != 2) | (F.col("pos") < 5)
    series = asked.join(rep.withColumnRenamed("series_id", "of"), "of").where(short).select("id", "place", "pos", "value")
    options = F.when(F.col("no") % 2 == 1, F.array(F.lit("Yes"), F.lit("No")))
    questions = ranked.select("id", F.lit("Is it flat?").alias("question"), options.alias("options"), F.lit("flat: level.").alias("concept_definitions"))
    out = ex.analysis_messages(questions, series)
    m = F.col("message")
    measured = F.concat_ws(" ", F.size(F.regexp_extract_all(m, F.lit(r"(?m)^(Time series (?:\d )?values)"), 1)).cast("string"), F.array_join(F.regexp_extract_all(m, F.lit(r"(?m)^(S\d|Pair): "), 1), ","))
    return out.select("id", "problem", F.when(m.isNotNull(), measured).alias("measured"), F.when(m.isNotNull(), F.substr(m, F.instr(m, F.lit("Supplied concept")))).alias("asked"))
