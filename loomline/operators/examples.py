"""Training examples from raw sources: question tables, forecasts, reports with observations. A row renders, or tells why it does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import evidence as ev
from ..functions import questions as qs
from ..functions import requests as rq
from ..functions import text as tx
from ..functions.series import is_finite
from ..sources.stage import staged

#: All fields of the raw tables; each maker's rows have some. A list where a text is expected is read as its JSON text.
RAW = "task string, QA_list string, Series string, Question string, Answer string, id string, timeseries string, prompt_1 string, answer_1 string, option string, truth string, input string, output string"
#: The phrase in place of a list, the question of pattern tables, and a prefix that is left out.
PHRASE = "the supplied time-series evidence"
PATTERN = "Given the time series data, select the description from the four options that best corresponds to the provided data."
PREFIX = "There is a time series of length 512: <ts><ts/>. "
#: Most future steps and most past observations of an example.
MOST_FUTURE, MOST_PAST = 64, rq.SHOWN
_OPTIONS = "array<struct<label:string,text:string>>"


def _stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _one_series(text: Column) -> Column:
    """The series of a JSON list of one list; null for any other."""
    lists = F.from_json(text, "array<array<double>>")
    return F.when(F.size(lists) == 1, lists[0])


def parsed(rows: DataFrame) -> DataFrame:
    """key, kind, values, question, answer, options, label, layout, problem from (key, kind, raw), raw being one JSON object.

    kind: listed (a list in the question; task classification names a sensor layout), lettered (three options and the
    letter of the answer), described (a description of one series), pattern (four options; the letter stands in an
    explanation, or in truth where there is none), templated. What cannot be read has a problem, and no values.
    """
    c = F.col
    names = [f.split()[0] for f in RAW.split(", ")]
    # raw fields get names that no result has: a result's name would hide a field that differs in case
    raw = rows.select("key", "kind", F.from_json("raw", RAW).alias("r")).select("key", "kind", *[c(f"r.{n}").alias(f"r_{n}") for n in names])
    raw = staged(raw)  # each maker's part reads it
    qa = F.from_json(F.concat(F.lit("{"), "r_QA_list", F.lit("}")), "question string, answer string")
    listed = {"values": tx.listed(qa["question"]), "question": _stripped(tx.unlisted(qa["question"], PHRASE)), "answer": _stripped(qa["answer"]), "layout": F.when(c("r_task") == "classification", True)}
    prompt = _stripped(c("r_Question"))
    three = qs.lettered_options(prompt)
    picked = qs.answered(three, F.substring(_stripped(c("r_Answer")), 2, 1))
    upper = lambda options: F.transform(options, lambda o: F.struct(F.upper(o["label"]).alias("label"), o["text"].alias("text")))
    lettered = {"values": F.from_json("r_Series", "array<double>"), "question": F.substring_index(prompt, "\n(a)", 1), "options": upper(three), "label": F.upper(picked["label"])}
    described = {"values": _one_series(c("r_timeseries")), "question": _stripped(c("r_prompt_1")), "answer": _stripped(c("r_answer_1"))}
    told = F.substring_index(_stripped(F.concat(F.coalesce("r_prompt_1", F.lit("")), "r_option")), "\n\nOptions:\n", -1)
    truth = F.regexp_extract_all(F.concat(F.lit("\n"), F.regexp_replace("r_option", r"^\s*Options:\s*", "")), F.lit(r"(?s)(\n[A-D][:.]\s*.*?(?=\n[A-D][:.]\s|\z))"), 1)
    four = F.transform(truth, lambda x: F.struct(F.regexp_extract(x, r"(?s)^\n([A-D])[:.]", 1).alias("label"), _stripped(F.regexp_extract(x, r"(?s)^\n[A-D][:.](.*)$", 1)).alias("text")))
    explained = c("r_answer_1").isNotNull()
    options = qs.four_options(F.when(explained, qs.lettered_options(told, "A-D", ": ", "")).otherwise(four))
    pattern = {"values": _one_series(c("r_timeseries")), "question": F.lit(PATTERN), "options": options, "label": F.when(explained, F.upper(qs.explained(c("r_answer_1")))).otherwise(c("r_truth"))}
    templated = {"values": F.from_json("r_timeseries", "array<array<double>>")[0], "question": qs.without_prefix(c("r_input"), PREFIX), "answer": qs.template_answer(c("r_output"))}
    makers = {"listed": listed, "lettered": lettered, "described": described, "pattern": pattern, "templated": templated}
    types = {"values": "array<double>", "question": "string", "answer": "string", "options": _OPTIONS, "label": "string", "layout": "boolean"}
    # one maker's columns after another's: each part of the table parses its own fields only
    out = None
    for kind, fields in makers.items():
        part = raw.where(c("kind") == kind).select("key", "kind", *[fields.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])
        out = part if out is None else out.unionByName(part)
    chosen = c("kind").isin("lettered", "pattern")
    there = F.size(F.filter("options", lambda o: o["label"] == c("label"))) == 1
    problem = (
        F.when(c("values").isNull(), "no single series").when(F.exists("values", lambda x: ~is_finite(x)), "not finite")
        .when(F.coalesce(c("question"), F.lit("")) == "", "no question").when(chosen & c("options").isNull(), "ambiguous options")
        .when(chosen & ~F.coalesce(there, F.lit(False)), "no single answer").when(~chosen & (F.coalesce("answer", F.lit("")) == ""), "no answer")
    )
    rest = raw.where(~F.coalesce(c("kind").isin(*makers), F.lit(False))).select("key", "kind", *[F.lit(None).cast(t).alias(k) for k, t in types.items()], F.lit("unknown kind").alias("problem"))
    return out.withColumn("problem", problem).unionByName(rest)


def presented(rows: DataFrame) -> DataFrame:
    """rows (key, values, question, layout, ...) with `evidence`, and `problem` where there is none: see evidence.source_evidence.

    layout true: the values are sensor readings, laid out as their question says.
    """
    table = qs.sensor_table(F.col("values"), F.col("question"), F.transform("values", lambda x: x.cast("string")))
    kind = F.when(~F.coalesce("layout", F.lit(False)), "series").when(table.isNull(), "unknown").when(F.size("values") == 30, "axes").otherwise("places")
    rows = rows.withColumn("shape", F.when(F.col("problem").isNull(), kind))
    out = ev.source_evidence(rows)
    why = F.when(F.col("shape") == "unknown", "unrecognized sensor layout").when(F.col("evidence").isNull(), "invalid series")
    return out.withColumn("problem", F.coalesce("problem", why)).drop("shape")


def converted(rows: DataFrame) -> DataFrame:
    """row_id, mold, question, options, target, output_schema, evidence, message, problem, one row for each of (key, kind, raw).

    An example that renders has a message and a target and no problem; any other has a problem and neither.
    """
    told = presented(staged(parsed(rows)))
    chosen = F.col("kind").isin("lettered", "pattern")
    lines = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit(") "), o["text"])), "\n")
    text = F.get(F.filter("options", lambda o: o["label"] == F.col("label")), F.lit(0))["text"]
    target = F.when(chosen, F.concat("label", F.lit(") "), text)).otherwise(F.col("answer"))
    out = told.select(
        F.concat_ws(":", "kind", F.col("key").cast("string")).alias("row_id"), F.when(chosen, "abcd_analysis").otherwise("freeform_analysis").alias("mold"), "question", F.when(chosen, lines).alias("options"),
        target.alias("target"), F.when(chosen, rq.CHOICE_OUTPUT).otherwise(rq.FREEFORM_OUTPUT).alias("output_schema"), F.when(F.col("problem").isNull(), F.col("evidence")).alias("evidence"), F.col("problem").alias("__p"),
    )
    out = rq.rendered(out).withColumn("problem", F.coalesce("__p", "problem")).drop("__p")
    return out.withColumns({"message": F.when(F.col("problem").isNull(), F.col("message")), "target": F.when(F.col("problem").isNull(), F.col("target"))})


def analysis_messages(questions: DataFrame, series: DataFrame) -> DataFrame:
    """id, message, problem: the analysis messages of questions (id, question, options, concept_definitions, question_clarification).

    series: (id, place, pos, value), one series or two for each question; a question without valid ones has a problem.
    options (an array, null for a free answer) are lettered.
    """
    seen = ev.question_evidence(series)
    rows = questions.join(seen, "id", "left")
    many = F.coalesce(F.size("options") > 0, F.lit(False))
    rows = rows.withColumns({"mold": F.when(many, "abcd_analysis").otherwise("freeform_analysis"), "options": F.when(many, rq.lettered(F.col("options"))), "__p": F.when(F.col("evidence").isNull(), F.coalesce("series_problem", F.lit("no series")))})
    out = rq.rendered(rows)
    return out.select("id", "message", F.coalesce("__p", "problem").alias("problem"))


def forecast_example(rows: DataFrame) -> DataFrame:
    """rows (history, past, future, stamps, context) with the fields of a rendered example: the last 168 observations, the first 64 steps, and the target block.

    Values are texts of six digits. Where arrays do not match or a value is not finite, `problem` says so and message and target are null.
    """
    first = lambda a: F.slice(a, F.lit(1), F.lit(MOST_FUTURE))
    rows = rows.withColumns({"__y": first("future"), "__t": first("stamps")})
    fields = rq.forecast_fields(F.col("history"), F.col("past"), F.col("__t"), F.col("context"))
    fits = F.size("future") == F.size("stamps")
    lines = F.zip_with("__t", rq.numbers(F.col("__y")), lambda t, v: F.struct(t.alias("stamp"), v.alias("text")))
    rows = rows.withColumn("points", F.when(fits, lines))
    out = rq.rendered(rows.withColumns(fields))
    problem = F.coalesce("problem", F.when(F.col("points").isNull(), "no target"))
    out = out.withColumn("problem", problem).withColumns({"message": F.when(problem.isNull(), F.col("message")), "target": F.when(problem.isNull(), _block(F.col("points")))})
    return out.drop("__y", "__t")


def _block(points: Column) -> Column:
    lines = F.transform(points, lambda p: F.concat(F.lit("("), p["stamp"], F.lit(", "), p["text"], F.lit(")")))
    return F.concat(F.lit(tx.OPEN + "\n"), F.array_join(lines, "\n"), F.lit("\n" + tx.CLOSE))


def bounded_example(rows: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """Examples (of forecast_example) whose target keeps within limits (texts, null for none), which the context states."""
    number = lambda t: t.try_cast("double")
    clip = lambda p: F.when(number(p["text"]) < number(lower), lower).when(number(p["text"]) > number(upper), upper).otherwise(p["text"])
    clipped = F.transform("points", lambda p: F.struct(p["stamp"].alias("stamp"), clip(p).alias("text")))
    said = qs.bounds_context(lower, upper)
    out = rows.withColumns({"points": clipped, "context": said, "evidence": said, "mold": F.lit("context_aided_forecast"), "__p": F.col("problem")})
    out = rq.rendered(out.drop("message", "problem")).withColumn("problem", F.coalesce("__p", "problem")).drop("__p")
    return out.withColumns({"message": F.when(F.col("problem").isNull(), F.col("message")), "target": F.when(F.col("problem").isNull(), _block(F.col("points")))})


def reported(reports: DataFrame, observations: DataFrame, hours: int = 24, noon: float = 12.0, low: float = -100.0, high: float = 140.0) -> DataFrame:
    """office, issued, text, history, past, future, stamps: each office's report of a day with the observations around it.

    reports (office, issued, text), observations (office, ts, value), stamps in UTC. Of a day the report issued nearest to
    noon counts (the earlier of equally near ones), of an hour the observation nearest to it, within half an hour, whose
    value lies between the limits. The hours before and from the one after the report's must all have one: an equi-join on
    office and hour of `hours` rows a report and side. Null stamps, texts and values do not count.
    """
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hour_ = 3_600_000_000
    day = reports.where("issued is not null and text is not null").withColumn("__at", micro("issued"))
    near = F.abs(F.pmod("__at", F.lit(24 * hour_)) / hour_ - noon)
    best = day.groupBy("office", F.floor(F.col("__at") / (24 * hour_)).alias("__day")).agg(F.min_by(F.struct("issued", "text", "__at"), F.struct(near, F.col("__at"), F.col("text"))).alias("b"))
    best = best.select("office", "b.*").withColumn("__hour", F.floor(F.col("__at") / hour_) + 1)
    fine = observations.where("ts is not null").where(is_finite(F.col("value")) & F.col("value").between(low, high)).withColumn("__at", micro("ts"))
    fine = fine.withColumn("__own", F.floor((F.col("__at") + hour_ // 2) / hour_))
    hourly = fine.groupBy("office", F.col("__own").alias("__hour")).agg(F.min_by("value", F.struct(F.abs(F.col("__at") - F.col("__own") * hour_), F.col("__at"), F.col("value"))).alias("value"))
    asked = best.withColumn("__i", F.explode(F.sequence(F.lit(-hours), F.lit(hours - 1)))).withColumn("__hour", F.col("__hour") + F.col("__i"))
    each = asked.join(hourly, ["office", "__hour"]).groupBy("office", "issued", "text").agg(F.array_sort(F.collect_list(F.struct("__i", "value", "__hour"))).alias("v"))
    stamp = lambda x: F.date_format(F.timestamp_seconds(x["__hour"] * 3600).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    part = lambda f, at: F.transform(F.slice("v", F.lit(at), F.lit(hours)), f)
    whole = each.where(F.size("v") == 2 * hours)
    return whole.select("office", "issued", "text", part(lambda x: x["value"], 1).alias("history"), part(stamp, 1).alias("past"), part(lambda x: x["value"], hours + 1).alias("future"), part(stamp, hours + 1).alias("stamps"))


def report_examples(rows: DataFrame, variable: str, units: str) -> DataFrame:
    """row_id, message, target, problem of reported() rows: the report is the context of a forecast."""
    at = F.date_format(F.col("issued").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    head = F.concat_ws("\n", F.lit(f"Measured variable: {variable}"), F.lit(f"Units: {units}"), F.concat(F.lit("Office: "), "office"), F.concat(F.lit("Report issued at: "), at))
    named = rows.withColumns({"context": F.concat(head, F.lit("\n\n"), "text"), "row_id": F.concat_ws("-", "office", F.date_format(F.col("issued").cast("timestamp_ntz"), "yyyyMMddHHmm"))})
    return forecast_example(named).select("row_id", "message", "target", "problem")
