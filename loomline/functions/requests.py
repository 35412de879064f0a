"""Requests as text: rendered messages, chat markup, routing views, strict answer patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendars import calendar
from .frequency import regime
from .series import is_finite
from .text import NUMBER

#: The layout of requests.
FORECAST = "I have a time series forecasting task for you.\n\n"
ANALYSIS = "Analyze the supplied time-series evidence.\n\n"
HISTORY = "Historical time series in (timestamp, value) format:\n<history>\n"
FUTURE = "\n</history>\n\nFuture timestamps:\n"
PLAIN = "Forecast the requested future values from the supplied evidence.\n\n"
FREEFORM_OUTPUT = "Answer the analytical question directly."
CHOICE_OUTPUT = "Return exactly one line as LETTER) exact option text."
DEFINITIONS, CLARIFICATION = "Supplied concept definitions:", "Supplied question clarification:"
USER, END = "<|im_start|>user\n", "<|im_end|>"
FIELDS = ("mold", "evidence", "context", "history_evidence", "prediction_points", "question", "options", "output_schema", "concept_definitions", "question_clarification")
#: Observations that a request shows.
SHOWN = 168


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def numbers(v: Column) -> Column:
    """An array as texts of six significant digits, whole numbers from a million on; null where any value is not finite."""

    @F.pandas_udf("array<string>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: [f"{x:.6g}" if x < 1e6 else f"{x:.0f}" for x in a], na_action="ignore")

    return run(F.when(F.forall(v, is_finite), v.cast("array<double>")))


def rendered(rows: DataFrame) -> DataFrame:
    """Adds `message` and `problem` (null where none) from the columns FIELDS, those that are missing being null.

    Forecasts with a history and analyses have layouts of their own; a blank evidence, history or list of points, and a
    template that is unknown, reject the row, with a null message.
    """
    f = {c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string") for c in FIELDS}
    text = lambda c: F.coalesce(f[c], F.lit(""))
    note = lambda title, c: F.when(text(c) != "", F.concat(F.lit(f"\n{title}\n"), text(c))).otherwise("")
    analysis = f["mold"].isin("abcd_analysis", "freeform_analysis")
    evidence = F.concat(stripped(text("evidence")), F.when(analysis, F.concat(note(DEFINITIONS, "concept_definitions"), note(CLARIFICATION, "question_clarification"))).otherwise(""))
    block = F.concat(F.lit(HISTORY), stripped(text("history_evidence")), F.lit(FUTURE), stripped(text("prediction_points")))
    with_history = f["history_evidence"].isNotNull() & ((f["mold"] == "non_context_forecast") | ((f["mold"] == "context_aided_forecast") & f["context"].isNotNull()))
    ask = F.concat(F.lit(ANALYSIS + "Evidence:\n"), evidence, F.lit("\n\nQuestion:\n"), stripped(text("question")))
    output = lambda default: F.concat(F.lit("\n\nRequested output:\n"), stripped(F.coalesce(f["output_schema"], F.lit(default))))
    message = (
        F.when(with_history & (f["mold"] == "non_context_forecast"), F.concat(F.lit(FORECAST), block))
        .when(with_history, F.concat(F.lit(FORECAST + "Context:\n<context>\n"), stripped(text("context")), F.lit("\n</context>\n\n"), block))
        .when(f["mold"].isin("context_aided_forecast", "non_context_forecast"), F.concat(F.lit(PLAIN + "Evidence:\n"), evidence, F.lit("\n\nPrediction points:\n"), stripped(text("prediction_points"))))
        .when(f["mold"] == "abcd_analysis", F.concat(ask, F.lit("\n\nOptions:\n"), stripped(text("options")), output(CHOICE_OUTPUT)))
        .when(f["mold"] == "freeform_analysis", F.concat(ask, output(FREEFORM_OUTPUT)))
    )
    problem = (
        F.when(message.isNull(), "unknown template").when(stripped(text("evidence")) == "", "no evidence")
        .when(with_history & ((stripped(text("history_evidence")) == "") | (stripped(text("prediction_points")) == "")), "no history or points")
    )
    return rows.withColumn("problem", problem).withColumn("message", F.when(problem.isNull(), message))


def forecast_fields(history: Column, past: Column, future: Column, context: Column, most: int = SHOWN) -> dict[str, Column]:
    """The columns of a forecasting request for rendered(): the last `most` observations as (stamp, value) lines.

    Where the arrays do not match, are empty, or hold a value that is not finite, the evidence is empty and is rejected.
    """
    last = lambda a: F.slice(a, F.greatest(F.size(a) - most + 1, F.lit(1)), F.lit(most))
    fits = (F.size(history) == F.size(past)) & (F.size(history) > 0) & (F.size(future) > 0)
    lines = F.zip_with(last(past), numbers(last(history)), lambda t, v: F.concat(F.lit("("), t, F.lit(", "), v, F.lit(")")))
    evidence = F.when(fits, F.array_join(lines, "\n")).otherwise("")
    said = stripped(F.coalesce(context, F.lit("")))
    return {"mold": F.when(said != "", "context_aided_forecast").otherwise("non_context_forecast"), "evidence": evidence, "history_evidence": evidence, "prediction_points": F.array_join(future, "\n"), "context": F.when(said != "", said)}


#: The start of a history that has none, and the term of a request that names none.
START, TERM = "2000-01-03 00:00:00", "short"


def normalised(rows: DataFrame) -> DataFrame:
    """Requests (history, horizon, freq, start, term, past, future, context, message) with what they leave out.

    A missing start or term has its default; missing stamps follow from start and frequency (a number before it is the
    step), missing ones of an unknown frequency stay null; a missing message is rendered from stamps and history, and
    stays null, with a `problem`, where that cannot be.
    """
    c = F.col
    rows = rows.withColumns({"start": F.coalesce("start", F.lit(START)), "term": F.coalesce("term", F.lit(TERM))})
    number = F.regexp_extract("freq", r"^\s*([0-9]+)", 1)
    step = F.when(number == "", 1).otherwise(number.try_cast("int"))
    past, future = calendar(c("start").try_cast("timestamp_ntz"), regime(c("freq")), step, F.size("history"), c("horizon").cast("int"))
    rest = [x for x in rows.columns if x not in ("past", "future")]
    # the inline keeps the calendars from being computed again wherever their stamps are read
    stamps = F.inline(F.array(F.struct(F.coalesce("past", past).alias("past"), F.coalesce("future", future).alias("future"))))
    rows = rows.select(*rest, stamps).withColumn("__said", c("message"))
    out = rendered(rows.drop("message").withColumns(forecast_fields(c("history"), c("past"), c("future"), c("context"))))
    out = out.withColumn("problem", F.when(c("__said").isNull(), c("problem"))).withColumn("message", F.coalesce("__said", "message"))
    return out.drop("__said", "mold", "evidence", "history_evidence", "prediction_points")


def lettered(options: Column) -> Column:
    """A) first and so on, a line each."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char((i + 65).cast("long")), F.lit(") "), o)), "\n")


def chat(user: Column, system: str) -> Column:
    """A system and a user message in chat markup, with the beginning of an answer without thoughts."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}{END}\n{USER}"), user, F.lit(f"{END}\n<|im_start|>assistant\n<think>\n\n</think>\n\n"))


def partition(x: Column, mark: str) -> tuple[Column, Column, Column]:
    """What comes before the first mark, whether it is there, and what comes after it."""
    at = F.instr(x, F.lit(mark))
    return F.when(at > 0, F.substr(x, F.lit(1), at - 1)).otherwise(x), at > 0, F.when(at > 0, F.substr(x, at + len(mark))).otherwise("")


def routing_view(prompt: Column) -> Column:
    """A chat prompt without its signal values: context, definitions and question stay. Null for an unknown layout."""
    before, _, rest = partition(prompt, USER)
    user, ended, suffix = partition(rest, END)
    head, found, tail = partition(user, HISTORY)
    forecast = F.when(found & F.contains(tail, F.lit(FUTURE)), F.regexp_replace(head, r"\s+$", ""))
    evidence, asked, question = partition(user, "\n\nQuestion:\n")
    notes = stripped(F.regexp_extract(evidence, rf"(?s)(?:^|\n)((?:{DEFINITIONS}|{CLARIFICATION})\n.*)$", 1))
    analysis = F.when(asked, F.concat(F.lit(ANALYSIS.strip() + "\n\n"), F.when(notes != "", F.concat(notes, F.lit("\n\n"))).otherwise(""), F.lit("Question:\n"), question))
    view = F.when(F.startswith(user, F.lit(FORECAST)), forecast).when(F.startswith(user, F.lit(ANALYSIS + "Evidence:\n")), analysis)
    return F.when(ended, F.concat(before, F.lit(USER), view, F.lit(END), suffix))


def strict(text: Column, stamps: Column) -> Column:
    """Whether a completion is one forecast block of exactly the requested stamps, a line each, and nothing else."""
    lines = F.transform(stamps, lambda t: F.concat(F.lit(r"\(\s*\Q"), t, F.lit(rf"\E\s*,\s*{NUMBER}\)\n")))
    return F.regexp_like(text, F.concat(F.lit(r"\A<forecast>\n"), F.array_join(lines, ""), F.lit(r"</forecast>\z")))


def exam(questions: DataFrame, concepts: DataFrame, most: int = 3) -> DataFrame:
    """Adds `concept_definitions`: a line 'name: description.' for each of the first `most` of a question's concepts, in their order.

    questions has id and an array `concepts` of keys; a key that concepts (key, name, description) lacks gives no line.
    """
    asked = questions.select("id", F.posexplode(F.slice("concepts", 1, most)).alias("at", "key")).join(concepts, "key")
    lines = asked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.concat("name", F.lit(": "), "description", F.lit(".")).alias("line")))).alias("l"))
    lines = lines.select("id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("concept_definitions"))
    return questions.join(lines, "id", "left").withColumn("concept_definitions", F.coalesce("concept_definitions", F.lit("")))


def scenario(fields: dict[str, Column]) -> Column:
    """'Name: value' lines of the fields that hold something."""
    lines = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k.capitalize()}: "), v)) for k, v in fields.items()]
    return stripped(F.concat_ws("\n", *lines))


def seed_of(name: Column, seed: Column) -> Column:
    """A seed under 2^31 from a digest of name and seed."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", name, seed.cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(2**31))
