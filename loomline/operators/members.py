"""Members of an ensemble: running a forecaster over requests, levels, gates, variants, routing of answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .pooling import LEVELS

FORECAST = "window string, model string, step int, q array<double>"


def forecasts(requests: DataFrame, model: str, run: Callable[[pd.DataFrame], list], batch: int = 256, most: int = 8192) -> DataFrame:
    """window, model, step, q from requests (window, history, horizon, freq) by a plugged-in function.

    Requests of one horizon and frequency go to it in batches of about `batch`: run(frame) returns for each row a list of
    `horizon` lists of nine deciles. Deciles are sorted; a batch that fails, and a value that is not finite or beyond
    1e30, gives nulls in place of a forecast, so that it can be borrowed later.
    """
    size = requests.groupBy("horizon", "freq").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("window"), F.greatest(F.ceil(F.col("n") / batch), F.lit(1))).cast("int")
    rows = requests.join(size, ["horizon", "freq"]).select("window", F.slice("history", F.greatest(F.size("history") - most + 1, F.lit(1)), F.lit(most)).alias("history"), "horizon", "freq", part.alias("part"))

    def go(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("window")
        horizon = int(frame.horizon.iloc[0])
        try:
            got = run(frame)
        except Exception:  # noqa: BLE001  a model may fail in any way; its batch is then missing
            got = [None] * len(frame)
        out = []
        for window, steps in zip(frame.window, got, strict=True):
            for i in range(horizon):
                q = None if steps is None else sorted(float(x) for x in steps[i])
                out.append((window, model, i + 1, q if q and all(abs(x) < 1e30 for x in q) else None))
        return pd.DataFrame(out, columns=["window", "model", "step", "q"])

    return rows.groupBy("horizon", "freq", "part").applyInPandas(go, FORECAST)


def fan_out(requests: DataFrame, models: dict[str, Callable], done: DataFrame | None = None, **options) -> DataFrame:
    """All models on all requests; (window, model) that `done` has are not run again, and its rows are part of the result."""
    out = done
    for name, run in models.items():
        todo = requests if done is None else requests.join(done.where(F.col("model") == name).select("window").distinct(), "window", "left_anti")
        got = forecasts(todo, name, run, **options)
        out = got if out is None else out.unionByName(got)
    return out


def relevelled(values: Column, source: list[float], target: list[float] = LEVELS) -> Column:
    """Quantiles at `target` levels from those at `source` levels: on the line between neighbours, the ends held."""
    def one(t):
        upper = min(max(sum(s < t for s in source), 1), len(source) - 1)
        share = min(max((t - source[upper - 1]) / (source[upper] - source[upper - 1]), 0.0), 1.0)
        return values[upper - 1] + share * (values[upper] - values[upper - 1])

    return F.array(*map(one, target))


def candidates(core: DataFrame, extra: DataFrame) -> DataFrame:
    """Core and extra members as one table with sorted deciles."""
    return core.unionByName(extra).withColumn("q", F.array_sort("q"))


def gating_frame(rows: DataFrame, columns: list[str], categories: dict[str, list[str]]) -> DataFrame:
    """rows with the named columns in order (missing ones null), those with categories as their number, unknown ones null."""
    def column(c):
        v = F.col(c) if c in rows.columns else F.lit(None)
        if c in categories:
            at = F.array_position(F.array(*map(F.lit, categories[c])), v.cast("string"))
            return F.when(at > 0, at - 1).alias(c)
        return v.cast("double").alias(c)

    return rows.select("window", *map(column, columns))


def gate_weights(logits: DataFrame) -> DataFrame:
    """window, model, weight: softmax over the members of each window, from (window, model, logit)."""
    w = W.partitionBy("window")
    e = logits.withColumn("e", F.exp(F.col("logit") - F.max("logit").over(w)))
    return e.select("window", "model", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def equal_weights(members: DataFrame, names: list[str] | None = None) -> DataFrame:
    """window, model, weight: all members alike, or the named ones."""
    some = members.select("window", "model").distinct()
    some = some if names is None else some.where(F.col("model").isin(names))
    return some.withColumn("weight", 1.0 / F.count("*").over(W.partitionBy("window")))


def reference(pool: DataFrame, gated: DataFrame, mass: float, ready: DataFrame | None = None) -> DataFrame:
    """window, step, q: the pool blended with the gate (`ready` in its place where there is one); the pool where neither is.

    All have (window, step, q).
    """
    from .pooling import blended

    right = gated.select("window", "step", F.col("q").alias("gate"))
    if ready is not None:
        right = right.join(ready.select("window", "step", F.col("q").alias("ready")), ["window", "step"], "full").select("window", "step", F.coalesce("ready", "gate").alias("gate"))
    return pool.join(right, ["window", "step"], "left").select("window", "step", blended(F.col("q"), F.col("gate"), mass).alias("q"))


def selected(text: Column, full: Column, weights: list[float], bias: float, share: float) -> Column:
    """Chance that an answer is numerical: the sigmoid of a linear form of two state vectors."""
    mixed = F.zip_with(text, full, lambda a, b: (1 - share) * a.cast("double") + share * b.cast("double"))
    z = F.aggregate(F.zip_with(mixed, F.array(*map(F.lit, weights)), lambda a, w: a * w), F.lit(float(bias)), lambda a, x: a + x)
    return 1 / (1 + F.exp(-z))


def log_loss(chance: Column, label: Column) -> Column:
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), chance))
    return -F.when(label == 1, F.log(p)).otherwise(F.log(1 - p))


def encoded_once(rows: DataFrame, view: str, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what encode() adds to their view; each distinct view is encoded once."""
    return rows.join(encode(rows.select(view).distinct()), view)


def kind_of(weights: Column, override: int | None = None) -> Column:
    """0 (numerical) where the first weight is over a half, else 1; top-1 by weights of more experts; or one for all."""
    if override is not None:
        return F.lit(override)
    return F.when(F.size(weights) == 2, F.when(weights[0] > 0.5, 0).otherwise(1)).otherwise(F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def routed_forecasts(requests: DataFrame, numerical: DataFrame, texts: DataFrame) -> DataFrame:
    """request, kind, values, problem in one table: requests (request, kind, stamps) with kind 0 take their numerical values, others parse a completion.

    numerical has (request, values), texts has (request, text); a request without either has a problem.
    """
    from ..functions.text import parsed

    a = requests.where("kind = 0").join(numerical, "request", "left").select("request", "kind", "values", F.when(F.col("values").isNull(), "no forecast").alias("problem"))
    b = parsed(requests.where("kind <> 0").join(texts, "request", "left"), "text", "stamps").select("request", "kind", "values", "problem")
    return a.unionByName(b)


def routed_answers(questions: DataFrame, texts: DataFrame) -> DataFrame:
    """question, message, choice: questions (question, message, options) with the option that their completion names (null: none)."""
    from ..functions.text import choice

    return questions.join(texts, "question", "left").select("question", "message", choice(F.col("text"), F.col("options")).alias("choice"))


def trajectories(sampled: Column, drawn: Column) -> Column:
    """Sampled paths where there are any, else drawn ones."""
    return F.coalesce(sampled, drawn)



def forecast_batch(requests: DataFrame, numerical: DataFrame, texts: DataFrame, weights: list[list[float]], bias: list[float], share: float = 0.5, override: int | None = None) -> DataFrame:
    """position, request, kind, values, problem: requests (position, request, text_state, full_state, stamps) routed by a linear form of their states.

    Kind 0 takes its numerical forecast, any other parses its completion; the rows keep the requests' positions, and a
    request without states goes where equal weights would.
    """
    from .pooling import routed

    even = F.array_repeat(F.lit(0.0), len(weights[0]))
    rows = requests.withColumns({c: F.coalesce(F.col(c).cast("array<double>"), even) for c in ("text_state", "full_state")})
    rows = routed(rows, "text_state", "full_state", weights, bias, share)
    rows = rows.withColumn("kind", kind_of(F.array(*[F.col(f"w{i}") for i in range(len(weights))]), override))
    told = routed_forecasts(rows.select("request", "kind", "stamps"), numerical, texts)
    return rows.select("position", "request").join(told, "request")


def answer_batch(questions: DataFrame, series: DataFrame, texts: DataFrame) -> DataFrame:
    """id, message, choice, problem: questions (id, question, options) rendered with their series, and the option that each answer names.

    A question that does not render is not answered; neither is one whose answer names no option.
    """
    from ..functions.text import choice
    from .examples import analysis_messages

    told = analysis_messages(questions, series)
    rows = questions.select("id", "options").join(told, "id").join(texts, "id", "left")
    picked = F.when(F.col("problem").isNull(), choice(F.col("text"), F.col("options")))
    none = F.when(F.col("text").isNull(), "no answer").when((F.size("options") > 0) & picked.isNull(), "no option named")
    return rows.select("id", "message", picked.alias("choice"), F.coalesce("problem", none).alias("problem"))
