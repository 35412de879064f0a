"""Scores of forecasts and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import is_finite
from .pooling import LEVELS


def cell_scores(f: DataFrame, cell: list[str]) -> DataFrame:
    """Seasonal MASE and pinball CRPS per cell from (q, y, scale), one row a step; y that is null or not finite is masked, such a scale, or 0, drops the window from MASE."""
    y = F.when(is_finite(F.col("y")), F.col("y"))
    e = F.when(is_finite(F.col("scale")) & (F.col("scale") > 0), F.abs(F.col("q")[4] - y) / F.col("scale"))
    loss = [F.sum(2 * F.greatest(p * (y - F.col("q")[i]), (p - 1) * (y - F.col("q")[i]))) for i, p in enumerate(LEVELS)]
    level = F.greatest(F.sum(F.abs(y)), F.lit(1e-8))
    return f.groupBy(*cell).agg(F.avg(e).alias("mase"), (sum(loss[1:], loss[0]) / 9.0 / level).alias("crps"))


def complete_peers(board: DataFrame) -> DataFrame:
    """Rows of the models that have a finite score in every cell; an error where there are cells and no such model."""
    ok = board.where(is_finite(F.col("mase")))
    cells = board.agg(F.count_distinct("cell").alias("cells"))  # one row
    each = ok.groupBy("model").agg(F.count_distinct("cell").alias("n")).join(F.broadcast(cells))
    told = board.select("model").distinct().join(each, "model", "left").withColumn("full", F.coalesce(F.col("n") == F.col("cells"), F.lit(False)))
    if told.agg(F.max("full")).first()[0] is False:
        raise ValueError("no model has a score in every cell")
    return ok.join(told.where("full").select("model"), "model", "left_semi")


def tie_ranks(scores: DataFrame) -> DataFrame:
    """1 + lower + half of the equal others, per cell."""
    lower = F.rank().over(W.partitionBy("cell").orderBy("mase"))
    same = F.count("*").over(W.partitionBy("cell", "mase"))
    return scores.withColumn("rank", lower + (same - 1) / 2.0)


def board_report(ranked: DataFrame) -> DataFrame:
    """Mean rank and geometric mean score of each model."""
    return ranked.groupBy("model").agg(F.avg("rank").alias("mean_rank"), F.exp(F.avg(F.log(F.greatest("mase", F.lit(1e-12))))).alias("geometric_mase"))


def sample_crps(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Unbiased sample CRPS per key from (sample value s, y); null for one sample.

    Of the pairs of samples only those count that lie on one side of y, by the distance of the nearer one: a sample
    below y is the nearer one for all below it, one above for all above it. So the terms of one sorted window are
    never negative and cancel nothing, and no sample is joined with another.
    """
    w = W.partitionBy(*keys)
    x = paths.withColumns({"i": F.row_number().over(w.orderBy("s")), "n": F.count("*").over(w)})
    gap = F.when(F.col("s") <= F.col("y"), (F.col("i") - 1) * (F.col("y") - F.col("s"))).otherwise((F.col("n") - F.col("i")) * (F.col("s") - F.col("y")))
    n = F.first("n")
    return x.groupBy(*keys).agg((F.sum(2 * gap) / F.nullif(n * (n - 1), F.lit(0))).alias("crps"))


def capped_score(rows: DataFrame, most: float = 5.0) -> DataFrame:
    """Weighted mean of scores capped at `most`."""
    return rows.agg((F.sum(F.col("weight") * F.least(F.col("metric"), F.lit(most))) / F.sum("weight")).alias("score"), F.count("*").alias("n"))


def coverage(forecasts: DataFrame, windows: DataFrame, each: int) -> DataFrame:
    """cell, forecasts, expected: counts to compare, zero where a side lacks the cell."""
    a = forecasts.groupBy("cell").agg(F.count("*").alias("forecasts"))
    b = windows.groupBy("cell").agg((F.count("*") * each).alias("expected"))
    return a.join(b, "cell", "full_outer").select("cell", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("forecasts", "expected")])


def shard_problems(shards: DataFrame, windows: DataFrame, levels: int = 9) -> DataFrame:
    """window, problem of forecast shards (shard, window, step, q) against windows (window, horizon): each check has its own name.

    An index that is null, negative or unknown, one in several shards, steps that repeat, too few or too many steps, rows
    that have not `levels` values, values that are not finite, and windows without a forecast.
    """
    known = windows.select("window", "horizon")
    each = shards.groupBy("window").agg(
        F.count("*").alias("n"), F.count_distinct("step").alias("steps"), F.count_distinct("shard").alias("shards"),
        F.bool_and(F.size("q") == levels).alias("wide"), F.bool_and(F.forall("q", is_finite)).alias("fine"),
    )
    at = each.join(known, "window", "left")
    tests = {
        "invalid index": F.col("window").isNull() | (F.col("window") < 0), "outside": (F.col("window") >= 0) & F.col("horizon").isNull(), "in several shards": F.col("shards") > 1,
        "repeated steps": F.col("n") > F.col("steps"), "wrong length": F.col("steps") != F.col("horizon"), "wrong width": ~F.col("wide"), "not finite": ~F.coalesce("fine", F.lit(False)),
    }
    found = at.select("window", F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("problem"))
    return found.union(known.join(shards, "window", "left_anti").select("window", F.lit("missing").alias("problem")))


def metric_problems(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, problem: cells without a valid score of either kind, so that nothing is ranked on them."""
    at = cells.select("cell").join(scores, "cell", "left")
    return at.select("cell", F.when(~F.coalesce(is_finite(F.col("mase")), F.lit(False)), "no mase").when(~F.coalesce(is_finite(F.col("crps")), F.lit(False)), "no crps").alias("problem")).where("problem is not null")


def accuracy(answers: DataFrame) -> DataFrame:
    """n, correct, accuracy: a response is correct that holds 'LETTER) answer', whatever its case; from (response, options, answer)."""
    at = F.array_position("options", F.col("answer"))
    target = F.concat(F.char((at + 64).cast("long")), F.lit(") "), "answer")
    right = F.coalesce((at > 0) & F.contains(F.lower("response"), F.lower(target)), F.lit(False))
    return answers.agg(F.count("*").alias("n"), F.count_if(right).alias("correct")).withColumn("accuracy", F.try_divide("correct", "n"))
