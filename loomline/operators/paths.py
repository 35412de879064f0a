"""Members and paths: borrowed forecasts, mid-ranks, gated means, sampled deciles and draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import hash_key


def borrowed(f: DataFrame, ok: Column) -> DataFrame:
    """window, model, step, level, q: where a member is not ok, the mean of those that are; steps without any are dropped."""
    rows = f.withColumn("ok", ok).select("window", "model", "step", "ok", F.posexplode("q").alias("at", "v"))
    mean = F.avg(F.when(F.col("ok"), F.col("v"))).over(W.partitionBy("window", "step", "at"))
    rows = rows.withColumn("mean", mean).where("mean is not null")
    return rows.select("window", "model", "step", (F.col("at") + 1).cast("long").alias("level"), F.when(F.col("ok"), F.col("v")).otherwise(F.col("mean")).alias("q"))


def mid_ranks(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds place in [0, 1]: the lower ones and half of the equal others over all others; 0 where there is no other."""
    w = W.partitionBy(*group)
    lower, same, n = F.rank().over(w.orderBy(value)) - 1, F.count("*").over(W.partitionBy(*group, value)), F.count("*").over(w)
    return rows.withColumn("place", F.when(n > 1, (lower + (same - 1) / 2.0) / F.nullif(n - 1, F.lit(0))).otherwise(0.0))


def gated(f: DataFrame, weights: DataFrame) -> DataFrame:
    """window, step, level, q: weighted mean of the members that there are, never falling over the levels."""
    rows = f.join(weights, ["window", "model"]).select("window", "step", "weight", F.posexplode("q").alias("at", "v"))
    mean = rows.groupBy("window", "step", (F.col("at") + 1).cast("long").alias("level")).agg((F.sum(F.col("weight") * F.col("v")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("q"))
    top = F.max("q").over(W.partitionBy("window", "step").orderBy("level").rowsBetween(W.unboundedPreceding, 0))
    return mean.withColumn("q", top)


def sample_deciles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, level, q: order statistics of a key's samples (as many as a model draws, so they fit an array)."""
    v = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("v"))
    at = F.bround((F.size("v") - 1) * (F.col("k") / 10.0)).cast("int")
    return v.select(*keys, "v", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k")).select(*keys, F.col("k").cast("long").alias("level"), F.get("v", at).alias("q"))


def draws(f: DataFrame, count: int, seed: int) -> DataFrame:
    """window, model, step, draw, value: independent draws from the line through the sorted deciles, tails constant."""
    rows = f.select("window", "model", "step", F.array_sort("q").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("draw"))
    u = F.conv(F.substring(hash_key(seed, "window", "model", "step", "draw"), 1, 8), 16, 10).cast("double") / 4294967296.0
    rows = rows.withColumn("at", F.greatest(F.lit(0.1), F.least(F.lit(0.9), u)) * 10 - 1).withColumn("low", F.floor("at").cast("int"))
    low = F.get("q", F.col("low"))
    high = F.get("q", F.least(F.col("low") + 1, F.lit(8)))
    return rows.select("window", "model", "step", F.col("draw").cast("long").alias("draw"), (low + (F.col("at") - F.col("low")) * (high - low)).alias("value"))
