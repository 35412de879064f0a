"""Series, windows and forecasts that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.series import repair

HORIZON, WINDOWS, MODELS = 24, 3, ("last", "mean", "seasonal", "recent", "trend")
#: Values that the trend member fits a line to.
TREND = 64


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (event type), pos, value: sums by hour from the first to the last hour of any event since 2024-01-01, null where an hour has no event."""
    e = read(spark, sf_dir, "events")
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00"))) / 3600).cast("long")
    sums = e.groupBy(F.col("event_type").alias("series_id"), hour.alias("pos")).agg(F.round(F.sum("value"), 4).alias("value"))
    last = sums.agg(F.greatest(F.max("pos"), F.lit(719)).alias("last"), F.least(F.min("pos"), F.lit(0)).alias("first"))  # one row
    keys = e.select(F.col("event_type").alias("series_id")).distinct().join(F.broadcast(last)).select("series_id", F.explode(F.sequence("first", "last")).alias("pos"))
    return keys.join(sums, ["series_id", "pos"], "left")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (return flag), pos (days since 1995-01-01), value: shipped quantity."""
    li = read(spark, sf_dir, "lineitem")
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long")
    return li.groupBy(F.col("l_returnflag").alias("series_id"), day.alias("pos")).agg(F.round(F.sum("l_quantity"), 4).alias("value"))


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(hourly(spark, sf_dir))


def pairs(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, pos, value) twice: the first series under the name of each other one, and the others."""
    names = series.select("series_id").distinct()
    known = names.join(F.broadcast(names.agg(F.min("series_id").alias("base"))), F.col("series_id") > F.col("base"))  # one row
    left = known.select(F.col("series_id").alias("pair"), "base").join(series, F.col("base") == series.series_id).select("pair", "pos", "value")
    return left, series.join(known, "series_id").select(F.col("series_id").alias("pair"), "pos", "value")


def rolling_windows(series: DataFrame, horizon: int = HORIZON, windows: int = WINDOWS, least: int = 4) -> DataFrame:
    """(series_id, cutoff): rolling origins one horizon apart at the end, cutoffs of at least `least`."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    return n.select("series_id", F.explode(F.sequence(F.lit(windows), F.lit(1), F.lit(-1))).alias("lag"), "n").select("series_id", (F.col("n") - F.col("lag") * horizon).cast("long").alias("cutoff")).where(F.col("cutoff") >= least)


def baseline_forecasts(series: DataFrame, horizon: int = HORIZON, season: int = 24) -> DataFrame:
    """window, series_id, cutoff, model, step (from 1), q (nine deciles: the point and offsets of half a unit), y.

    A series is first gathered to one array per series (its length is that of a calendar), so that windows need no
    further join.
    """
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")).withColumn("v", F.transform("v", lambda x: x["value"]))
    w = rolling_windows(series, horizon).join(arrays, "series_id")
    h = F.slice("v", F.lit(1), F.col("cutoff").cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    tail = lambda k: F.slice(h, F.greatest(F.size(h) - k + 1, F.lit(1)), F.lit(k))

    def line(t):  # least-squares slope over 0 .. n - 1
        n = F.size(t)
        return F.when(n > 1, total(F.transform(t, lambda x, i: x * (i - (n - 1) / 2.0))) / (n * (n * n - 1) / 12.0)).otherwise(0.0)

    w = w.withColumns({"h": h, "mean": total(h) / F.size(h), "recent": total(tail(season)) / F.size(tail(season)), "trend": line(tail(TREND))})
    rows = w.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    at = lambda i: F.get(F.col("v"), i.cast("int"))
    points = {"last": at(F.col("cutoff") - 1), "mean": F.col("mean"), "recent": F.col("recent"), "trend": at(F.col("cutoff") - 1) + F.col("trend") * F.col("step")}
    points["seasonal"] = F.when(F.col("cutoff") >= season, at(F.col("cutoff") - season + (F.col("step") - 1) % season)).otherwise(points["last"])
    model = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), points[m].alias("point")) for m in MODELS]))
    out = rows.select("series_id", "cutoff", "step", at(F.col("cutoff") + F.col("step") - 1).alias("y"), model.alias("m"))
    q = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("m.point") + k * 0.5)
    return out.select(F.concat_ws("/", "series_id", "cutoff").alias("window"), "series_id", "cutoff", "m.model", F.col("step").cast("long").alias("step"), q.alias("q"), "y")
