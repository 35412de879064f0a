"""Stamps and calendars: shifts by periods, complete surroundings, the weekly hint of daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Months of the units that are counted in months, hours of the others.
MONTHS, HOURS = {"month": 1, "quarter": 3, "year": 12}, {"hour": 1, "day": 24, "week": 168}


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a stamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def shifted(ts: str, unit: str, n: str) -> Column:
    """The start of the period (column `unit`) that holds ts, n periods on; null for an unknown unit."""
    out = F.lit(None).cast("timestamp_ntz")
    for u, k in MONTHS.items():
        out = F.when(F.col(unit) == u, F.expr(f"cast(date_trunc('{u}', {ts}) as timestamp_ntz) + make_ym_interval(0, {n} * {k})")).otherwise(out)
    for u, k in HOURS.items():
        out = F.when(F.col(unit) == u, F.expr(f"cast(date_trunc('{u}', {ts}) as timestamp_ntz) + make_dt_interval(0, {n} * {k})")).otherwise(out)
    return out


def complete_anchors(rows: DataFrame, past: int, future: int) -> DataFrame:
    """Rows of (series_id, pos), positions distinct, with each of the `past` positions before and `future` from pos on."""
    near = W.partitionBy("series_id").orderBy("pos").rangeBetween(-past, future - 1)
    return rows.withColumn("__n", F.count("*").over(near)).where(F.col("__n") == past + future).drop("__n")


def weekly_hint(s: DataFrame) -> DataFrame:
    """weekly, annual: covariance at lags 7 and 365 over variance (-1 and 0.5 for short series); hint where weekly is more."""
    whole, w = W.partitionBy("series_id"), W.partitionBy("series_id").orderBy("pos")
    c = s.withColumn("v", F.col("value") - F.avg("value").over(whole))
    c = c.withColumns({"l7": F.lag("v", 7).over(w), "l365": F.lag("v", 365).over(w)})
    a = c.groupBy("series_id").agg(F.count("*").alias("n"), F.greatest(F.avg(F.col("v") * F.col("v")), F.lit(1e-8)).alias("var"), F.avg(F.col("v") * F.col("l7")).alias("w"), F.avg(F.col("v") * F.col("l365")).alias("y"))
    a = a.select("series_id", "n", F.when(F.col("n") >= 15, F.col("w") / F.col("var")).otherwise(-1.0).alias("weekly"), F.when(F.col("n") >= 366, F.col("y") / F.col("var")).otherwise(0.5).alias("annual"))
    return a.withColumn("hint", (F.col("n") >= 15) & (F.col("weekly") > F.col("annual")))


#: Units of a calendar, from the smallest on.
UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")


def stamp(ts: Column) -> Column:
    """A stamp as text: the date alone at midnight, else date and time."""
    return F.when((F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0), F.date_format(ts, "yyyy-MM-dd")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def period(ts: Column, unit: Column, n: Column) -> Column:
    """The beginning of the period that holds ts, n periods on; null for an unknown unit."""
    out = F.lit(None).cast("timestamp_ntz")
    for u in UNITS:
        out = F.when(unit == u, F.timestamp_add(u.upper(), n.cast("int"), F.date_trunc(u, ts).cast("timestamp_ntz")).cast("timestamp_ntz")).otherwise(out)
    return out


def calendar(start: Column, unit: Column, step: Column, past: Column, future: Column) -> tuple[Column, Column]:
    """Texts of the `past` stamps from the period that holds `start` on, and of the `future` ones that follow, `step` units apart.

    Periods are added to the beginning of the first one, so that months, quarters and years keep to their first day. Null
    where the start or the unit is unknown. A text without a time is a date.
    """
    ts = start.cast("timestamp_ntz")
    known = ts.isNotNull() & F.coalesce(unit.isin(*UNITS), F.lit(False))
    # an empty stretch has no stamp: sequences would run backwards
    texts = lambda first, n: F.when(known, F.when(n > 0, F.transform(F.sequence(first, first + n - 1), lambda i: stamp(period(ts, unit, i * step)))).otherwise(F.array().cast("array<string>")))
    return texts(F.lit(0), past), texts(past, future)
