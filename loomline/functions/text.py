"""Requests as text and completions back to values, in column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .series import is_finite

#: The form of a number and of a forecast block.
NUMBER = r"[-+]?(?:(?:\d{1,18}(?:\.\d{1,12})?)|(?:\.\d{1,12}))(?:[eE][-+]?\d{1,2})?"
OPEN, CLOSE = "<forecast>", "</forecast>"


def formatted(x: Column, form: str = ".6g", whole: float = 1e6) -> Column:
    """x by a format of significant digits below `whole`, and as a whole number from there on; null for what is not finite.

    Arrow batches: the JVM's %g rounds the shortest decimal form, not the double, and differs in the last digit of ties.
    """

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format(v, form) if v < whole else f"{v:.0f}", na_action="ignore").astype(object)

    return run(F.when(is_finite(x), x.cast("double")))


def formatted_all(v: Column, form: str = ".4g") -> Column:
    """An array as texts by a format; null where any value is missing or not finite."""

    @F.pandas_udf("array<string>")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda a: [format(x, form) for x in a], na_action="ignore")

    return run(F.when(F.forall(v, is_finite), v.cast("array<double>")))


def number(x: Column) -> Column:
    """Six significant digits without trailing zeros, whole numbers from a million on (not for those under minus a million)."""
    return formatted(x)


def measured(v: float) -> str:
    """Five decimals without trailing zeros; four significant digits for large and tiny numbers; 0 for what is not finite."""
    if abs(v) >= 1e4 or 0 < abs(v) < 1e-4:
        return f"{v:.4g}" if abs(v) < float("inf") else "0"
    return f"{v:.5f}".rstrip("0").rstrip(".") if v == v else "0"


def measure(x: Column) -> Column:
    """measured() of a column; 0 for null, too."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(measured, na_action="ignore").astype(object)

    return F.coalesce(run(F.when(is_finite(x), x.cast("double"))), F.lit("0"))


def block(pairs: Column) -> Column:
    """The forecast block of an array of (stamp, text)."""
    lines = F.transform(pairs, lambda p: F.concat(F.lit("("), p["stamp"], F.lit(", "), p["text"], F.lit(")\n")))
    return F.concat(F.lit(OPEN + "\n"), F.array_join(lines, ""), F.lit(CLOSE))


def budget(horizon: Column) -> Column:
    """Tokens that a completion may take."""
    return F.greatest(F.lit(512), 64 + 40 * horizon)


def parsed(rows: DataFrame, text: str, stamps: str) -> DataFrame:
    """Adds `values` (array by requested stamp, null where rejected) and `problem` (null where none).

    The last block counts, of a stamp that repeats the last value. No block, a missing stamp (one whose number has not the
    fixed form, too) and a value that is not finite reject the row. Null text has no block.
    """
    blocks = F.regexp_extract_all(F.col(text), F.lit("(?is)<forecast>(.*?)</forecast>"), 1)
    pairs = F.regexp_extract_all(F.element_at("__b", -1), F.lit(rf"(?s)(\(\s*[^,\r\n]+?\s*,\s*{NUMBER}\s*\))"), 1)
    rows = rows.withColumn("__b", blocks).withColumn("__p", F.when(F.size("__b") > 0, F.reverse(pairs)))
    stamp = lambda p: F.trim(F.regexp_extract(p, r"^\(\s*([^,\r\n]+?)\s*,", 1), F.lit("'\""))
    value = lambda p: F.regexp_extract(p, rf",\s*({NUMBER})\s*\)$", 1).cast("double")
    rows = rows.withColumn("__f", F.transform("__p", lambda p: F.struct(stamp(p).alias("stamp"), value(p).alias("value"))))
    found = F.transform(stamps, lambda t: F.get(F.filter("__f", lambda p: p["stamp"] == t), F.lit(0))["value"])
    rows = rows.withColumn("__v", found)
    problem = (
        F.when(F.col("__p").isNull(), "no block").when(F.exists("__v", lambda v: v.isNull()), "missing stamp")
        .when(F.exists("__v", lambda v: F.isnan(v) | (F.abs(v) == float("inf"))), "not finite")
    )
    return rows.withColumn("problem", problem).withColumn("values", F.when(F.col("problem").isNull(), F.col("__v"))).drop("__b", "__p", "__f", "__v")


def choice(text: Column, options: Column) -> Column:
    """Place (from 0) of the first option that occurs as `A) option` in the text, whatever its case; null for none."""
    said = lambda o, i: F.contains(F.lower(text), F.lower(F.concat(F.char((i + 65).cast("long")), F.lit(") "), o)))
    hits = F.transform(options, lambda o, i: F.when(said(o, i), i))
    return F.array_min(hits)


def listed(text: Column) -> Column:
    """The numbers of the one bracketed list in a text; null where there is none or more than one."""
    lists = F.regexp_extract_all(text, F.lit(rf"\[(\s*{NUMBER}(?:\s*,\s*{NUMBER})*\s*)\]"), 1)
    return F.when(F.size(lists) == 1, F.transform(F.split(F.get(lists, F.lit(0)), ","), lambda x: F.trim(x).cast("double")))


def unlisted(text: Column, phrase: str) -> Column:
    """The text with its bracketed lists replaced by a phrase."""
    return F.regexp_replace(text, rf"\[\s*{NUMBER}(?:\s*,\s*{NUMBER})*\s*\]", phrase)
