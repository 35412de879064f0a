"""Collections as dimension tables: value columns, families, quotas, benchmark cells."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
#: The terms of a benchmark cell.
TERMS = ("short", "medium", "long")


def value_columns(rows: DataFrame, ids: list[str], pattern: str = ".") -> DataFrame:
    """ids, column, value: the numeric columns whose name matches, one row a value."""
    names = [c for c, t in rows.dtypes if c not in ids and t.startswith(NUMBERS) and re.search(pattern, c)]
    return rows.select(*ids, *[F.col(c).cast("double").alias(c) for c in names]).unpivot(ids, names, "column", "value")


def quotas(names: DataFrame, target: int) -> DataFrame:
    """family, names, quota: rows that each name of a family may give for a target of all families."""
    n = names.groupBy("family").agg(F.count("*").alias("names"))
    families = n.agg(F.count("*").alias("families"))  # one row
    share = F.ceil(2 * F.lit(float(target)) / F.col("families"))
    return n.join(F.broadcast(families)).select("family", "names", F.greatest(F.lit(256), F.ceil(1.5 * share / F.col("names"))).cast("long").alias("quota"))


def in_families(items: DataFrame, known: DataFrame) -> DataFrame:
    """Adds family (item_id without its last two parts) and keeps those of the known families."""
    return items.withColumn("family", F.regexp_replace("item_id", "(_[^_]*){2}$", "")).join(known.select("family").distinct(), "family", "left_semi")


def cells(datasets: DataFrame, long_ones: DataFrame) -> DataFrame:
    """dataset, term: short for all, medium and long for those listed."""
    listed = long_ones.select("dataset").distinct().withColumn("listed", F.lit(True))
    out = datasets.join(listed, "dataset", "left").select("dataset", "listed", F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return out.where("term = 'short' or listed").select("dataset", "term")
