"""Selection of rows: hash-ordered samples, deduplication, balance, folds, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_key(seed: int, *keys: str) -> Column:
    """Order of a seeded draw: the same on any cluster and for any partitioning."""
    return F.sha2(F.concat_ws("\u0001", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def capped(rows: DataFrame, group: list[str], most: int, seed: int, *keys: str) -> DataFrame:
    """At most `most` rows of each group, drawn by hash (a ranked limit, pushed below the shuffle by Spark)."""
    order = W.partitionBy(*group).orderBy(hash_key(seed, *keys), *keys)
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most)


def first_of(rows: DataFrame, digest: list[str], order: list[str]) -> DataFrame:
    """The first row of each digest."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*digest).orderBy(*order))).where("__n = 1").drop("__n")


def interleaved(rows: DataFrame, group: list[str], seed: int, *keys: str) -> DataFrame:
    """Adds depth: the row's place in its shuffled group. Ordering by (depth, group) deals groups in turn.

    Hashes are even, so a group is ranked in 256 ranges of them, and the counts of the ranges before are added: the
    largest group is no task of its own.
    """
    at = rows.withColumn("__k", hash_key(seed, *keys)).withColumn("__p", F.substring("__k", 1, 2))
    counts = at.groupBy(*group, "__p").agg(F.count("*").alias("__c"))
    upto = W.partitionBy(*group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(upto), F.lit(0))).drop("__c")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "__p"]]
    ranked = at.withColumn("__r", F.row_number().over(W.partitionBy(*group, "__p").orderBy("__k", *keys)))
    out = ranked.alias("l").join(before.alias("r"), same)
    return out.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("__before") + F.col("__r")).cast("long").alias("depth"))


def excluded(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def fold(key: Column, folds: int = 10) -> Column:
    """First eight bytes of SHA-256, little-endian, modulo the number of folds."""
    pairs = F.regexp_extract_all(F.substring(F.sha2(key, 256), 1, 16), F.lit("(..)"), 1)
    return (F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("decimal(20,0)") % folds).cast("long")


def positions(rows: DataFrame, key: str) -> DataFrame:
    """Adds `position`, the global place by a unique long key (nulls first), without one task holding all rows.

    Quantiles of the key cut it into as many ranges as a shuffle has partitions; ranks inside a range are added to the
    counts of the ranges before it. Rows that repeat a key get places of their own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(m).cast("long") for m in sorted(set(marks))]) if marks else F.array().cast("array<long>")
    at = rows.withColumn("__b", F.when(F.col(key).isNull(), -1).otherwise(F.size(F.filter(bounds, lambda m: m < F.col(key)))))
    counts = at.groupBy("__b").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = at.withColumn("__r", F.row_number().over(W.partitionBy("__b").orderBy(key)))
    # as many rows as ranges
    return ranked.join(F.broadcast(before), "__b").withColumn("position", (F.col("__before") + F.col("__r") - 1).cast("long")).drop("__b", "__r", "__before")


def contiguous_shard(rows: DataFrame, key: str, shard: int, shards: int) -> DataFrame:
    """Rows at [n shard / shards, n (shard + 1) / shards) by key."""
    n = rows.count()
    return positions(rows, key).where((F.col("position") >= n * shard // shards) & (F.col("position") < n * (shard + 1) // shards))
