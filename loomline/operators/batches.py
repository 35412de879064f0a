"""Epochs of batches: global shuffles, length buckets, quotas and shares, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import hash_key, positions


def shuffled(rows: DataFrame, seed: int, key: str) -> DataFrame:
    """Adds `position`, the place in a global order by hash: hashes are even, so ranges of them are dealt to tasks."""
    number = F.conv(F.substring(hash_key(seed, key), 1, 15), 16, 10).cast("long")
    return positions(rows.withColumn("__h", number), "__h").drop("__h")


def length_buckets(rows: DataFrame, length: str, key: str, batch: int, buckets: int, seed: int) -> DataFrame:
    """Adds `batch`, one epoch: buckets of batch * buckets shuffled rows, sorted by length inside, in shuffled order, the odd one last."""
    size = batch * buckets
    at = shuffled(rows, seed, key).withColumn("bucket", F.floor(F.col("position") / size).cast("long"))
    inside = (F.row_number().over(W.partitionBy("bucket").orderBy(length, "position")) - 1).cast("long")
    whole = at.groupBy("bucket").count()
    turn = shuffled(whole.where(F.col("count") == size).select("bucket"), seed, "bucket").withColumnRenamed("position", "turn")
    placed = at.withColumn("inside", inside).join(turn, "bucket", "left")
    last = F.floor(F.lit(rows.count() / size)).cast("long")
    return placed.withColumn("batch", F.floor((F.coalesce("turn", last) * size + F.col("inside")) / batch).cast("long")).drop("bucket", "inside", "turn", "position")


def shares(rows: DataFrame, label: str, key: str, batch: int, seed: int) -> DataFrame:
    """batch, label, share: the part that each label has of each batch of a global shuffle."""
    at = shuffled(rows, seed, key).withColumn("batch", F.floor(F.col("position") / batch).cast("long"))
    n = at.groupBy("batch", label).agg(F.count("*").alias("n"))
    return n.select("batch", label, (F.col("n") / F.sum("n").over(W.partitionBy("batch"))).alias("share"))


def quotas(rows: DataFrame, label: str, key: str, quota: dict[str, int], batch: int, seed: int) -> DataFrame:
    """At most quota[label] rows of each label, drawn by hash, in batches of one label."""
    most = F.coalesce(*[F.when(F.col(label) == k, n) for k, n in quota.items()], F.lit(0))
    rank = F.row_number().over(W.partitionBy(label).orderBy(hash_key(seed, key), key))
    drawn = rows.withColumn("__r", rank).where((F.col("__r") <= max(quota.values())) & (F.col("__r") <= most))
    return drawn.withColumn("batch", F.floor((F.col("__r") - 1) / batch).cast("long")).drop("__r")


def shortest_first(rows: DataFrame, length: str, key: str, bucket: int, count: int, seed: int) -> DataFrame:
    """The `count` shortest of `bucket` rows drawn by hash."""
    return rows.orderBy(hash_key(seed, key), key).limit(bucket).orderBy(length, key).limit(count)
