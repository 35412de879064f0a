"""Shared helpers: the cluster's scratch folder, tables cut from their lineage, lambda-bound values."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; one of our own only where none is set and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="loomline-", dir=os.environ.get("LOOMLINE_SCRATCH"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a lost executor then costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that cut() made and that nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until df has no such column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def named(df: DataFrame, *names: str) -> list[Column]:
    """Columns of df (all of them if none is named) whatever their names hold: dots, blanks, back quotes."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names or df.columns]


def short_batches(spark: SparkSession, most: int = 2000) -> None:
    """Rows reach Python `most` at a time, or as few as the session already asks for: with whole texts Spark's 10,000 fill a small executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > most:
        spark.conf.set(name, str(most))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: a lambda variable is not inlined again."""
    return F.transform(F.array(value), body)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, in place."""
    x ^= x >> np.uint64(33)
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


def randoms(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words, the same on every machine."""
    with np.errstate(over="ignore"):
        x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(x)
