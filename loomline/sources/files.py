"""Files in and out: JSON lines, tables of any format, blocks with a manifest, boards, selections by position, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

from ..functions.series import is_finite


def _fine(value: Column, kind, name: str) -> Column:
    """value, or an error where a number in it, at any depth, is NaN or infinite."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(value.isNull() | is_finite(value), value).otherwise(F.raise_error(F.lit(f"{name} is not finite")).cast(kind))
    if isinstance(kind, ArrayType) and _has_numbers(kind):
        return F.transform(value, lambda x: _fine(x, kind.elementType, name))
    if isinstance(kind, MapType) and _has_numbers(kind):
        return F.transform_values(value, lambda _, x: _fine(x, kind.valueType, name))
    if isinstance(kind, StructType) and _has_numbers(kind):
        fields = [_fine(value.getField(f.name), f.dataType, f"{name}.{f.name}").alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_numbers(kind) -> bool:
    return any(x in kind.simpleString() for x in ("double", "float"))


def write_json_lines(rows: DataFrame, path: str) -> int:
    """Write rows as JSON lines, in place of what was there, and return their number; null values are written too.

    A number that is NaN or infinite, in an array, map or struct as well, is an error of the task that meets it. Rows go
    to a folder beside `path` first, which takes its place when all are written: after an error the old file is still
    there. The rows are counted by the write itself.
    """
    name = lambda c: "`" + c.replace("`", "``") + "`"
    checked = rows.select(*[_fine(F.col(name(f.name)), f.dataType, f.name).alias(f.name) for f in rows.schema.fields])
    counted = Observation()
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    files = new.getFileSystem(conf)
    try:
        checked.observe(counted, F.count(F.lit(1)).alias("n")).write.option("ignoreNullFields", False).json(beside)
    except BaseException:
        files.delete(new, True)
        raise
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{beside} could not take the place of {path}")
    return counted.get["n"]


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header (quoted line ends allowed), JSON lines (.jsonl) or a JSON array (.json), by the name's end."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith(".csv"):
        return reader.csv(path, header=True, multiLine=True, escape='"')
    return reader.json(path, multiLine=not path.rstrip("/").endswith(".jsonl"))


def at_positions(rows: DataFrame, selection: DataFrame) -> DataFrame:
    """The rows of Parquet files that a selection (file, row_index) names, with both columns; the selection is joined, not looked up row by row."""
    named = rows.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return named.join(selection.select("file", "row_index").distinct(), ["file", "row_index"])


def looked_up(metadata: DataFrame, series: DataFrame, past: Column, future: Column) -> DataFrame:
    """metadata with `history`, `future` and `problem`: the slices of its series from start_idx on (past, then future values).

    A series that is missing, or too short, gives null slices and a problem.
    """
    out = metadata.join(series.select("dataset_name", "series_idx", "target"), ["dataset_name", "series_idx"], "left")
    short = F.size("target") < F.col("start_idx") + past + future
    problem = F.when(F.col("target").isNull(), "no series").when(short, "incomplete")
    part = lambda at, n: F.when(problem.isNull(), F.slice("target", (at + 1).cast("int"), n.cast("int")))
    return out.withColumns({"problem": problem, "history": part(F.col("start_idx"), past), "future": part(F.col("start_idx") + past, future)}).drop("target")


def bounded_scan(series: DataFrame, dataset: str, key: str, most: int) -> DataFrame:
    """The first `most` series of each dataset, by key: a ranked limit, so what is left out is not carried on."""
    from pyspark.sql import Window as W

    return series.withColumn("__r", F.row_number().over(W.partitionBy(dataset).orderBy(key))).where(F.col("__r") <= most).drop("__r")


def stored_block(spark: SparkSession, root: str, name: str, build) -> DataFrame:
    """The block `name` under root: read where it has been written (a finished write leaves _SUCCESS), else built and written."""
    path = f"{root}/block={name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).withColumn("block", F.lit(name))


def stored_blocks(spark: SparkSession, root: str, build, by: str) -> DataFrame:
    """All blocks under root: read where they have been written, else built and written in one pass, a directory for each value of `by` (null too)."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").partitionBy(by).parquet(root)
    return spark.read.parquet(root).withColumn(by, F.col(by).cast("string"))


def manifest(blocks: DataFrame) -> DataFrame:
    """block, n."""
    return blocks.groupBy("block").agg(F.count("*").alias("n"))


def properties(names: DataFrame, aliases: DataFrame, known: DataFrame, domain: str = "Other", variates: int = 1) -> DataFrame:
    """names (name) with domain and num_variates of its base (before /, lower case) or the base's alias; defaults where neither is known."""
    base = F.lower(F.substring_index("name", "/", 1))
    out = names.withColumn("base", base).join(aliases.select(F.col("alias").alias("base"), "property"), "base", "left")
    out = out.withColumn("key", F.coalesce("property", "base")).join(known.select(F.col("name").alias("key"), F.col("domain").alias("d"), F.col("num_variates").alias("v")), "key", "left")
    return out.select("name", F.coalesce("d", F.lit(domain)).alias("domain"), F.coalesce("v", F.lit(variates)).alias("num_variates"))


def write_board(rows: DataFrame, path: str) -> None:
    """The scores of one model (a row for each cell, so one task writes them) as one CSV file with a header."""
    beside = f"{path}.{uuid.uuid4().hex}"
    rows.coalesce(1).write.csv(beside, header=True)
    jvm = rows.sparkSession._jvm
    folder, target = jvm.org.apache.hadoop.fs.Path(beside), jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(rows.sparkSession._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    files.delete(target, False)
    (part,) = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")]
    if not files.rename(part, target):
        raise OSError(f"{part} could not become {path}")
    files.delete(folder, True)


def boards(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """All results files (all_results.csv or all-results.csv) under root, a directory a model, with `model`."""
    reader = spark.read.option("inferSchema", True) if schema is None else spark.read.schema(schema)
    rows = reader.option("header", True).option("pathGlobFilter", "all[_-]results.csv").option("recursiveFileLookup", True).csv(root)
    return rows.withColumn("model", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def prepared(values: Column, most: int = 8192) -> Column:
    """A history as a board takes it: gaps filled, all missing as zeros (eight at least), four values at least by repeating the first, the last `most`."""
    from ..functions.series import edge_padded, filled

    whole = F.coalesce(filled(values), F.array_repeat(F.lit(0.0), F.greatest(F.size(values), F.lit(8))))
    padded = edge_padded(whole)
    return F.slice(padded, F.greatest(F.size(padded) - most + 1, F.lit(1)), F.lit(most))


def recent(values: Column, start: Column, most: int = 168) -> Column:
    """(history, skipped): the last `most` values, and by how many periods the start moves."""
    skipped = F.greatest(F.size(values) - most, F.lit(0))
    return F.struct(F.slice(values, skipped + 1, F.lit(most)).alias("history"), skipped.alias("skipped"), start.alias("start"))


def write_report(summary: DataFrame, details: DataFrame, path: str) -> None:
    """One summary row as JSON, and the details as Parquet."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    details.write.mode("overwrite").parquet(f"{path}/details")


def write_panel(windows: DataFrame, root: str, chosen: list[str], most: int = 8192, shown: int = 168) -> tuple[DataFrame, DataFrame]:
    """The panel of windows and the requests of the chosen blocks, written under root and read back, from one pass over the windows.

    windows: window, name, term, freq (as a board names it), unit, start, values, target, block, scale. The panel has cell
    (name before /, lower case; frequency; term), history as a board takes it (see prepared), start moved to its first
    value, target and scale (null where it is not finite or not positive). Requests are JSON lines of what the last
    `shown` values pose: window, history, start, frequency, horizon; they are drawn from the written panel.
    """
    from ..functions.calendars import period, stamp
    from ..functions.frequency import board_name

    c = F.col
    history = prepared(c("values"), most)
    freq = board_name(c("name"), c("freq"))
    moved = lambda n: F.coalesce(stamp(period(c("start").try_cast("timestamp_ntz"), c("unit"), n)), F.lit(""))
    # the inline keeps the history from being computed again wherever it is read
    rows = windows.select("*", F.inline(F.array(F.struct(history.alias("history")))))
    skipped = F.greatest(F.size("values") - F.size("history"), F.lit(0))
    rows = rows.select(
        "window", "block", F.concat_ws("/", F.lower(F.substring_index("name", "/", 1)), freq, "term").alias("cell"), freq.alias("frequency"), "unit", "history", moved(skipped).alias("start"), "target",
        F.when(is_finite(c("scale")) & (c("scale") > 0), c("scale")).alias("scale"),
    )
    rows.write.parquet(f"{root}/panel")
    panel = windows.sparkSession.read.schema(rows.schema).parquet(f"{root}/panel")
    last = recent(c("history"), c("start"), shown)
    asked = panel.where(c("block").isin(*chosen)).withColumn("r", last)
    posed = asked.select("window", c("r.history").alias("history"), moved(c("r.skipped")).alias("start"), "frequency", F.size("target").alias("horizon"))
    write_json_lines(posed, f"{root}/requests.jsonl")
    return panel, read_any(windows.sparkSession, f"{root}/requests.jsonl", posed.schema)
