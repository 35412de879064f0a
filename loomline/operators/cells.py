"""Rows of benchmark cells and collections: draws with held-out parts, caps, disjoint starts, mixed plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .curate import capped, hash_key, interleaved


def number(seed: int, *keys: str):
    """A whole number of 32 bits from the hash of a seed and some columns."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("long")


def cell_windows(series: DataFrame, rows_per_cell: int, seed: int, held: float = 0.1) -> DataFrame:
    """cell, series_id, cutoff, place, held: windows of each cell from (cell, series_id, n, horizon).

    A cell of rows_per_cell series and more gives the latest cutoff of twice as many series; a smaller one adds to each
    series cutoffs drawn from 4 to the latest. Of the shuffled windows rows_per_cell are kept, a tenth of those (of
    rows_per_cell at most) is held out, and the rest is repeated in turn up to the other nine tenths; place counts them.
    """
    many = series.groupBy("cell").agg(F.count("*").alias("many"))
    at = series.join(many, "cell").withColumn("latest", F.col("n") - F.col("horizon"))
    turn = F.row_number().over(W.partitionBy("cell").orderBy(hash_key(seed, "cell", "series_id"), "series_id"))
    at = at.withColumn("turn", turn).where(f"many < {rows_per_cell} or turn <= {2 * rows_per_cell}").where("latest >= 4")
    extra = F.when(F.col("many") >= rows_per_cell, 0).otherwise(F.least(F.ceil(rows_per_cell / F.col("many")), F.col("latest") - 3) - 1).cast("int")
    drawn = at.withColumn("draw", F.explode(F.sequence(F.lit(0), F.greatest(4 * extra, F.lit(0)))))
    cutoff = F.when(F.col("draw") == 0, F.col("latest")).otherwise(4 + number(seed, "cell", "series_id", "draw") % (F.col("latest") - 3))
    cuts = drawn.withColumn("cutoff", cutoff.cast("long")).groupBy("cell", "series_id", "cutoff").agg(F.min("draw").alias("draw"), F.first(extra).alias("extra"))
    own = F.row_number().over(W.partitionBy("cell", "series_id").orderBy("draw"))
    cuts = cuts.withColumn("own", own).where("own <= extra + 1")
    kept = capped(cuts, ["cell"], rows_per_cell, seed + 1, "cell", "series_id", "cutoff").withColumn("kept", F.count("*").over(W.partitionBy("cell")))
    out = F.least(F.bround(F.lit(held * rows_per_cell)), F.greatest(F.lit(1.0), F.bround(held * F.col("kept").cast("double")))).cast("long")
    kept = kept.withColumn("out", out)
    wanted = rows_per_cell - round(held * rows_per_cell)
    unique = F.col("kept") - F.col("out")
    first = F.col("rank") - F.col("out") - 1
    places = F.when(first < 0, F.array(F.lit(-1).cast("long"))).otherwise(F.when(first < wanted, F.sequence(first, F.lit(wanted - 1).cast("long"), F.greatest(unique, F.lit(1)))))
    return kept.withColumn("place", F.explode(places)).select("cell", "series_id", "cutoff", F.when(F.col("place") >= 0, F.col("place")).alias("place"), (F.col("place") < 0).alias("held"))


def disjoint_starts(series: DataFrame, width: int, core: int = 20, more: int = 36) -> DataFrame:
    """series_id, start: of each (series_id, n) `core` starts spread evenly and `more` of those that fit between them.

    Windows of `width` from these starts never overlap. What fits between two neighbours lies at whole widths behind the
    first; of all of these, numbered along the series, evenly spaced ones are taken, each once. A series shorter than
    `core` windows has the first even start alone; one shorter than a window has none.
    """
    w, many = W.partitionBy("series_id").orderBy("start"), F.count("*").over(W.partitionBy("series_id"))
    there = series.where(F.col("n") >= width).select("series_id", F.col("n").cast("long").alias("n"))
    even = there.select("*", F.explode(F.sequence(F.lit(0), F.lit(core - 1))).alias("i"))
    even = even.select("series_id", "n", F.expr(f"(i * (n - {width})) div {max(core - 1, 1)}").alias("start")).distinct()
    even = even.where(f"n >= {core * width} or start = 0")
    room = even.union(there.select("series_id", "n", F.col("n").alias("start")))
    room = room.withColumns({"low": F.coalesce(F.lag("start").over(w) + width, F.lit(0).cast("long")), "high": F.least(F.col("start"), F.col("n")) - width})
    free = room.where("high >= low").select("series_id", F.explode(F.sequence("low", "high", F.lit(width).cast("long"))).alias("start"))
    placed = free.withColumns({"place": (F.row_number().over(w) - 1).cast("long"), "many": many})
    picks = placed.where("place = 0").select("series_id", F.explode(F.sequence(F.lit(0), F.lit(more - 1))).alias("i"), "many")
    picks = picks.select("series_id", F.expr(f"(i * (many - 1)) div {max(more - 1, 1)}").alias("place")).distinct()
    return even.select("series_id", "start").union(placed.join(picks, ["series_id", "place"]).select("series_id", "start"))


def rolling_cells(series: DataFrame, most: int, seed: int) -> DataFrame:
    """cell, series_id, cutoff of (cell, series_id, n, horizon, windows): at most `most` windows of each cell, by hash.

    A cell one of whose series is long enough for a window before its rolling ones (horizon * (windows + 1) + 4 values)
    gives the rolling cutoffs, one horizon apart at the end, of all its series; any other cell holds out a fifth of its
    series (one at least, never all), each with its latest cutoff. Cutoffs under 4 do not count. The flag of a cell is an
    aggregate, and a cell's windows are ranked where they are before they meet.
    """
    c = F.col
    flags = series.groupBy("cell").agg(F.max(c("n") - c("horizon") * (c("windows") + 1) >= 4).alias("long"), F.count_if(c("n") - c("horizon") >= 4).alias("fit"))
    rows = series.join(flags, "cell")
    lags = F.when(c("long"), F.sequence(c("windows"), F.lit(1), F.lit(-1))).otherwise(F.array(F.lit(1)))
    cuts = rows.select("cell", "series_id", "long", "fit", F.explode(lags).alias("lag"), "n", "horizon").withColumn("cutoff", (c("n") - c("horizon") * c("lag")).cast("long")).where("cutoff >= 4")
    ranked = capped(cuts, ["cell"], most, seed, "cell", "series_id", "cutoff")
    few = F.least(F.greatest(F.lit(1), F.floor(c("fit") / 5)), c("fit") - 1)
    return ranked.where(c("long") | (c("rank") <= few)).select("cell", "series_id", "cutoff")


def family_capped(rows: DataFrame, family: str, most: int, seed: int, *keys: str) -> DataFrame:
    """At most `most` rows of each family, in the order of a hash."""
    return capped(rows, [family], most, seed, *keys).drop("rank")


def in_turn(rows: DataFrame, group: str, each: int, count: int, seed: int, *keys: str) -> DataFrame:
    """The first `count` rows of groups dealt in turn, each giving `each` at most."""
    dealt = interleaved(rows, [group], seed, *keys).where(F.col("depth") <= each)
    return dealt.orderBy("depth", group).limit(count)


def contextual_windows(series: DataFrame, horizons: list[int], seed: int, each: int = 4, least: int = 12) -> DataFrame:
    """series_id, draw, horizon, cutoff, length: up to `each` windows of each (series_id, n), all from hashes of the series and the draw."""
    rows = series.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(each))))
    pick = lambda k, name, m: (number(seed + k, "series_id", "draw") % m).cast("int").alias(name)
    rows = rows.select("series_id", "n", "draw", F.get(F.array(*map(F.lit, horizons)), pick(0, "h", F.lit(len(horizons)))).alias("horizon")).where(f"n - horizon >= {least}")
    rows = rows.withColumn("cutoff", (least + number(seed + 1, "series_id", "draw") % (F.col("n") - F.col("horizon") - least + 1)).cast("long"))
    length = F.least(F.col("cutoff"), F.get(F.array(*map(F.lit, (2, 4, 8, 16))), pick(2, "l", F.lit(4))) * F.col("horizon"))
    return rows.select("series_id", "draw", "horizon", "cutoff", length.cast("long").alias("length"))


def usable(rows: DataFrame, count: int, seed: int, *keys: str) -> DataFrame:
    """The first `count` rows by hash of those that could be converted (no null in `converted`)."""
    return rows.where("converted is not null").orderBy(hash_key(seed, *keys), *keys).limit(count)


def united(parts: list[DataFrame], seed: int, *keys: str) -> DataFrame:
    """All parts in one order by hash, with `position` from 0."""
    from .batches import shuffled

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return shuffled(out.withColumn("__key", F.concat_ws("\u0001", *keys)), seed, "__key").drop("__key")


def half_balanced(rows: DataFrame, group: str, key: str, updates: int, batch: int, seed: int, spark=None) -> DataFrame:
    """update, slot, key: batches of which two quarters are drawn from all rows, and two from groups drawn alike, with replacement.

    Slots draw a place among all rows, or a group and a place in it, by hash, and join the row that has it.
    """
    from .batches import shuffled

    spark = rows.sparkSession
    at = shuffled(rows.select(key, group), seed, key)
    names = rows.groupBy(group).agg(F.count("*").alias("size"))
    names = names.withColumn("group_no", F.row_number().over(W.orderBy(group)) - 1)  # a row for each group
    sizes = names.agg(F.sum("size").alias("n"), F.count("*").alias("groups"))  # one row
    slots = spark.range(updates).withColumnRenamed("id", "update").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(4 * (batch // 4) - 1)))).join(F.broadcast(sizes))
    quarter = F.floor(F.col("slot") / (batch // 4))
    slots = slots.withColumn("even", quarter % 2 == 0)
    draw = lambda k: number(seed + k, "update", "slot")
    even = slots.where("even").withColumn("position", draw(1) % F.col("n")).join(at.select("position", key), "position").select("update", "slot", key)
    inside = at.withColumn("inside", F.row_number().over(W.partitionBy(group).orderBy("position")) - 1)
    some = slots.where("not even").withColumn("group_no", draw(2) % F.col("groups")).join(F.broadcast(names), "group_no").withColumn("inside", draw(3) % F.col("size"))
    return even.union(some.join(inside, [group, "inside"]).select("update", "slot", key))
