"""Temperature mixing of sources in column expressions: shares, a bisected exponent, block permutations within budgets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, named, table, unused

#: Exponents looked at in one pass, passes, most blocks of a source, most sources that are broadcast.
GRID, PASSES, BLOCKS, MOST_BROADCAST = 16, 6, 1024, 100_000
#: An ending block is cut into 2 ** PART_BITS parts.
PART_BITS = 10


def tokens(text: Column) -> Column:
    """Words of a text, as its tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S++")).cast("long")


def exponent(sources: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] that shares are raised to, from a table of (s, tokens), a row for each source.

    With target_entropy (nats) the largest whose mixture has that entropy at least; else the least at which no source is
    repeated more than max_repeats times when every source is used once at least. Entropy and repetition both fall as
    the exponent grows, so each pass looks at a grid and keeps the bracket: one row of sums goes to the driver.
    """
    low, high = 0.0, 1.0
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))
    used = sources.where("tokens > 0")
    for _ in range(PASSES):
        step = (high - low) / GRID
        grid = [low + i * step for i in range(GRID + 1)]
        sums = []
        for i, a in enumerate(grid):
            w = F.pow(p, F.lit(a))
            sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(w)).alias(f"l{i}"), (F.max(w / p) / F.min(w / p)).alias(f"r{i}")]
        row = used.agg(*sums).first()
        if target_entropy is not None:
            entropy = [math.log(row[f"z{i}"]) - row[f"l{i}"] / row[f"z{i}"] for i in range(GRID + 1)]
            good = [i for i in range(GRID + 1) if entropy[i] >= target_entropy]
            i = max(good, default=0)
            low, high = grid[i], grid[min(i + 1, GRID)]
        else:
            good = [i for i in range(GRID + 1) if row[f"r{i}"] <= (max_repeats or 1.0) + 1e-12]
            i = min(good, default=GRID)
            low, high = grid[max(i - 1, 0)], grid[i]
    return low if target_entropy is not None else high


def weights(sources: DataFrame, alpha: float, budget: int | None = None) -> DataFrame:
    """s, tokens, weight (normalised), budget in tokens and whole epochs of each source.

    Without a budget it is the least that uses every source once at least. Sources without tokens have weight 0 and
    keep their rows once.
    """
    w = sources.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0))
    z, least = w.agg(F.sum("w"), F.max(F.when(F.col("w") > 0, F.col("tokens") / F.col("w")))).first()
    z = z or 1.0
    whole = float(budget) if budget is not None else (least or 0.0) * z
    w = w.withColumn("weight", F.col("w") / F.lit(z)).withColumn("budget", F.round(F.col("weight") * whole).cast("long"))
    return w.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("int")).drop("w")


def mixture(docs: DataFrame, target_entropy: float | None = None, max_repeats: float = 1.5, budget: int | None = None, seed: int = 1) -> DataFrame:
    """The rows of docs as often as the mixture uses them, with `epoch` and `turn` (order within the epoch) as two last columns.

    A source's rows fall into blocks by a hash of the row; an epoch takes whole blocks in the order of a hash of source,
    epoch and block. Whole epochs take every row; the last, partial one takes blocks while the budget lasts, then rows of
    the next block in the order of their hash, never past the budget: parts of that block by ranges of the hash first,
    then the rows of one part. So each row decides for itself from a few values of its source, and no text is shuffled.

    A null source is a source of its own; null and empty texts have no tokens and come once with each epoch of their
    source; equal rows are used equally often, very long texts count by their words like others; an empty table gives
    no rows. Columns of any name are kept as they are; where docs have an epoch or a turn, the new ones are called
    _epoch and _turn (with as many underscores as it takes). An entropy above
    that of even weights cannot be met: weights are then even.
    """
    epoch_, turn_ = unused(docs, "epoch"), unused(docs, "turn")
    at = docs.select(F.struct(*named(docs)).alias("row"), F.xxhash64("doc_id", "text").alias("h"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-")).alias("s"), tokens(F.col("text")).alias("tokens"))
    narrow = cut(at.select("s", "h", "tokens"))
    sources = cut(narrow.groupBy("s").agg(F.sum("tokens").alias("tokens")))
    told = cut(weights(sources, exponent(sources, target_entropy, max_repeats), budget))
    few = told.count() <= MOST_BROADCAST
    small = (lambda d: F.broadcast(d)) if few else (lambda d: d)
    block = F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(BLOCKS)).cast("int")
    turn = lambda epoch: F.xxhash64("s", epoch, "block", F.lit(seed))
    # the partial epoch: the block in which the budget ends (at most BLOCKS rows of a source meet in a window)
    per = narrow.withColumn("block", block).groupBy("s", "block").agg(F.sum("tokens").alias("tokens"))
    per = per.join(small(told.select("s", "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("left"))), "s")
    per = _ending(per.withColumn("turn", turn(F.col("epochs"))), ["turn", "block"], "left")
    ends = cut(per.select("s", "turn", "block", (F.col("left") - F.col("before")).alias("room")))
    # rows of that block: equal ones stand or fall together; first its part, then the row, in which the room ends
    inner = narrow.withColumn("block", block).join(small(ends.select("s", "block", "room")), ["s", "block"])
    inner = cut(inner.groupBy("s", "h").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room")).withColumn("part", F.shiftright("h", 64 - PART_BITS)))
    parts = inner.groupBy("s", "part").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room"))
    parts = _ending(parts, ["part"], "room").select("s", "part", (F.col("room") - F.col("before")).alias("rest"))
    upto = W.partitionBy("s").orderBy("h").rowsBetween(W.unboundedPreceding, 0)
    rows = inner.join(small(parts), ["s", "part"]).withColumn("fits", F.sum("tokens").over(upto) <= F.col("rest"))
    below = F.when(F.col("part") > -(1 << (PART_BITS - 1)), F.shiftleft(F.col("part"), 64 - PART_BITS) - 1)
    last = rows.groupBy("s").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("h"))), F.first(below)).alias("last"))
    limits = cut(told.select("s", "epochs", (F.col("tokens") > 0).alias("some")).join(ends.select("s", F.col("turn").alias("end_turn"), F.col("block").alias("end_block")), "s", "left").join(last, "s", "left"))
    used = at.select("row", "h", "s").join(small(limits), "s").withColumn("block", block)
    mine = F.struct(turn(F.col("epochs")), F.col("block"))
    end = F.struct(F.col("end_turn"), F.col("end_block"))
    partial = F.col("some") & F.col("end_turn").isNotNull() & ((mine < end) | ((F.col("block") == F.col("end_block")) & F.coalesce(F.col("h") <= F.col("last"), F.lit(False))))
    copies = F.col("epochs") + F.when(partial, 1).otherwise(0)
    used = used.where(copies > 0).select("row", "s", "block", F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch"))
    return used.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("epoch").alias(epoch_), turn(F.col("epoch")).alias(turn_))


def _ending(sums: DataFrame, order: list[str], room: str) -> DataFrame:
    """Of each source the first row, in order, at which the running sum of tokens passes the room, with the sum `before` it."""
    upto = W.partitionBy("s").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    found = sums.withColumn("before", F.coalesce(F.sum("tokens").over(upto), F.lit(0))).where(f"before <= {room} and before + tokens > {room}")
    columns = [*order, *[c for c in found.columns if c not in ("s", *order)]]
    return found.groupBy("s").agg(F.min(F.struct(*columns)).alias("e")).select("s", "e.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixture(docs).select("doc_id", "source", tokens(F.col("text")).alias("tokens"), "epoch", "turn")
