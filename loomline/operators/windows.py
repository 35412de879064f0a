"""Windows of series: drawn cutoffs, classes of equal contents, protected and constant histories, balanced and paired draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.series import admissible, filled
from .curate import hash_key

#: History lengths in horizons, and the shortest history.
LENGTHS, LEAST = (2, 4, 8, 16), 4


def picked(key: Column, choices: tuple[int, ...]) -> Column:
    """One of up to 16 choices by the first hexadecimal digit of a hash."""
    digit = F.instr(F.lit("0123456789abcdef"), F.substring(key, 1, 1)) - 1
    return F.element_at(F.array(*map(F.lit, choices)), (digit % len(choices) + 1).cast("int"))


def sampled(arrays: DataFrame, terms: dict[str, int], limit: int, seed: int, most: int = 8192) -> DataFrame:
    """series_id, term, horizon, cutoff, history, future: at most `limit` windows of each row of (series_id, v array).

    Each term has up to ceil(limit / terms) cutoffs: four times as many are drawn from a hash of their number, equal
    ones counted once, and the first by hash are kept whose window is admissible once missing values are filled in the
    history and in the future. The history has one of the different lengths that 2, 4, 8 or 16 horizons make, as far
    as there are values. Series of fewer than 12 values give none.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(h).alias("horizon")) for t, h in terms.items()]))
    n, each = F.size("v"), max(1, -(-limit // len(terms)))
    rows = arrays.where(n >= 12).select("series_id", n.alias("n"), kinds.alias("t")).select("series_id", "n", "t.*")
    first, last = F.greatest(F.lit(LEAST), F.least(4 * F.col("horizon"), F.lit(most))), F.col("n") - F.col("horizon")
    drawn = rows.where(first <= last).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(4 * each - 1))))
    number = F.conv(F.substring(hash_key(seed, "series_id", "term", "draw"), 1, 8), 16, 10).cast("long")
    cuts = drawn.withColumn("cutoff", (first + number % (last - first + 1)).cast("int")).drop("draw").distinct()
    cuts = cuts.withColumn("key", hash_key(seed, "series_id", "term", "cutoff"))
    lengths = F.array_sort(F.array_distinct(F.array(*[F.least(F.col("cutoff"), F.lit(most), F.greatest(F.lit(LEAST), F.lit(k) * F.col("horizon"))) for k in LENGTHS])))
    digit = F.instr(F.lit("0123456789abcdef"), F.substring("key", 1, 1)) - 1
    cut = cuts.withColumn("length", F.element_at(lengths, (digit % F.size(lengths) + 1).cast("int"))).join(arrays, "series_id")
    history = filled(F.slice("v", F.col("cutoff") - F.col("length") + 1, F.col("length")))
    whole = cut.select("series_id", "term", "horizon", "cutoff", "key", history.alias("history"), filled(F.slice("v", F.col("cutoff") + 1, F.col("horizon"))).alias("future"))
    whole = whole.where("history is not null and future is not null").where(admissible(F.col("history"), F.col("future")))
    turn = F.row_number().over(W.partitionBy("series_id", "term").orderBy("key"))
    kept = whole.withColumn("r", turn).where(F.col("r") <= each)
    return kept.withColumn("r", F.row_number().over(W.partitionBy("series_id").orderBy("key"))).where(F.col("r") <= limit).drop("r", "key")


def digest(values: Column) -> Column:
    """Equal for arrays that are equal as 32-bit floats; nulls inside count as a value of their own."""
    return F.sha2(F.concat_ws(",", F.transform(values, lambda x: F.coalesce(x.cast("float").cast("string"), F.lit("-")))), 256)


def content_digest(history: Column, future: Column) -> Column:
    """Equal for windows whose history and future are equal as 32-bit floats."""
    return F.sha2(F.concat_ws("|", digest(history), digest(future)), 256)


def clean(rows: DataFrame, protected: DataFrame, key: str, history: str = "history", future: str = "future") -> DataFrame:
    """rows without those of a protected or a constant history, one of each content: that of the least key.

    Contents are grouped by digest; the least key of each is an aggregate, so a large class is no large group.
    """
    fine = unprotected(rows, history, protected).where(varying(F.col(history)))
    named = fine.withColumn("__c", content_digest(F.col(history), F.col(future)))
    least = named.groupBy("__c").agg(F.min(key).alias("__k"))
    return named.join(least, "__c").where(F.col(key) == F.col("__k")).drop("__c", "__k")


def content_classes(rows: DataFrame, values: str, key: str) -> DataFrame:
    """Adds `first`, the least key of the rows with the same content (pre-aggregated, so a large class is no large group)."""
    named = rows.withColumn("__d", digest(F.col(values)))
    least = named.groupBy("__d").agg(F.min(key).alias("first"))
    return named.join(least, "__d").drop("__d")


def unprotected(rows: DataFrame, values: str, protected: DataFrame) -> DataFrame:
    """Rows whose content is none of the protected ones."""
    known = protected.select(digest(F.col(values)).alias("__d")).distinct()
    return rows.withColumn("__d", digest(F.col(values))).join(known, "__d", "left_anti").drop("__d")


def varying(values: Column) -> Column:
    """False where every value equals the first."""
    return F.exists(values, lambda x: ~x.eqNullSafe(F.get(values, F.lit(0))))


def balanced(rows: DataFrame, outer: str, inner: str, count: int, seed: int, key: str) -> DataFrame:
    """`count` rows, in turn from the outer groups, inside which inner groups are dealt in turn; place from 1.

    No group gives more than `count` rows, so only so many of each are ranked past the first step.
    """
    depth = F.row_number().over(W.partitionBy(outer, inner).orderBy(hash_key(seed, key), key))
    near = rows.withColumn("depth", depth).where(F.col("depth") <= count)
    turn = F.row_number().over(W.partitionBy(outer).orderBy("depth", inner))
    dealt = near.withColumn("turn", turn).where(F.col("turn") <= count).orderBy("turn", outer).limit(count)
    if dealt.count() < count:
        raise ValueError(f"fewer than {count} rows")
    return dealt.withColumn("turn", F.col("turn").cast("long")).drop("depth")


def paired_sample(rows: DataFrame, group: Column, count: int, seed: int) -> DataFrame:
    """All rows of `count` groups that are drawn by hash."""
    named = rows.withColumn("group", group)
    drawn = named.select("group").distinct().orderBy(hash_key(seed, "group"), "group").limit(count)
    return named.join(drawn, "group", "left_semi")


def selection(rows: DataFrame, count: int, seed: int, key: str) -> DataFrame:
    """`count` rows drawn by hash; more than there are is an error."""
    if not 0 <= count <= rows.count():
        raise ValueError("count is out of bounds")
    return rows.orderBy(hash_key(seed, key), key).limit(count)


def edges(rows: DataFrame, part: list[str], order: list[str], label: str) -> DataFrame:
    """Adds `stretch`, numbered from 0: it grows where the label differs from the row before."""
    w = W.partitionBy(*part).orderBy(*order)
    new = F.when(~F.col(label).eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("stretch", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def nearest(rows: DataFrame, group: list[str], gap: Column, order: list[str]) -> DataFrame:
    """The row of least gap in each group, the first of `order` among ties."""
    everything = F.struct(*[c for c in rows.columns if c not in group])
    best = rows.groupBy(*group).agg(F.min_by(everything, F.struct(gap.alias("gap"), *order)).alias("r"))
    return best.select(*group, "r.*")
