"""Merkle manifest of a dataset: per level, lag and lead columns at fixed offsets supply siblings, first children hash parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

#: Children of a node.
FAN = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex sha256 of the values' texts, each `-` if null, else its UTF-8 byte count, `:` and the text."""

    def field(v: Column) -> Column:
        text = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `rank` (from 0, by `order` within `grp`; rows equal in it in any order) and `n` (the group's rows).

    All rows are sorted by ranges of group and order, so that a hot group is dealt to many tasks; a group's part of each
    range is counted, and the counts before it (one for each range at most) are added to the place in the range.
    """
    by = ["grp", *order]
    sorted_ = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    placed = cut(sorted_.withColumn("place", F.monotonically_increasing_id())).withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("held"), F.min("place").alias("least"))
    whole = Window.partitionBy("grp")
    before = F.sum("held").over(whole.orderBy("part")) - F.col("held")
    starts = counts.select("grp", "part", (before - F.col("least")).alias("start"), F.sum("held").over(whole).alias("n"))
    return placed.join(starts, ["grp", "part"]).withColumn("rank", F.col("place") + F.col("start")).drop("part", "place", "start")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes (grp, rank, n, hash, ...) of groups of several, with run, slot, left and right: the run's nodes before and after, joined.

    A node's siblings stand at fixed distances; those that its slot or the run's length put outside the run are masked.
    """
    run = F.floor(F.col("rank") / FAN)
    placed = nodes.where("n > 1").withColumns({"run": run.cast("long"), "slot": F.pmod("rank", F.lit(FAN)).cast("int")}).withColumn("held", F.least(F.lit(FAN), F.col("n") - FAN * F.col("run")))
    w = Window.partitionBy("grp", "run").orderBy("slot")
    before = [F.when(F.col("slot") >= k, F.lag("hash", k).over(w)) for k in range(FAN - 1, 0, -1)]
    after = [F.when(F.col("slot") + k < F.col("held"), F.lead("hash", k).over(w)) for k in range(1, FAN)]
    return placed.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)}).drop("held")


def parents(children: DataFrame) -> DataFrame:
    """(grp, rank, n, hash) of the level above: a run's first child hashes the run."""
    return children.where("slot = 0").select("grp", F.col("run").alias("rank"), F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.concat("hash", "right"), 256).alias("hash"))


def grown(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The top (grp, hash, height) of each group's tree, and the trees' levels from the leaves' parents upwards, with siblings."""
    tops = nodes.where("n = 1").select("grp", "hash", F.lit(0).alias("height"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, children = [], with_siblings(nodes)
    while most > 1:
        most = -(-most // FAN)
        level = cut(parents(children))
        tops = tops.union(level.where("n = 1").select("grp", "hash", F.lit(len(levels) + 1).alias("height")))
        children = with_siblings(level)
        levels.append(children)
    return cut(tops), levels


def descended(tops: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(grp, run, path and what else tops hold) for the parents of leaves; a leaf that is alone in its group has run 0.

    tops: (grp, height, path, ...). A path lists the siblings to the left and to the right from a node's own level up.
    """
    more = [c for c in tops.columns if c not in ("grp", "height", "path")]
    at = lambda height: tops.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("run"), "path", *more)
    known = at(len(levels))
    for height in range(len(levels) - 1, 0, -1):
        own = F.array(F.struct("left", "right")).cast(_PATH)
        lower = levels[height - 1].select("grp", "run", "rank", own.alias("own")).join(known, ["grp", "run"])
        known = cut(lower.select("grp", F.col("rank").alias("run"), F.concat("own", "path").alias("path"), *more).union(at(height)))
    return known.union(at(0)) if levels else known


def upwards(leaves: DataFrame, tops: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """leaves (grp, rank, n, hash, ...) with the path of each and what else tops hold."""
    known = descended(tops, levels)
    columns = leaves.columns
    inner = with_siblings(leaves).join(known, ["grp", "run"])
    inner = inner.withColumn("path", F.concat(F.array(F.struct("left", "right")).cast(_PATH), "path"))
    alone = leaves.where("n = 1").withColumn("run", F.lit(0).cast("long")).join(known, ["grp", "run"])
    more = [c for c in known.columns if c not in ("grp", "run")]
    return inner.select(*columns, *more).union(alone.select(*columns, *more))


def folded(start: Column, path: Column) -> Column:
    """The root that follows from a leaf's hash and its siblings."""
    return F.aggregate(path, start, lambda h, p: F.sha2(F.concat(p["left"], h, p["right"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row for each row of docs.

    Leaves stand by doc_id in their source (a null doc_id first, rows of one doc_id by their leaf); a null source is one
    source of its own and comes first. Rows equal in all five columns are equal leaves. Each value may be null. A row
    whose doc_id is null is not tampered with. An empty table has no rows and no root. Other columns are ignored.

    Texts are read once, for the leaves; from there on rows are narrow. Siblings (up to 15 hashes) are never shuffled
    with the leaves: only the paths of their parents are, a sixteenth of the rows.
    """
    five = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    lowered = F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower())
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    narrow = docs.select(key.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*five).alias("hash"), F.when(hit, leaf_hash(*five[:4], lowered)).alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    leaves = ranked(cut(narrow), "doc_id", "hash", "tie").drop("tie")
    subroots, levels = grown(leaves)
    whole = ranked(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("source"), "hash", "height"), "source")
    root, above = grown(whole)
    up = upwards(whole, root.select("grp", "height", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root")), above)
    tops = up.select(F.col("source").alias("grp"), "height", "path", F.col("hash").alias("subroot"), "root")
    rows = upwards(leaves, tops, levels)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "hash"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


#: The table of the reflected polynomial 0xEDB88320 (one row), and the crc32 of a text beside it, in SQL.
CRC_TABLE = "crc_table AS (SELECT list(list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"


def crc_sql(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), 2 * i::BIGINT + 1, 2))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(v: str) -> str:
    return f"coalesce(strlen({v}::VARCHAR) || ':' || {v}::VARCHAR, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _walk_sql(name: str, start: str, tree: str) -> str:
    """Each leaf's way up: its fold and the siblings met so far."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT w.id, w.k, w.l + 1, w.r // 16, max(w.n + 15) // 16,
         sha256(string_agg(CASE WHEN t.r = w.r THEN w.x ELSE t.h END, '' ORDER BY t.r)),
         max(w.p) || coalesce(string_agg(t.h, '' ORDER BY t.r) FILTER (WHERE t.r <> w.r), '')
  FROM {name} w JOIN {tree} t ON t.l = w.l AND t.k = w.k AND t.r // 16 = w.r // 16 WHERE w.n > 1
  GROUP BY w.id, w.k, w.l, w.r
)"""


def _tree_sql(name: str, start: str) -> str:
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT l + 1, k, r // 16, sha256(string_agg(h, '' ORDER BY r)), max(n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY l, k, r // 16
)"""


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, hashed AS (
  SELECT doc_id, coalesce('s' || source, '') AS k, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS tampered FROM documents, crc_table
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY k) AS n, row_number() OVER () AS id FROM hashed
), {_tree_sql("tree", "SELECT 0 AS l, k, r, leaf AS h, n FROM leaves")}, subroots AS (
  SELECT k AS source, h, row_number() OVER (ORDER BY k) - 1 AS r, count(*) OVER () AS n FROM tree WHERE n = 1
), {_tree_sql("above", "SELECT 0 AS l, '' AS k, r, h, n FROM subroots")},
{_walk_sql("walk", "SELECT id, k, 0 AS l, r, n, coalesce(tampered, leaf) AS x, '' AS p FROM leaves", "tree")},
{_walk_sql("climb", "SELECT w.id, '' AS k, 0 AS l, s.r, s.n, w.x, w.p FROM walk w JOIN subroots s ON s.source = w.k WHERE w.n = 1", "above")}
SELECT d.doc_id, d.leaf, s.h AS subroot, a.h AS root, sha256(c.p) AS proof_sha256, c.x AS folded_root, c.x = a.h AS verified
FROM leaves d JOIN subroots s ON s.source = d.k JOIN climb c ON c.id = d.id AND c.n = 1 JOIN above a ON a.n = 1
"""
