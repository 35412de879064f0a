"""Queries of sources, preparation, windows and batch plans (A, B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import DAILY, HOURLY, query, rounded
from ..functions import calendars as cl
from ..operators import batches, curate, windows
from ..sources import catalogue
from ..sources import fixtures as fx

HISTORIES = "h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1)"


def histories(spark, sf):
    """l_orderkey, v: the quantities of each order's lines."""
    lines = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    return lines.withColumn("v", F.transform("v", lambda x: x["l_quantity"]))


@query("a2_modulo_shard", "WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT o_orderkey FROM p WHERE position % 4 = 1")
def a2(spark, sf):
    return curate.positions(fx.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey").where("position % 4 = 1").select("o_orderkey")


@query("a8_value_columns", " UNION ALL ".join(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, '{c}' AS \"column\", {c} AS value FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def a8(spark, sf):
    lines = fx.read(spark, sf, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return catalogue.value_columns(lines, ["l_orderkey", "l_linenumber"], "^l_(?!.*key$)")


@query("a9_edges", "WITH e AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus IS DISTINCT FROM lag(o_orderstatus) OVER w AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, o_orderkey, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS stretch FROM e")
def a9(spark, sf):
    return windows.edges(fx.read(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "stretch")


@query("a11_quotas", "WITH f AS (SELECT count(*) AS families FROM region), n AS (SELECT n_regionkey, count(*) AS names FROM nation GROUP BY 1) SELECT n_regionkey AS family, names, CAST(greatest(256, ceil(1.5 * ceil(2 * 1000.0 / families) / names)) AS BIGINT) AS quota FROM n, f")
def a11(spark, sf):
    return catalogue.quotas(fx.read(spark, sf, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_name").alias("name")), 1000)


@query("a12_families", "SELECT o_orderkey, o_orderpriority AS family FROM orders WHERE o_orderpriority IN (SELECT max(o_orderpriority) FROM orders UNION ALL SELECT min(o_orderpriority) FROM orders)")
def a12(spark, sf):
    orders = fx.read(spark, sf, "orders")
    known = orders.agg(F.explode(F.array(F.max("o_orderpriority"), F.min("o_orderpriority"))).alias("family"))
    items = orders.select("o_orderkey", F.concat_ws("_", "o_orderpriority", "o_orderstatus", "o_orderkey").alias("item_id"))
    return catalogue.in_families(items, known).select("o_orderkey", "family")


@query("a13_cells", "SELECT n_name AS dataset, term FROM nation CROSS JOIN (VALUES ('short'), ('medium'), ('long')) t(term) WHERE term = 'short' OR n_regionkey = 2")
def a13(spark, sf):
    nation = fx.read(spark, sf, "nation")
    return catalogue.cells(nation.select(F.col("n_name").alias("dataset")), nation.where("n_regionkey = 2").select(F.col("n_name").alias("dataset")))


UNITS = ["hour", "day", "week", "month", "quarter", "year"]


@query("b11_calendars", "WITH u AS (SELECT o_orderkey, o_orderdate AS ts, CAST(o_orderkey % 6 AS INT) AS u FROM orders) SELECT o_orderkey, CAST(n AS BIGINT) AS n, strftime(CASE u " + " ".join(f"WHEN {i} THEN date_trunc('{u}', ts) + n * INTERVAL 1 {u}" for i, u in enumerate(UNITS)) + " END, '%Y-%m-%d %H:%M') AS stamp FROM u CROSS JOIN range(-2, 3) t(n)")
def b11(spark, sf):
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = fx.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), unit.alias("unit"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("n"))
    return rows.select("o_orderkey", F.col("n").cast("long").alias("n"), F.date_format(cl.shifted("ts", "unit", "n"), "yyyy-MM-dd HH:mm").alias("stamp"))


ALL = ["second", "minute", "hour", "day", "week", "month", "quarter", "year"]


@query("b11_aligned_calendars", "WITH u AS (SELECT o_orderkey AS k, o_orderdate + to_hours(CAST(o_custkey % 30 AS INT)) AS ts, CAST(o_orderkey % 9 AS INT) AS u, 1 + o_custkey % 3 AS step FROM orders), s AS (SELECT k, n, CASE u "
    + " ".join(f"WHEN {i} THEN date_trunc('{u}', ts) + (n * step) * INTERVAL 1 {u}" for i, u in enumerate(ALL)) + " END AS begun FROM u CROSS JOIN range(5) t(n)), t AS (SELECT k, n, CASE WHEN strftime(begun, '%H:%M:%S') = '00:00:00' THEN strftime(begun, '%Y-%m-%d') ELSE strftime(begun, '%Y-%m-%d %H:%M:%S') END AS text FROM s) "
    "SELECT k AS o_orderkey, string_agg(text, ',' ORDER BY n) FILTER (n < 3) AS past, string_agg(text, ',' ORDER BY n) FILTER (n >= 3) AS future FROM t GROUP BY 1")
def b11_aligned(spark, sf):
    """Three past and two future stamps from each order date on, one to three units apart; every ninth unit is unknown."""
    unit = F.get(F.array(*map(F.lit, ALL)), (F.col("o_orderkey") % 9).cast("int"))
    rows = fx.read(spark, sf, "orders").withColumn("ts", F.expr("o_orderdate + make_dt_interval(0, cast(o_custkey % 30 as int))"))
    past, future = cl.calendar(F.col("ts"), unit, 1 + F.col("o_custkey") % 3, F.lit(3), F.lit(2))
    return rows.select("o_orderkey", F.array_join(past, ",").alias("past"), F.array_join(future, ",").alias("future"))


@query("b15_nearest_hour", "WITH e AS (SELECT event_type, event_id, value, (epoch_us(ts) + 1800000000) // 3600000000 AS hour, epoch_us(ts) AS us FROM events WHERE value BETWEEN -100 AND 140) SELECT event_type, CAST(hour AS BIGINT) AS hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, hour ORDER BY abs(us - hour * 3600000000), event_id) AS r FROM e) x WHERE r = 1")
def b15(spark, sf):
    events = fx.read(spark, sf, "events").where("value between -100 and 140").withColumn("us", cl.micros("ts"))
    events = events.select("event_type", "event_id", "value", F.expr("(us + 1800000000) div 3600000000").alias("hour"), "us")
    return windows.nearest(events, ["event_type", "hour"], F.abs(F.col("us") - F.col("hour") * 3_600_000_000), ["event_id"]).drop("us")


@query("b16_nearest_noon", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 86400000000 AS day, abs(epoch_us(ts) % 86400000000 - 43200000000) AS gap FROM events) SELECT user_id, CAST(day AS BIGINT) AS day, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY gap, event_id) AS r FROM e) x WHERE r = 1")
def b16(spark, sf):
    events = fx.read(spark, sf, "events").withColumn("us", cl.micros("ts")).select("user_id", "event_id", F.expr("us div 86400000000").alias("day"), "us")
    gap = F.abs(F.col("us") % 86_400_000_000 - 43_200_000_000)
    return windows.nearest(events, ["user_id", "day"], gap, ["event_id"]).drop("us")


@query("b17_complete_anchors", f"WITH {HOURLY}, c AS (SELECT series_id, pos, count(*) OVER (PARTITION BY series_id ORDER BY pos RANGE BETWEEN 24 PRECEDING AND 23 FOLLOWING) AS n FROM hourly WHERE value IS NOT NULL) SELECT series_id, pos FROM c WHERE n = 48")
def b17(spark, sf):
    return cl.complete_anchors(fx.hourly(spark, sf).where("value is not null"), 24, 24).select("series_id", "pos")


@query("b19_weekly_hint", f"WITH {DAILY}, c AS (SELECT series_id, pos, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM daily), l AS (SELECT *, lag(v, 7) OVER w AS l7, lag(v, 365) OVER w AS l365 FROM c WINDOW w AS (PARTITION BY series_id ORDER BY pos)), a AS (SELECT series_id, max(n) AS n, greatest(avg(v * v), 1e-8) AS var, avg(v * l7) AS w, avg(v * l365) AS y FROM l GROUP BY 1) SELECT series_id, round(CASE WHEN n >= 15 THEN w / var ELSE -1 END, 6) AS weekly, round(CASE WHEN n >= 366 THEN y / var ELSE 0.5 END, 6) AS annual FROM a")
def b19(spark, sf):
    return rounded(cl.weekly_hint(fx.daily(spark, sf)).select("series_id", "weekly", "annual"))


@query("c2_sampled_windows", f"""WITH {DAILY}, arr AS (SELECT series_id, list(value ORDER BY pos) AS v, count(*) AS n FROM daily GROUP BY 1 HAVING count(*) >= 12),
dr AS (SELECT DISTINCT a.series_id, a.n, t.term, t.h, greatest(4, least(4 * t.h, 8192)) + CAST('0x' || substr(sha256('5' || chr(1) || a.series_id || chr(1) || t.term || chr(1) || u.d), 1, 8) AS BIGINT) % (a.n - t.h - greatest(4, least(4 * t.h, 8192)) + 1) AS cutoff FROM (SELECT series_id, n FROM arr) a CROSS JOIN (VALUES ('short', 30), ('medium', 300), ('long', 450)) t(term, h) CROSS JOIN range(28) u(d) WHERE a.n - t.h >= greatest(4, least(4 * t.h, 8192))),
k AS (SELECT *, sha256('5' || chr(1) || series_id || chr(1) || term || chr(1) || cutoff) AS key FROM dr),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id, term ORDER BY key) AS r FROM k), s AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY key) AS o FROM r WHERE r <= 7),
l AS (SELECT *, list_sort(list_distinct([least(cutoff, 8192, greatest(4, m * h)) FOR m IN [2, 4, 8, 16]])) AS ls FROM s WHERE o <= 20),
w AS (SELECT l.series_id, term, h, cutoff, ls[1 + (instr('0123456789abcdef', substr(key, 1, 1)) - 1) % len(ls)] AS length, arr.v FROM l JOIN arr ON l.series_id = arr.series_id)
SELECT series_id, term, CAST(h AS BIGINT) AS horizon, CAST(cutoff AS BIGINT) AS cutoff, CAST(length AS BIGINT) AS length, round(list_sum(list_slice(v, cutoff - length + 1, cutoff)), 3) AS history_sum, round(list_sum(list_slice(v, cutoff + 1, cutoff + h)), 3) AS future_sum FROM w""")
def c2(spark, sf):
    arrays = fx.daily(spark, sf).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v")).withColumn("v", F.transform("v", lambda x: x["value"]))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 3)
    w = windows.sampled(arrays, {"short": 30, "medium": 300, "long": 450}, 20, 5)
    return w.select("series_id", "term", F.col("horizon").cast("long").alias("horizon"), F.col("cutoff").cast("long").alias("cutoff"), F.size("history").cast("long").alias("length"), total("history").alias("history_sum"), total("future").alias("future_sum"))


@query("c6_content_classes", f"WITH {HISTORIES} SELECT l_orderkey, min(l_orderkey) OVER (PARTITION BY v) AS first FROM h")
def c6(spark, sf):
    return windows.content_classes(histories(spark, sf), "v", "l_orderkey").select("l_orderkey", "first")


@query("c7_c8_clean_histories", f"WITH {HISTORIES} SELECT l_orderkey FROM h WHERE len(list_distinct(v)) > 1 AND v NOT IN (SELECT v FROM h JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')")
def c7(spark, sf):
    h = histories(spark, sf)
    held = h.join(fx.read(spark, sf, "orders").where("o_orderstatus = 'F'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return windows.unprotected(h.where(windows.varying(F.col("v"))), "v", held).select("l_orderkey")


@query("c11_balanced", "WITH d AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('6' || chr(1) || o_orderkey), o_orderkey) AS depth FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY depth, o_orderpriority) AS turn FROM d) SELECT o_orderkey, o_orderstatus, o_orderpriority, turn FROM t ORDER BY turn, o_orderstatus LIMIT 100")
def c11(spark, sf):
    return windows.balanced(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority", 100, 6, "o_orderkey")


PAIR = "concat_ws(',', CAST(v[1] AS INT), CAST(v[2] AS INT))"


@query("c16_paired_sample", f"WITH {HISTORIES}, g AS (SELECT l_orderkey, {PAIR} AS grp FROM h), d AS (SELECT grp FROM (SELECT DISTINCT grp FROM g) x ORDER BY sha256('4' || chr(1) || grp), grp LIMIT 50) SELECT l_orderkey, grp AS \"group\" FROM g WHERE grp IN (SELECT grp FROM d)")
def c16(spark, sf):
    at = lambda i: F.get(F.col("v"), F.lit(i)).cast("int").cast("string")
    return windows.paired_sample(histories(spark, sf), F.concat_ws(",", at(0), at(1)), 50, 4).select("l_orderkey", "group")


@query("c17_selection", "SELECT o_orderkey FROM orders ORDER BY sha256('8' || chr(1) || o_orderkey), o_orderkey LIMIT 500")
def c17(spark, sf):
    return windows.selection(fx.read(spark, sf, "orders").select("o_orderkey"), 500, 8, "o_orderkey")


@query("c23_length_buckets", "WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY sha256('9' || chr(1) || doc_id)) - 1 AS pos FROM documents), b AS (SELECT *, pos // 32 AS bucket, row_number() OVER (PARTITION BY pos // 32 ORDER BY n_chars, pos) - 1 AS inside FROM p), t AS (SELECT bucket, row_number() OVER (ORDER BY sha256('9' || chr(1) || bucket)) - 1 AS turn FROM b GROUP BY bucket HAVING count(*) = 32) SELECT doc_id, CAST((coalesce(turn, (SELECT count(*) FROM p) // 32) * 32 + inside) // 8 AS BIGINT) AS batch FROM b LEFT JOIN t ON b.bucket = t.bucket")
def c23(spark, sf):
    return batches.length_buckets(fx.read(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 8, 4, 9).select("doc_id", "batch")


@query("c25_shortest_first", "WITH d AS (SELECT doc_id, n_chars FROM documents ORDER BY sha256('2' || chr(1) || doc_id), doc_id LIMIT 128) SELECT doc_id, n_chars FROM d ORDER BY n_chars, doc_id LIMIT 20")
def c25(spark, sf):
    return batches.shortest_first(fx.read(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 128, 20, 2)


QUOTA = {"1-URGENT": 334, "2-HIGH": 333, "3-MEDIUM": 333}


@query("c26_quotas", "WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256('1' || chr(1) || o_orderkey), o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderpriority, CAST((r - 1) // 8 AS BIGINT) AS batch FROM r WHERE r <= CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in QUOTA.items()) + " ELSE 0 END")
def c26(spark, sf):
    return batches.quotas(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", QUOTA, 8, 1)


@query("c27_batch_shares", "WITH p AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY sha256('3' || chr(1) || o_orderkey)) - 1) // 8 AS batch FROM orders) SELECT CAST(batch AS BIGINT) AS batch, o_orderpriority, round(count(*) / sum(count(*)) OVER (PARTITION BY batch), 6) AS share FROM p GROUP BY batch, o_orderpriority")
def c27(spark, sf):
    return rounded(batches.shares(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 8, 3))
