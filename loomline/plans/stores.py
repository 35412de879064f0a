"""Queries of files, cells, collections and scoring guards (A, C, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import FORECASTS, query, rounded, scaled_forecasts
from ..operators import cells, curate, pooling, scoring
from ..operators import features as ft
from ..operators import members as mb
from ..sources import files
from ..sources import fixtures as fx
from ..sources.stage import folder
from .texts import feature_windows


@query("a1_a2_json_lines", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS written FROM orders")
def a1(spark, sf):
    orders, path = fx.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), folder(spark) + "/orders.jsonl"
    n = files.write_json_lines(orders, path)
    return files.read_any(spark, path, "o_orderkey long, o_totalprice double").withColumn("written", F.lit(n).cast("long"))


@query("a4_block_manifest", "SELECT o_orderpriority AS block, count(*) AS n FROM orders GROUP BY 1")
def a4(spark, sf):
    """Each priority is a block of its own, all written in one pass; the second call reads what the first wrote."""
    orders, root = fx.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("block")), folder(spark)
    for build in (lambda: orders, None):
        out = files.stored_blocks(spark, root, build, "block")
    return files.manifest(out)


@query("a5_read_any", "SELECT n_nationkey, n_name, n.kind FROM nation CROSS JOIN (VALUES ('csv'), ('json'), ('jsonl')) n(kind)")
def a5(spark, sf):
    nation, root = fx.read(spark, sf, "nation").select("n_nationkey", "n_name"), folder(spark)
    nation.write.csv(f"{root}/n.csv", header=True)
    nation.write.json(f"{root}/n.jsonl")
    nation.groupBy().agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(f"{root}/n.json")  # a table of nations
    parts = [files.read_any(spark, f"{root}/n.{k}", "n_nationkey long, n_name string").withColumn("kind", F.lit(k)) for k in ("csv", "json", "jsonl")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a6_positions", "SELECT o_orderkey, CAST(p AS BIGINT) AS row_index FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) x WHERE p % 7 = 3")
def a6(spark, sf):
    orders = fx.read(spark, sf, "orders")
    named = orders.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))
    return files.at_positions(orders, named.where("row_index % 7 = 3")).select("o_orderkey", "row_index")


@query("a7_looked_up", "WITH h AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1) SELECT o_orderkey, CASE WHEN v IS NULL THEN 'no series' WHEN len(v) < o_orderkey % 3 + 2 THEN 'incomplete' END AS problem, CASE WHEN len(v) >= o_orderkey % 3 + 2 THEN v[o_orderkey % 3 + 1] END AS past, CASE WHEN len(v) >= o_orderkey % 3 + 2 THEN v[o_orderkey % 3 + 2] END AS future FROM orders LEFT JOIN h ON o_orderkey = l_orderkey")
def a7(spark, sf):
    lines = fx.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("v"))
    series = lines.select(F.lit("lines").alias("dataset_name"), F.col("l_orderkey").alias("series_idx"), F.transform("v", lambda x: x["l_quantity"]).alias("target"))
    asked = fx.read(spark, sf, "orders").select("o_orderkey", F.lit("lines").alias("dataset_name"), F.col("o_orderkey").alias("series_idx"), (F.col("o_orderkey") % 3).alias("start_idx"))
    out = files.looked_up(asked, series, F.lit(1), F.lit(1))
    return out.select("o_orderkey", "problem", F.get("history", F.lit(0)).alias("past"), F.get("future", F.lit(0)).alias("future"))


@query("a10_bounded_scan", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) x WHERE r <= 20")
def a10(spark, sf):
    return files.bounded_scan(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20)


@query("a14_properties", "SELECT o_orderkey || '/' || o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'even' WHEN o_orderkey % 3 = 0 THEN 'named' ELSE 'Other' END AS domain, CASE WHEN o_orderkey % 2 = 0 THEN 2 WHEN o_orderkey % 3 = 0 THEN 3 ELSE 1 END AS num_variates FROM orders")
def a14(spark, sf):
    k = F.col("o_orderkey")
    orders = fx.read(spark, sf, "orders").select("o_orderkey", F.concat_ws("/", "o_orderkey", "o_orderpriority").alias("name"))
    aliases = orders.where(k % 2 == 0).select(k.cast("string").alias("alias"), F.concat(F.lit("k"), k).alias("property"))
    known = orders.where((k % 2 == 0) | (k % 3 == 0)).select(F.when(k % 2 == 0, F.concat(F.lit("k"), k)).otherwise(k.cast("string")).alias("name"), F.when(k % 2 == 0, "even").otherwise("named").alias("domain"), F.when(k % 2 == 0, 2).otherwise(3).alias("num_variates"))
    return files.properties(orders.select("name"), aliases, known)


@query("a15_a18_boards", f"WITH {FORECASTS} SELECT f.model, f.series_id AS cell, round(avg(abs(f.point - f.y) / nullif(s.scale, 0)), 6) AS mase FROM fc f JOIN scales s ON f.series_id = s.series_id WHERE f.model IN ('last', 'mean') GROUP BY 1, 2")
def a15(spark, sf):
    """A results file in a directory for each of two models, beside reports, read back as one board."""
    scores, root = rounded(scoring.cell_scores(scaled_forecasts(spark, sf), ["series_id", "model"])), folder(spark)
    for m in ("last", "mean"):
        one = scores.where(F.col("model") == m).select(F.col("series_id").alias("cell"), "mase", "crps")
        files.write_report(one.agg(F.avg("mase").alias("mase")), one, f"{root}/reports/{m}")
        files.write_board(one, f"{root}/boards/{m}/{'all_results.csv' if m == 'last' else 'all-results.csv'}")
    return files.boards(spark, f"{root}/boards", "cell string, mase double, crps double").select("model", "cell", "mase")


@query("c9_clean", """WITH l AS (SELECT l_partkey AS k, list(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1 HAVING count(*) >= 4), h AS (SELECT k, v[:len(v) - 2] AS h, v[len(v) - 1:] AS f FROM l),
w AS (SELECT k * 10 + c AS key, CASE WHEN k % 11 = 0 THEN list_transform(h, lambda x: 5.0) ELSE h END AS h, CASE WHEN c = 2 THEN list_reverse(f) ELSE f END AS f, k FROM h CROSS JOIN range(3) t(c)),
g AS (SELECT * FROM w WHERE k % 11 > 0 AND h NOT IN (SELECT h FROM h WHERE k % 7 = 0) AND len(list_distinct(h)) > 1)
SELECT key FROM (SELECT key, row_number() OVER (PARTITION BY h, f ORDER BY key) AS r FROM g) x WHERE r = 1""")
def c9_clean(spark, sf):
    """Three copies of each part's window, the third with another future; every seventh history is protected, every eleventh constant."""
    from ..operators import windows as wn

    lines = fx.read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    v, n = F.transform("s", lambda x: x["l_quantity"]), F.size("s")
    h = lines.where(n >= 4).select("k", F.slice(v, F.lit(1), n - 2).alias("h"), F.slice(v, n - 1, F.lit(2)).alias("f"))
    copies = h.withColumn("c", F.explode(F.array(*map(F.lit, range(3)))))
    rows = copies.select((F.col("k") * 10 + F.col("c")).alias("key"), F.when(F.col("k") % 11 == 0, F.transform("h", lambda _: F.lit(5.0))).otherwise(F.col("h")).alias("history"), F.when(F.col("c") == 2, F.reverse("f")).otherwise(F.col("f")).alias("future"))
    return wn.clean(rows, h.where("k % 7 = 0").select(F.col("h").alias("history")), "key").select("key")


@query("a16_a17_panel", """WITH l AS (SELECT l_partkey AS k, list(l_quantity ORDER BY l_orderkey, l_linenumber, l_quantity) AS v FROM lineitem GROUP BY 1), q AS (SELECT k, v, len(v) AS n, ['day', 'month', 'minute', 'year'][k % 4 + 1] AS unit, ['D', 'M', 'min', 'A'][k % 4 + 1] AS freq FROM l),
h AS (SELECT *, CASE WHEN n >= 4 THEN list_slice(v, greatest(1, n - 19), n) ELSE list_concat([v[1] FOR i IN range(4 - n)], v) END AS hist, greatest(n - 20, 0) AS skip FROM q),
d AS (SELECT *, greatest(len(hist) - 12, 0) AS more, CASE unit WHEN 'day' THEN TIMESTAMP '2024-01-30' + to_days(CAST(skip AS INT)) WHEN 'month' THEN TIMESTAMP '2024-01-01' + to_months(CAST(skip AS INT)) WHEN 'minute' THEN TIMESTAMP '2024-01-30 23:50:00' + to_minutes(CAST(skip AS INT)) ELSE TIMESTAMP '2024-01-01' + to_years(CAST(skip AS INT)) END AS begun FROM h),
g AS (SELECT *, CASE unit WHEN 'day' THEN begun + to_days(CAST(more AS INT)) WHEN 'month' THEN begun + to_months(CAST(more AS INT)) WHEN 'minute' THEN begun + to_minutes(CAST(more AS INT)) ELSE begun + to_years(CAST(more AS INT)) END AS later FROM d)
SELECT k AS "window", 'part' || k % 3 || '/' || CASE unit WHEN 'minute' THEN 'T' ELSE freq END || '/short' AS cell, CASE unit WHEN 'minute' THEN 'T' ELSE freq END AS frequency, len(hist) AS values, list_sum(hist) AS total,
 CASE WHEN strftime(begun, '%H:%M:%S') = '00:00:00' THEN strftime(begun, '%Y-%m-%d') ELSE strftime(begun, '%Y-%m-%d %H:%M:%S') END AS start, CASE WHEN k % 5 > 0 THEN CAST(k % 5 AS DOUBLE) END AS scale,
 CASE WHEN k % 2 = 0 THEN CASE WHEN strftime(later, '%H:%M:%S') = '00:00:00' THEN strftime(later, '%Y-%m-%d') ELSE strftime(later, '%Y-%m-%d %H:%M:%S') END END AS posed, CASE WHEN k % 2 = 0 THEN list_sum(list_slice(hist, len(hist) - least(len(hist), 12) + 1, len(hist))) END AS posed_total FROM g""")
def a16(spark, sf):
    """Both outputs are written and read back: twenty values of the history at most, twelve in a request, for every second part."""
    k = F.col("l_partkey")
    lines = fx.read(spark, sf, "lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_quantity"))).alias("s"))
    of = lambda *names: F.get(F.array(*map(F.lit, names)), (k % 4).cast("int"))
    rows = lines.select(
        k.alias("window"), F.concat(F.lit("part"), k % 3).alias("name"), F.lit("short").alias("term"), of("D", "ME", "min", "YE").alias("freq"), of("day", "month", "minute", "year").alias("unit"),
        of("2024-01-30", "2024-01-31", "2024-01-30 23:50:10", "2024-05-06").alias("start"), F.transform("s", lambda x: x["l_quantity"]).alias("values"), F.array(F.lit(1.0)).alias("target"),
        F.when(k % 2 == 0, "kept").otherwise("other").alias("block"), (k % 5).cast("double").alias("scale"),
    )
    panel, posed = files.write_panel(rows.withColumn("start", F.col("start").cast("timestamp_ntz")), folder(spark), ["kept"], 20, 12)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    asked = posed.select("window", F.col("start").alias("posed"), total("history").alias("posed_total"))
    return panel.select("window", "cell", "frequency", F.size("history").cast("long").alias("values"), total("history").alias("total"), "start", "scale").join(asked, "window", "left")


def priced(spark, sf):
    return fx.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("cell"), F.col("o_custkey").cast("string").alias("series_id")).groupBy("cell", "series_id").agg((F.count("*") * 10).alias("n"))


@query("c3_cell_windows", "WITH s AS (SELECT o_orderpriority AS cell, CAST(o_custkey AS VARCHAR) AS series_id, count(*) * 10 AS n FROM orders GROUP BY 1, 2), m AS (SELECT cell, count(*) FILTER (n >= 9) AS kept FROM s GROUP BY 1), k AS (SELECT cell, least(kept, 40) AS kept, least(4, greatest(1, round_even(0.1 * least(kept, 40), 0))) AS out FROM m) SELECT cell, CAST(out + CASE WHEN kept > out THEN 36 ELSE 0 END AS BIGINT) AS n, CAST(out AS BIGINT) AS held FROM k")
def c3(spark, sf):
    out = cells.cell_windows(priced(spark, sf).withColumn("horizon", F.lit(5)), 40, 3)
    return out.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("held").alias("held"))


@query("c13_family_capped", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('4' || chr(1) || o_orderkey), o_orderkey) AS r FROM orders) x WHERE r <= 30")
def c13(spark, sf):
    return cells.family_capped(fx.read(spark, sf, "orders"), "o_orderstatus", 30, 4, "o_orderkey").select("o_orderkey")


@query("c15_disjoint_starts", """WITH s AS (SELECT o_orderpriority AS series_id, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT series_id, n, i * (n - 10) // 19 AS start FROM s CROSS JOIN range(20) t(i)),
z AS (SELECT * FROM e UNION ALL SELECT series_id, n, n FROM s), r AS (SELECT series_id, n, coalesce(lag(start) OVER w + 10, 0) AS low, start - 10 AS high FROM z WINDOW w AS (PARTITION BY series_id ORDER BY start)),
f AS (SELECT series_id, unnest(range(low, high + 1, 10)) AS start FROM r WHERE high >= low), p AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY start) - 1 AS place, count(*) OVER (PARTITION BY series_id) AS many FROM f)
SELECT series_id, start FROM e UNION ALL SELECT p.series_id, p.start FROM p JOIN (SELECT DISTINCT series_id, i * (many - 1) // 35 AS place FROM p CROSS JOIN range(36) t(i)) k ON k.series_id = p.series_id AND k.place = p.place""")
def c15(spark, sf):
    return cells.disjoint_starts(fx.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series_id")).agg(F.count("*").alias("n")), 10)


@query("c4_rolling_cells", """WITH s AS (SELECT o_orderstatus AS cell, CAST(o_custkey AS VARCHAR) AS series_id, CASE WHEN o_orderstatus = 'P' THEN 7 + count(*) ELSE 10 * count(*) END AS n FROM orders GROUP BY 1, o_custkey),
c AS (SELECT cell, max(n) >= 16 AS long, count(*) FILTER (n >= 7) AS fit FROM s GROUP BY 1), w AS (SELECT s.cell, s.series_id, s.n - 3 * lag AS cutoff, c.long, c.fit FROM s JOIN c ON c.cell = s.cell CROSS JOIN range(1, 4) l(lag) WHERE s.n - 3 * lag >= 4 AND (c.long OR lag = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('9' || chr(1) || cell || chr(1) || series_id || chr(1) || cutoff), cell, series_id, cutoff) AS r FROM w)
SELECT cell, series_id, cutoff FROM r WHERE r <= 900 AND (long OR r <= least(greatest(1, fit // 5), fit - 1))""")
def c4(spark, sf):
    """Pending orders make a cell of short series, which holds out whole series; the others give rolling windows, 900 a cell."""
    series = fx.read(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("cell"), F.col("o_custkey").cast("string").alias("series_id")).agg(F.count("*").alias("k"))
    n = F.when(F.col("cell") == "P", 7 + F.col("k")).otherwise(10 * F.col("k"))
    return cells.rolling_cells(series.select("cell", "series_id", n.alias("n"), F.lit(3).alias("horizon"), F.lit(3).alias("windows")), 900, 9)


@query("c18_in_turn", "WITH d AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('5' || chr(1) || o_orderkey), o_orderkey) AS depth FROM orders) SELECT o_orderkey, depth FROM d WHERE depth <= 12 ORDER BY depth, o_orderstatus LIMIT 30")
def c18(spark, sf):
    return cells.in_turn(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 12, 30, 5, "o_orderkey").select("o_orderkey", "depth")


NUM = "CAST('0x' || substr(sha256('{}' || chr(1) || series_id || chr(1) || draw), 1, 8) AS BIGINT)"


@query("c19_contextual", f"WITH s AS (SELECT o_custkey AS series_id, count(*) * 4 AS n, d.draw FROM orders CROSS JOIN range(1, 5) d(draw) GROUP BY 1, 3), h AS (SELECT *, ([2, 5, 9])[{NUM.format(2)} % 3 + 1] AS horizon FROM s), c AS (SELECT *, 12 + {NUM.format(3)} % (n - horizon - 11) AS cutoff FROM h WHERE n - horizon >= 12) SELECT series_id, draw, CAST(horizon AS BIGINT) AS horizon, CAST(cutoff AS BIGINT) AS cutoff, CAST(least(cutoff, ([2, 4, 8, 16])[{NUM.format(4)} % 4 + 1] * horizon) AS BIGINT) AS length FROM c")
def c19(spark, sf):
    series = fx.read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("series_id")).agg((F.count("*") * 4).alias("n"))
    return cells.contextual_windows(series, [2, 5, 9], 2).withColumns({c: F.col(c).cast("long") for c in ("draw", "horizon")})


@query("c20_c21_usable", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY sha256('6' || chr(1) || o_orderkey), o_orderkey LIMIT 100")
def c20(spark, sf):
    rows = fx.read(spark, sf, "orders").withColumn("converted", F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")))
    return cells.usable(rows, 100, 6, "o_orderkey").select("o_orderkey")


@query("c22_united", "WITH u AS (SELECT o_orderstatus AS part, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus = 'O') SELECT part, o_orderkey, row_number() OVER (ORDER BY sha256('7' || chr(1) || part || chr(1) || o_orderkey)) - 1 AS position FROM u")
def c22(spark, sf):
    parts = [fx.read(spark, sf, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_orderstatus").alias("part"), "o_orderkey") for s in "FO"]
    return cells.united(parts, 7, "part", "o_orderkey")


@query("c24_half_balanced", "SELECT CAST(u AS BIGINT) AS \"update\", CAST(32 AS BIGINT) AS slots FROM range(20) t(u)")
def c24(spark, sf):
    plan = cells.half_balanced(fx.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20, 32, 1)
    return plan.groupBy("update").agg(F.count("*").alias("slots"))


@query("g7_candidates", f"WITH {FORECASTS} SELECT win AS \"window\", step, model, round(q, 8) AS q1 FROM (SELECT win, step, CASE WHEN model = 'trend' THEN 'extra' ELSE model END AS model, min(q) AS q FROM atoms WHERE model IN ('last', 'trend') GROUP BY 1, 2, 3) x")
def g7(spark, sf):
    f = fx.baseline_forecasts(fx.repaired(spark, sf)).select("window", "step", "model", F.reverse("q").alias("q"))
    out = mb.candidates(f.where("model = 'last'"), f.where("model = 'trend'").withColumn("model", F.lit("extra")))
    return rounded(out.select("window", "step", "model", F.col("q")[0].alias("q1")), 8)


@query("g11_expert_features", f"WITH {FORECASTS} SELECT DISTINCT win AS \"window\", CAST(m.i AS BIGINT) AS model_index, CAST(19 + 22 + 3 * 110 + 110 + 6 * 22 + 22 + 22 + 110 + 5 + 95 + 110 AS BIGINT) AS width, CAST(m.i AS BIGINT) AS identity FROM fc CROSS JOIN range(5) m(i)")
def g11(spark, sf):
    f = ft.expert_features(ft.router_features(*feature_windows(spark, sf)), 5)
    me = F.slice("features", 19 + 22 + 4 * 110 + 6 * 22 + 22 + 22 + 110 + 1, 5)
    return f.select("window", F.col("model_index").cast("long").alias("model_index"), F.size("features").cast("long").alias("width"), (F.array_position(me, 1.0) - 1).cast("long").alias("identity"))


@query("g14_g15_g26_routers")
def g14(spark, sf):
    """Weights of each forecaster by routers that did not see its fold (two folds by the window)."""
    rows, f = feature_windows(spark, sf)
    scaled = scaled_forecasts(spark, sf)
    ranks = pooling.crps_ranks(scaled).withColumn("model_index", F.array_position(F.array(*map(F.lit, sorted(fx.MODELS))), F.col("model")) - 1)
    table = ft.expert_features(ft.router_features(rows, f), 5).join(ranks.select("window", "model_index", "model", F.log1p("rank").alias("label")), ["window", "model_index"])
    table = table.withColumn("fold", curate.fold(F.col("window"), 2))
    scores = ft.cross_fitted(table.select("window", "model", "fold", "features", "label"), "features", "label", [0, 1], trees=3, depth=3)
    return rounded(pooling.allocations(scores.select("window", "model", "score")))


@query("h1_shard_problems", "SELECT o_orderkey AS \"window\", CASE o_orderkey % 7 WHEN 0 THEN 'in several shards' WHEN 1 THEN 'wrong length' WHEN 2 THEN 'wrong width' WHEN 3 THEN 'not finite' WHEN 4 THEN 'missing' WHEN 5 THEN 'outside' END AS problem FROM orders WHERE o_orderkey % 7 < 6 UNION ALL SELECT o_orderkey, 'repeated steps' FROM orders WHERE o_orderkey % 7 = 0")
def h1(spark, sf):
    k = F.col("o_orderkey")
    orders = fx.read(spark, sf, "orders").select("o_orderkey")
    known = orders.where(k % 7 != 5).select(k.alias("window"), F.lit(2).alias("horizon"))
    steps = F.when(k % 7 == 1, F.array(F.lit(1))).when(k % 7 == 0, F.array(F.lit(1), F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(2)))
    value = F.when(k % 7 == 3, float("nan")).otherwise(1.0)
    q = F.when(k % 7 == 2, F.array_repeat(value, 8)).otherwise(F.array_repeat(value, 9))
    rows = orders.where(k % 7 != 4).select(k.alias("window"), F.posexplode(steps).alias("at", "step"), q.alias("q"))
    return scoring.shard_problems(rows.select(F.when(F.col("at") == 2, 1).otherwise(0).alias("shard"), "window", "step", "q"), known)


@query("h5_metric_problems", "SELECT o_orderkey AS cell, CASE WHEN o_orderkey % 3 = 0 THEN 'no mase' ELSE 'no crps' END AS problem FROM orders WHERE o_orderkey % 3 < 2")
def h5(spark, sf):
    k = F.col("o_orderkey")
    cells_ = fx.read(spark, sf, "orders").select(k.alias("cell"))
    scores = fx.read(spark, sf, "orders").where(k % 6 != 0).select(k.alias("cell"), F.when(k % 3 == 0, float("nan")).otherwise(1.0).alias("mase"), F.when(k % 3 == 1, None).otherwise(1.0).alias("crps"))
    return scoring.metric_problems(scores, cells_)


@query("h11_accuracy", "SELECT count(*) AS n, count(*) FILTER (role = 'user') AS correct, round(count(*) FILTER (role = 'user') / count(*), 6) AS accuracy FROM conversations")
def h11(spark, sf):
    rows = fx.read(spark, sf, "conversations").select(F.concat(F.lit("I say b) "), F.upper("role")).alias("response"), F.array(F.lit("Assistant"), F.lit("User")).alias("options"), F.lit("User").alias("answer"))
    return rounded(scoring.accuracy(rows))

