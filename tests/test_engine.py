import decimal
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomline import catalog
from loomline.functions import frequency, series
from loomline.operators import curate, pooling, scoring

SF = "/root/testdata/sf0.001"


def long(spark, **by):
    rows = [(k, i, v) for k, vs in by.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series_id string, pos long, value double")


def test_repair_holds_ends_and_drops_empty(spark):
    got = series.repair(long(spark, a=[None, 1.0, None, 3.0, float("nan")], b=[None, None], c=[5.0])).orderBy("series_id", "pos").collect()
    assert [(r.series_id, r.value) for r in got] == [("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 3.0), ("c", 5.0)]


def test_finite_runs(spark):
    got = series.finite_runs(long(spark, a=[1.0] * 12 + [None] + [1.0] * 5 + [None] + [2.0] * 13)).collect()
    assert [(r.run, r.start, r.length) for r in got] == [(0, 0, 12), (1, 19, 13)]


def test_constant_series_do_not_divide_by_zero(spark):
    flat = long(spark, a=[2.0] * 10, b=[1.0])
    assert {r.acf1 for r in series.autocorrelation(flat, (1,)).collect()} == {0.0}
    assert {r.slope for r in series.slope(flat).collect()} == {0.0}
    assert {r.score for r in series.outlier(flat).collect()} == {0.0}
    assert {r.scale for r in series.seasonal_scale(flat, 3).collect()} == {None}


def test_dominant_period(spark):
    t = np.arange(96)
    got = series.dominant_period(long(spark, a=(np.sin(2 * np.pi * t / 12) + 0.1 * t).tolist(), b=[1.0] * 3)).orderBy("series_id").collect()
    assert abs(got[0].period - 12) < 1e-9 and got[0].share > 0.9 and got[1].period == 0


def test_frequencies(spark):
    f = spark.createDataFrame([("1h",), ("15min",), ("D",), ("QS",), ("??",)], "freq string")
    got = {r.freq: (r.c, r.g, r.s) for r in f.select("freq", frequency.canonical(F.col("freq")).alias("c"), frequency.regime(F.col("freq")).alias("g"), frequency.seasonality(F.col("freq")).alias("s")).collect()}
    assert got["1h"] == ("H", "hour", 24) and got["15min"] == ("15T", "minute", 96) and got["D"][1] == "day" and got["QS"] == ("QS", None, 4) and got["??"] == (None, None, None)


def test_positions_have_no_gap(spark):
    rows = spark.createDataFrame([(int(i),) for i in np.unique(np.random.default_rng(1).integers(0, 10**9, 500))], "k long")
    got = [r.position for r in curate.positions(rows, "k").orderBy("k").collect()]
    assert got == list(range(len(got)))
    assert curate.positions(rows.limit(0), "k").count() == 0


def test_pool_of_identical_members_is_the_member(spark):
    q = [float(x) for x in range(9)]
    f = spark.createDataFrame([("w", f"m{m}", s, q) for m in range(8) for s in range(3)], "window string, model string, step int, q array<double>")
    w = f.select("window", "model", F.lit(0.125).alias("weight")).distinct()
    for r in pooling.pooled(f, w).collect():
        assert [r[f"q{i}"] for i in range(1, 10)] == q


def test_shifted_members_rank_in_order_and_weights_sum_to_one(spark):
    f = spark.createDataFrame([("w", f"m{m}", s, [float(x + m) for x in range(9)], 4.0, 1.0) for m in range(8) for s in range(4)], "window string, model string, step int, q array<double>, y double, scale double")
    ranks = pooling.crps_ranks(f)
    assert {r.model: r["rank"] for r in ranks.collect()} == {f"m{m}": m for m in range(8)}
    w = pooling.allocations(ranks.select("window", "model", F.log1p("rank").alias("score"))).collect()
    assert abs(sum(r.weight for r in w) - 1) < 1e-9


def test_blend_and_optimum(spark):
    d = spark.createDataFrame([(1, [0.0] * 9, [1.0] * 9), (2, [0.0] * 9, None)], "i int, l array<double>, r array<double>")
    got = {x.i: x.b for x in d.select("i", pooling.blended(F.col("l"), F.col("r"), 0.25).alias("b")).collect()}
    assert got == {1: [0.25] * 9, 2: [0.0] * 9}
    rows = spark.createDataFrame([("w", 0.0, 1.0, 0.4, 1.0)] * 3, "window string, left double, right double, y double, weight double")
    assert abs(pooling.row_optimum(rows).first().optimum - 0.4) < 1e-12


def test_sample_crps_is_its_definition(spark):
    s, y = np.random.default_rng(2).normal(size=25), 0.3
    want = np.abs(s - y).mean() - np.abs(s[:, None] - s[None]).sum() / (2 * 25 * 24)
    got = scoring.sample_crps(spark.createDataFrame([("k", float(v), y) for v in s], "k string, s double, y double"), ["k"]).first().crps
    assert abs(got - want) < 1e-9


def test_admissible(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0]), ([0.0, 0.0], [1.0]), ([1.0], [1e9]), ([], [1.0])], "h array<double>, f array<double>")
    assert [r.a for r in d.select(F.coalesce(series.admissible(F.col("h"), F.col("f")), F.lit(False)).alias("a")).collect()] == [True, False, False, False]


def test_every_query_is_registered_and_entry_has_rows(spark):
    assert set(catalog.SQL) <= set(entry.queries()) and entry.entry(spark).count() > 0


def hashed(df):
    """Rows as sorted tuples of their columns by name; numbers of any width alike, null and NaN alike."""
    def one(v):
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(map(one, v))
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return "-"
        return float(v) if isinstance(v, (int, float, np.number, decimal.Decimal)) and not isinstance(v, (bool, np.bool_)) else str(v)

    order = lambda v: (2, tuple(map(order, v))) if isinstance(v, tuple) else (int(isinstance(v, str)), v)
    return sorted((tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=order) if len(df) else []


def close(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and len(a) == len(b) and all(map(close, a, b))
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 1e-9 * max(1.0, abs(a))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    bad = [(a, b) for a, b in zip(hashed(got), hashed(want), strict=True) if not close(a, b)]
    assert not bad, bad[:3]


def test_hot_paths_have_no_python(spark):
    texts = {"b23_normalised", "d1_numbers", "d2_d14_examples", "d3_d4_messages", "d5_messages", "d6_d7_views", "d12_reports", "d16_d22_converted", "e16_d5_evidence", "e17_d21_channels", "g45_answer_batch"}
    formulas = {"e6_dominant_period", "e14_half_spectrum", "g1_g2_members", "g9_router_features", "g11_expert_features", "g14_g15_g26_routers", "g14_g15_g26_cross_fitted", "g21_g26_pools", "g25_training_table", "g27_masses", "g27_parents", "g28_components"}
    for name in sorted(set(catalog.QUERIES) - texts - formulas):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name
