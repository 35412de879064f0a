import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import mixing


def brute(spark, rows, alpha, budget):
    """Copies of each (doc_id, text), row after row: the operator's rule with plain loops over Spark's own hashes."""
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    at = d.select("doc_id", "text", "source", F.xxhash64("doc_id", "text").alias("h"), mixing.tokens(F.col("text")).alias("n")).withColumn("b", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(mixing.BLOCKS)).cast("int"))
    at = [r.asDict() for r in at.collect()]
    total = {}
    for r in at:
        total[r["source"]] = total.get(r["source"], 0) + r["n"]
    w = {s: t**alpha if t else 0.0 for s, t in total.items()}
    z = sum(w.values())
    whole = budget if budget is not None else max(total[s] / w[s] for s in total if w[s]) * z
    copies = {}
    for s, t in total.items():
        mine = [r for r in at if r["source"] == s]
        share = int(np.floor(w[s] / z * whole + 0.5))
        epochs = share // t if t else 1
        left = share - epochs * t
        name = "s" + s if s is not None else "-"
        turns = {x.b: x.t for x in spark.createDataFrame([(name, epochs, b) for b in {r["b"] for r in mine}], "s string, e int, b int").select("b", F.xxhash64("s", "e", "b", F.lit(1)).alias("t")).collect()}
        taken, spent, ended = set(), 0, not t
        for b in sorted(turns, key=lambda b: (turns[b], b)):
            size = sum(r["n"] for r in mine if r["b"] == b)
            if ended:
                break
            if spent + size <= left:
                spent += size
                taken |= {r["h"] for r in mine if r["b"] == b}
                continue
            ended = True
            for h in sorted({r["h"] for r in mine if r["b"] == b}):
                size = sum(r["n"] for r in mine if r["h"] == h)
                if spent + size > left:
                    break
                spent += size
                taken.add(h)
        if not ended:
            taken = set()
        for r in mine:
            copies[r["doc_id"], r["text"]] = epochs + (r["h"] in taken)
    return copies


@pytest.mark.parametrize("repeats,budget", [(1.5, None), (2.0, 5000), (1.0, None)])
def test_mixture_is_brute_force(spark, repeats, budget, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 8)
    g = np.random.default_rng(1)
    rows = [(int(i), "w " * int(g.integers(0, 40)), g.choice(["a", "a", "a", "a", "b", "c"])) for i in range(400)]
    rows += [(500, None, "b"), (501, "", None), (502, "x y", None), (7000, "t " * 9, "a"), (7000, "t " * 9, "a"), (503, "long " * 3000, "c")]
    rows = [(i, t, None if s is None else str(s)) for i, t, s in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = d.groupBy(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")).alias("s")).agg(F.sum(mixing.tokens(F.col("text"))).alias("tokens"))
    alpha = mixing.exponent(sources, None, repeats)
    want = brute(spark, rows, alpha, budget)
    got = {(r.doc_id, r.text): r["count"] for r in mixing.mixture(d, max_repeats=repeats, budget=budget).groupBy("doc_id", "text").count().collect()}
    twice = (7000, "t " * 9)
    want[twice] *= 2
    assert got == {k: v for k, v in want.items() if v}


def test_columns_of_any_name_are_kept(spark):
    names = ["block", "last", "some", "room", "epochs", "s", "h", "row", "tokens", "end_turn", "part", "rest", "fits", "a.b", "__s"]
    rows = [(i, "w " * (i % 5), "xyz"[i % 3], *[f"{n}{i}" for n in names]) for i in range(60)]
    d = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    got = mixing.mixture(d)
    assert got.columns == [*d.columns, "epoch", "turn"]
    assert {tuple(r)[:-2] for r in got.collect()} == set(rows)
    again = mixing.mixture(got)
    assert again.columns == got.columns


def test_entropy_targets(spark):
    src = spark.createDataFrame([("a", 900), ("b", 100), ("c", 0)], "s string, tokens long")
    a = mixing.exponent(src, target_entropy=0.5)
    w = np.array([900.0, 100.0]) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.5) < 1e-3
    assert mixing.exponent(src, target_entropy=2.0) == 0.0 and mixing.exponent(src, target_entropy=0.0) == pytest.approx(1.0, abs=1e-6)


def test_plans_have_no_python(spark):
    d = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    plan = mixing.mixture(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
