import re

import numpy as np
import pytest

from loomline.llm import secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))


def test_network_finds_planted_secrets_that_the_rules_miss(spark, model):
    g = np.random.default_rng(9)
    sign = lambda n: "".join(g.choice(secrets.SIGNS[:62], n))
    docs = [d.text for d in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 300").orderBy("doc_id").limit(60).collect()]
    forms = ["Authorization: Bearer {}", "use ghp_{} for it", "pwd={}", "see postgres://admin:{}@db.example/x", "key sk_live_{} here", "client signature={}"]
    rows, places = [], {}
    for i, t in enumerate(docs):
        form, v = forms[i % len(forms)], sign(36) + "9a"
        left = t[:200] + " " + form[: form.index("{")]
        rows.append((i, left + v + form[form.index("{") + 2 :] + " " + t[200:]))
        places[i] = (len(left), len(left) + len(v))
    assert not any(s < places[i][1] and places[i][0] < e for i, t in rows for s, _, e in secrets.base_spans(t))
    got = {r.doc_id: r for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    hit = [any(int(a) < places[i][1] and places[i][0] < int(b) for k, a, b in (s.split(":") for s in got[i].spans.split(",") if s) if k == "cnn") for i in places]
    assert np.mean(hit) > 0.95 and sum(r.n_cnn for r in got.values()) >= sum(hit)


def test_recall_constraint_sets_the_threshold(model):
    assert model["recall"] >= secrets.RECALL - 0.01 and model["precision"] > 0.9
    poor = secrets.train([(f"pwd={'a' * 9}{i % 7}", 4, 14, float(i % 2)) for i in range(600)], epochs=1)
    assert poor["threshold"] < 0.5 and poor["recall"] >= secrets.RECALL - 0.02  # labels at random: the recall wins over precision


def test_clean_texts_stay_clean(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = secrets.scanned(docs, model).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    free = [r for r in got if not secrets.base_spans(texts[r.doc_id])]
    assert len(free) > 100 and np.mean([r.n_cnn == 0 for r in free]) > 0.97


def test_every_candidate_is_judged_and_base_spans_too(spark, model):
    text = 'api_key = "abcdef123456" and a-9b7c6d5e4f x pwd: hunter2hunter2 v1.2 at 0123456789abcdef01234567'
    base = secrets.base_spans(text)
    got = secrets.scanned(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), model).orderBy("doc_id").collect()
    judged = {tuple(map(int, s.split(":")[:2])) for s in got[0].scores.split(",")}
    assert {(a, e) for a, _, e in base} <= judged and {text[a:b] for a, b in judged} >= {"a-9b7c6d5e4f", "hunter2hunter2"}
    assert got[1].spans == got[2].spans == got[1].scores == ""


def test_logits_are_the_network_written_out():
    g = np.random.default_rng(2)
    p = {"embed": g.normal(size=(secrets.SYMBOLS, secrets.EMBED)), "conv": g.normal(size=(secrets.REACH * secrets.EMBED, secrets.FILTERS)), "shift": g.normal(size=secrets.FILTERS), "out": g.normal(size=2 * secrets.FILTERS), "bias": g.normal(size=1)}
    x = np.concatenate([secrets.views("some text a1b2c3d4e5 é\n" * 9, 10, 150), secrets.views("", 0, 1)])
    for row, got in zip(x, secrets.logits(p, x), strict=True):
        acts = np.array([[max(0.0, sum(p["embed"][row[t + j], e] * p["conv"][j * secrets.EMBED + e, f] for j in range(secrets.REACH) for e in range(secrets.EMBED)) + p["shift"][f]) for f in range(3)] for t in range(len(row) - secrets.REACH + 1)])
        h = np.maximum(np.stack([sum(p["embed"][row[t + j]] @ p["conv"][j * secrets.EMBED : (j + 1) * secrets.EMBED] for j in range(secrets.REACH)) + p["shift"] for t in range(len(row) - secrets.REACH + 1)]), 0)
        assert np.allclose(h[:, :3], acts) and np.isclose(got, np.concatenate([h.max(0), h.mean(0)]) @ p["out"] + p["bias"][0])


def test_base_spans_are_the_rules_on_long_and_odd_texts():
    rules = [(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6), (r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)]
    g = np.random.default_rng(3)
    bits = ["password", "=", ": ", "'", "AKIA", "ABCDEFGHIJKLMNOPQRST", "deadbeef0123", " ", "é", "token", "api_key", "APIKEY", "x", "\n", "0" * 30, "AKIAAKIA"]
    for _ in range(200):
        t = "".join(g.choice(bits, g.integers(0, 60)))
        want = sorted((m.start(), k, m.end()) for k, (p, n) in enumerate(rules) for m in re.finditer(p, t, re.ASCII) if len(m[1] if k == 0 else m[0]) >= n)
        assert secrets.base_spans(t) == want


def test_forms_that_the_generator_does_not_make(spark, model):
    """Prefixes, alphabets and surroundings of other kinds, short and long."""
    g = np.random.default_rng(19)
    of = lambda alphabet, n: "".join(g.choice(list(alphabet), n))
    hex_, b64, alnum = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijkmnpqrstuvwxyz23456789"
    made = {
        "shpat": [f"store shpat_{of(hex_.lower(), 23)}z now" for _ in range(30)], "hook": [f"see hooks/T{of(alnum.upper(), 9)}/{of(b64[:52], 24)}7 for it" for _ in range(30)],
        "upper hex": [f"digest {of(hex_, 40)} sent" for _ in range(30)], "base64 of 88": [f'"{of(b64, 86)}=="' for _ in range(30)], "very long": [f"blob {of(b64, 400)}9a end" for _ in range(30)],
        "dsn": [f"redis://:{of(alnum, 18)}9@cache.example" for _ in range(30)],
    }
    rows = [(i, t) for i, t in enumerate(x for v in made.values() for x in v)]
    got = {r.doc_id: r for r in secrets.scanned(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    share = {k: np.mean([got[30 * j + i].n_cnn > 0 or got[30 * j + i].n_assign > 0 for i in range(30)]) for j, k in enumerate(made)}
    assert np.mean(list(share.values())) > 0.8, share


def test_chances_are_calibrated_by_bins(model):
    q, y = model["held"]
    assert model["a"] > 0 and abs(q.mean() - y.mean()) < 0.02
    for low, high in ((0, 0.1), (0.1, 0.9), (0.9, 1.01)):
        some = (q >= low) & (q < high)
        assert some.sum() < 20 or abs(q[some].mean() - y[some].mean()) < 0.12


def test_calibration_is_the_curve_of_greatest_likelihood():
    g = np.random.default_rng(4)
    z = g.normal(size=20_000) * 3
    y = (g.random(20_000) < 1 / (1 + np.exp(-(0.6 * z - 1.2)))).astype(float)
    a, c = secrets.calibration(z, y)
    assert abs(a - 0.6) < 0.03 and abs(c + 1.2) < 0.06
    a, c = secrets.calibration(np.array([-2.0, -1.0, 1.0, 2.0]), np.array([0.0, 0.0, 1.0, 1.0]))
    assert np.isfinite(a) and a > 0


def test_what_no_rule_touches_is_not_labelled():
    text = "token=" + "q" * 150 + " then ordinary words and a9b8c7d6e5f4 stays open"
    got = secrets.labelled(text)
    findings = [t[a:b] for t, a, b, y in got if y]
    assert "".join(findings) == "token=" + "q" * 150 and len(findings) == 3
    assert [t[a:b] for t, a, b, y in got if not y] == ["ordinary"]


def test_every_labelled_snippet_of_every_text_trains(spark):
    """No bound on documents or snippets: copies of a text add nothing, each other text adds its own."""
    texts = [f"plain{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}words and password={i:08d}xyz" for i in range(7000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:50], None, ""])], "doc_id long, text string")
    got = secrets.examples(docs).toPandas()
    assert set(got.snippet[got.label == 1]) == {t.split(" and ")[1] for t in texts}
    assert set(got.snippet[got.label == 0]) == {t.split()[0] for t in texts} and (got.label == 0).sum() == 7000
    p = secrets.fit(docs)
    assert len(p["held"][0]) > 14_000 / secrets.KEPT_BACK and p["recall"] >= secrets.RECALL
    again = secrets.fit(docs.repartition(5))
    assert all(np.array_equal(p[k], again[k]) for k in ("embed", "conv", "out", "threshold"))
