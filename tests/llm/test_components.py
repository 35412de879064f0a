import numpy as np

from loomline.llm import components as c


def brute(edges):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_components_with_hubs_and_chains(spark, monkeypatch):
    monkeypatch.setattr(c, "HUB_LEAST", 20)
    g = np.random.default_rng(1)
    edges = [(500, i) for i in range(600, 900)] + [(i, i + 1) for i in range(40)] + [tuple(map(int, g.integers(1000, 1200, 2))) for _ in range(80)] + [(1, 1), (None, 3), (7, None), (40, 899), (40, 899)]
    d = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in c.components(d).collect()} == brute(edges)
    assert c.components(d.limit(0)).count() == 0
