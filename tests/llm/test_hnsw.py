import numpy as np

from loomline.llm import hnsw


def clustered(g, n=3000, d=24):
    """Loose points, pairs just inside and outside the threshold, and a tight group that outgrows a beam."""
    v = g.normal(size=(n, d))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 600, 2):
        side = g.normal(size=d)
        side -= (side @ v[i]) * v[i]
        c = 0.94 + 0.02 * g.random()
        v[i + 1] = c * v[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    v[1000:1400] = v[1000] + 0.04 * g.normal(size=(400, d))
    return v


def brute(v, least=0.95):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (u @ u.T >= least) & ~np.eye(len(v), dtype=bool)
    label = np.arange(len(v))
    while True:
        low = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(v))])
        if (low == label).all():
            return link.sum(axis=1), label
        label = low


def test_walks_find_what_brute_force_finds():
    v = clustered(np.random.default_rng(1))
    count, _ = brute(v)
    s = hnsw.Shard.build(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.95)
    s = hnsw.Shard.load(s.stored(), 0.95)
    q = hnsw.unit(v)
    assert s.audit(q[::9], np.arange(len(v))[::9]) >= hnsw.RECALL and 2 * s.beam < len(v)
    a, _, n = s.links(q, np.arange(len(v)), s.beam)
    got = np.bincount(a, weights=n, minlength=len(v))
    assert (got <= count).all() and (got == count).mean() > 0.995
    probe = s.probes()
    assert np.allclose((probe * s.exact[np.linspace(0, len(v) - 1, hnsw.PROBES).astype(int)]).sum(axis=1), 0.951)


def test_an_audit_widens_a_beam_that_loses_links():
    v = np.random.default_rng(2).normal(size=(2000, 16))
    s = hnsw.Shard.build(np.arange(2000), np.ones(2000, np.int64), v, 0.95)
    s.graph.layers[-1][:, 3:] = -1  # a poor graph
    s.beam = 1
    none = np.full(50, -1)
    poor = s.recall(s.probes(), np.full(len(s.probes()), -1))
    assert poor < hnsw.RECALL
    r = s.audit(hnsw.unit(v[:50]), none)
    assert s.beam > 1 and (r >= hnsw.RECALL or 2 * s.beam >= 2000)


def test_links_over_shards_are_brute_force(spark):
    v = clustered(np.random.default_rng(3), 2000, 16)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    rows += [(5000 + i, rows[7][1]) for i in range(30)] + [(6000, [c * 1e300 for c in rows[9][1]]), (6001, [1.0, 2.0]), (6002, [2.0, 4.0]), (6003, [])]
    count, label = brute(np.concatenate([v, np.repeat(v[7:8], 30, 0), v[9:10]]))
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_bytes=16 * 4 * 500).toPandas().set_index("vec_id")
    ids = np.array([*range(2000), *range(5000, 5030), 6000])
    assert (got.n_links[ids].to_numpy() == count).mean() > 0.999 and (got.component_id[ids].to_numpy() == ids[label]).mean() > 0.999
    assert got.component_id[6002] == 6001 and got.n_links[6001] == 1 and got.n_links[6003] == 0 and len(got) == len(rows)


def test_odd_tables_of_vectors(spark):
    kind = "vec_id long, embedding array<double>, node long, n string, shard string, dims string, label string"
    d = spark.createDataFrame([], kind)
    assert hnsw.near_vectors(d).count() == 0
    one = spark.createDataFrame([(3, [1.0, 0.0], 9, "x", "y", "z", "w"), (3, [1.0, 0.0], 9, "x", "y", "z", "w"), (4, [1.0, 0.01], 9, "x", "y", "z", "w"), (None, [1.0, 0.0], 9, "x", "y", "z", "w"), (5, None, 9, "x", "y", "z", "w")], kind)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in hnsw.near_vectors(one).collect())
    assert got == [(0, 0, 0, True), (3, 1, 3, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


def test_vectors_of_one_id_are_vectors_of_their_own(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (4, [1.0, 0.02]), (1, [0.0, 1.0]), (0, [0.01, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in hnsw.near_vectors(spark.createDataFrame(rows, kind)).collect())
    # vectors of rows 1, 2, 4 and 7 are near each other (the repeated row of 7 counts once), so are those of the other row of 1 and of 0
    assert got == [(0, 1, 0), (1, 1, 0), (1, 3, 1), (1, 3, 1), (4, 3, 1), (7, 3, 1), (7, 3, 1)]


def test_a_vector_of_many_rows_is_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "HUB_LEAST", 3)
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(50, [1.0, 0.01]), (60, [0.0, 1.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(i, 40, 0, i == 0) for i in range(40)] + [(50, 40, 0, False), (60, 0, 60, True)]


def test_a_walk_takes_as_many_queries_at_once_in_a_large_shard(monkeypatch):
    blocks = []
    monkeypatch.setattr(hnsw.Graph, "_walk", lambda self, q, *rest: blocks.append(len(q)) or (np.zeros((len(q), 16), np.int32), np.zeros((len(q), 16), np.float32)))
    for n in (3000, 300_000):
        blocks.clear()
        hnsw.Graph(np.ones((n, 2), np.float32), [], 0).walk(np.ones((600, 2), np.float32), np.zeros(600, int), None, 16)
        assert blocks == [256, 256, 88]


def test_a_walk_with_few_places_takes_no_node_twice(monkeypatch):
    monkeypatch.setattr(hnsw, "VISITED", 1 << 10)
    v = clustered(np.random.default_rng(4))
    s = hnsw.Shard.build(np.arange(len(v)), np.ones(len(v), np.int64), v, 0.95)
    q = hnsw.unit(v)[::10].astype(np.float32)
    ids, sims = s.graph.walk(q, s.graph.entry(q, s.graph.layers[:-1]), s.graph.layers[-1], 32)
    assert all(len(set(i[i >= 0])) == (i >= 0).sum() for i in ids)
    best = np.sort(q @ s.graph.x.T, axis=1)[:, -1]
    assert (np.abs(sims.max(axis=1) - best) < 1e-5).mean() > 0.98


def test_graphs_are_copied_to_tasks_by_cores_not_by_partitions(spark, monkeypatch):
    tasks, cut = [], hnsw.cut
    monkeypatch.setattr(hnsw, "cut", lambda d: (tasks.append(d.rdd.getNumPartitions()) if d.columns == ["node", "n", "other"] else None) or cut(d))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(40)]
        assert hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert tasks == [2 * spark.sparkContext.defaultParallelism]


def test_components_of_32_bits_give_what_doubles_give(spark):
    v = clustered(np.random.default_rng(6), 1500).astype(np.float32)
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    count, label = brute(v.astype(float))
    got = hnsw.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().set_index("vec_id").sort_index()
    assert (got.n_links.to_numpy() == count).mean() > 0.999 and (got.component_id.to_numpy() == label).mean() > 0.999
