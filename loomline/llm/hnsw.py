"""Embedding near-duplicates: a navigable small-world graph for each shard, range search, cosine confirmed in doubles."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, randoms, shuffle_partitions, table
from .components import HUB_LEAST, HUB_SHARE, SALTS, components

#: Bytes of a shard's 32-bit components (its graph and doubles take four times that in a task), vectors at least, shards at least.
SHARD_BYTES, SHARD_LEAST, FEWEST = 1 << 26, 4096, 4
#: Links of a node on the ground layer and above, beam while building, first beam of queries, nodes expanded at once.
GROUND, UPPER, BUILD_BEAM, BEAM, AT_ONCE = 32, 16, 48, 16, 4
#: Recall that audits ask for, and their probes and queries in each task.
RECALL, PROBES = 0.995, 512
#: Vectors added, and queries walked or flooded, together; places of the tables of visited nodes; bytes of a part of a
#: stored graph; products computed in the same memory.
BLOCK, VISITED, PART, PIECE = 256, 1 << 22, 1 << 20, 1024
#: Cosines this near the threshold in 32 bits are computed again in doubles.
DOUBT = np.float32(1e-4)


class Graph:
    """Hierarchical navigable small-world graph over unit vectors, built and walked for a block of vectors at a time."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray], first: int):
        self.x, self.layers, self.first = x, layers, first
        self.rows = np.empty((2, PIECE, x.shape[1]), np.float32)

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1) -> Graph:
        rng = np.random.default_rng(seed)
        top = np.minimum((-np.log(1 - rng.random(len(x))) / np.log(UPPER)).astype(int), 6)
        order = np.argsort(-top, kind="stable")
        g = cls(np.ascontiguousarray(x, np.float32), [], int(order[0]))
        for level in range(top.max(initial=0), -1, -1):
            g._add(order[: int((top >= level).sum())], GROUND if level == 0 else UPPER)
        return g

    def dots(self, q: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Products of rows of q with nodes (those under 0 count as 0), piece by piece in the same memory: fresh arrays cost more than the products."""
        out = np.empty(len(node), np.float32)
        for i in range(0, len(node), PIECE):
            a, b = self.rows[:, : len(node) - i]
            q.take(row[i : i + PIECE], axis=0, out=a, mode="clip")
            self.x.take(node[i : i + PIECE], axis=0, out=b, mode="clip")
            np.einsum("nd,nd->n", a, b, out=out[i : i + PIECE])
        return out

    def _add(self, nodes: np.ndarray, degree: int) -> None:
        # links back fill half as many places more before a node chooses `degree` anew, so that it seldom does
        links = np.full((len(self.x), degree + degree // 2), -1, np.int32)
        done = 0
        while done < len(nodes):
            new = nodes[done : done + min(BLOCK, max(64, done))]
            sims = self.x[new] @ self.x[new].T
            np.fill_diagonal(sims, -2)
            width = min(degree, len(new) - 1)
            near = np.argpartition(-sims, width, axis=1)[:, :width]
            cand, sim = new[near], np.take_along_axis(sims, near, axis=1)
            if done:
                found, s = self.walk(self.x[new], self.entry(self.x[new], self.layers), links, BUILD_BEAM)
                cand, sim = np.concatenate([cand, found], axis=1), np.concatenate([sim, s], axis=1)
            links[new, :degree] = self._spread(cand, sim, degree)
            self._back(links, new, degree)
            done += len(new)
        self.layers.append(self._mended(links, nodes))

    def _mended(self, links: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Choosing links anew can leave a node that no walk reaches: link it from the nearest reached one."""
        while True:
            seen = np.zeros(len(self.x), bool)
            edge = np.array([self.first])
            while len(edge):
                seen[edge] = True
                edge = np.unique(links[edge])
                edge = edge[edge >= 0]
                edge = edge[~seen[edge]]
            lost, good = nodes[~seen[nodes]], nodes[seen[nodes]]
            if not len(lost):
                return links
            lost = lost[:BLOCK]
            near = np.concatenate([good[(self.x[lost[i : i + 32]] @ self.x[good].T).argmax(axis=1)] for i in range(0, len(lost), 32)])
            order = np.argsort(near, kind="stable")
            near, lost = near[order], lost[order]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            column = np.arange(len(near)) - np.repeat(first, np.diff(np.append(first, len(near))))
            more = np.full((len(links), column.max() + 1), -1, np.int32)
            more[near, column] = lost
            links = np.concatenate([links, more], axis=1)

    def _spread(self, cand: np.ndarray, sim: np.ndarray, degree: int) -> np.ndarray:
        """Up to `degree` of each row's candidates: nearest first, passing over those nearer to a chosen one; then the nearest rest."""
        order = np.argsort(-np.where(cand < 0, -9, sim), axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, axis=1), np.take_along_axis(sim, order, axis=1)
        v = self.x[cand]
        between = v @ v.transpose(0, 2, 1)
        n, width = cand.shape
        taken, shut, many = np.zeros((n, width), bool), cand < 0, np.zeros(n, int)
        for j in range(width):
            pick = ~shut[:, j] & (many < degree)
            taken[pick, j] = True
            many += pick
            shut |= pick[:, None] & (between[:, j] > sim)
        rank = np.argsort(np.where(cand < 0, 2, ~taken), axis=1, kind="stable")[:, :degree]
        out = np.take_along_axis(cand, rank, axis=1)
        return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)

    def _back(self, links: np.ndarray, new: np.ndarray, degree: int) -> None:
        """Links back from the neighbours of new nodes, chosen anew where there are too many."""
        to, back = links[new, :degree].ravel(), np.repeat(new, degree)
        to, back = to[to >= 0], back[to >= 0]
        order = np.argsort(to, kind="stable")
        to, back = to[order], back[order]
        uniq, first, many = np.unique(to, return_index=True, return_counts=True)
        free = (links[uniq] < 0).sum(axis=1)
        room = many <= free
        # room left: append
        u, m, f = uniq[room], many[room], first[room]
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        links[np.repeat(u, m), np.repeat(links.shape[1] - free[room], m) + nth] = back[np.repeat(f, m) + nth]
        uniq, first, many = uniq[~room], first[~room], many[~room]
        for i in range(0, len(uniq), BLOCK):
            u, m, f = uniq[i : i + BLOCK], many[i : i + BLOCK], first[i : i + BLOCK]
            extra = np.full((len(u), m.max()), -1, np.int32)
            nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            extra[np.repeat(np.arange(len(u)), m), nth] = back[np.repeat(f, m) + nth]
            cand = np.concatenate([links[u], extra], axis=1)
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            width = cand.shape[1]
            step = max(1, 4_000_000 // width**2)
            for j in range(0, len(u), step):
                some, c = u[j : j + step], cand[j : j + step]
                links[some, degree:] = -1
                links[some, :degree] = self._spread(c, self.dots(self.x, np.repeat(some, width), c.ravel()).reshape(-1, width), degree)

    def entry(self, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
        """Walk down the layers above the one that is searched, to the nearest node that greedy steps reach."""
        at = np.full(len(q), self.first)
        for links in layers:
            best = np.einsum("nd,nd->n", q, self.x[at])
            moving = np.arange(len(q))
            while len(moving):
                near = links[at[moving]]
                s = np.where(near < 0, -2, self.dots(q, np.repeat(moving, near.shape[1]), near.ravel()).reshape(near.shape))
                j = s.argmax(axis=1)
                some = np.arange(len(moving))
                better = s[some, j] > best[moving]
                at[moving[better]], best[moving[better]] = near[some, j][better], s[some, j][better]
                moving = moving[better]
        return at

    def walk(self, q: np.ndarray, entry: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nearest `beam` nodes that expanding the best ones meets; -1 and -3 where there are fewer.

        Queries go in blocks whose tables of visited nodes depend on the beam, not on the shard, so that a walk costs as
        much in a large shard as its steps do.
        """
        places = min(1 << (128 * beam - 1).bit_length(), 1 << (len(self.x) - 1).bit_length(), VISITED // 16)
        step = min(BLOCK, VISITED // places)
        parts = [self._walk(q[i : i + step], entry[i : i + step], links, beam, places) for i in range(0, len(q), step)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _walk(self, q, entry, links, beam, places):
        """A place of a query's table holds the last node that fell on it: a node pushed out is measured again, never taken twice."""
        n, size = len(q), len(self.x)
        seen, every = np.full(n * places, -1, np.int32), np.arange(n)
        ids, sims, todo = np.full((n, beam), -1, np.int32), np.full((n, beam), -3, np.float32), np.zeros((n, beam), bool)
        ids[:, 0], sims[:, 0], todo[:, 0] = entry, np.einsum("nd,nd->n", q, self.x[entry]), True
        seen[every * places + (entry & (places - 1))] = entry
        floor = sims.min(axis=1)
        alive, width = every, min(max(AT_ONCE, beam // 4), beam)
        while True:
            alive = alive[todo[alive].any(axis=1)]
            if not len(alive):
                return ids, sims
            value = np.where(todo[alive], sims[alive], -9)
            pick = np.argpartition(-value, width - 1, axis=1)[:, :width] if width < beam else np.tile(np.arange(beam), (len(alive), 1))
            near = links[ids[alive[:, None], pick]]
            near[np.take_along_axis(value, pick, axis=1) <= -3] = -1
            todo[alive[:, None], pick] = False
            near = near.reshape(len(alive), -1)
            real = near >= 0
            node, row = near[real], np.repeat(alive, real.sum(axis=1))
            place = row * places + (node & (places - 1))
            new = seen[place] != node
            node, row, place = node[new], row[new], place[new]
            seen[place] = node
            s = self.dots(q, row, node)
            # strictly better than the worst of the beam, so that ties end the walk; no node twice
            good = np.flatnonzero(s > floor[row])
            good = good[(ids[row[good]] != node[good][:, None]).all(axis=1)]
            good = good[np.unique(row[good] * size + node[good], return_index=True)[1]]
            if not len(good):
                continue
            node, s = node[good], s[good]
            row, first, many = np.unique(row[good], return_index=True, return_counts=True)
            at, column = np.repeat(np.arange(len(row)), many), np.arange(len(node)) - np.repeat(first, many)
            more, more_s = np.full((len(row), many.max()), -1, np.int32), np.full((len(row), many.max()), -3, np.float32)
            more[at, column], more_s[at, column] = node, s
            all_s = np.concatenate([sims[row], more_s], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            sims[row] = np.take_along_axis(all_s, best, axis=1)
            ids[row] = np.take_along_axis(np.concatenate([ids[row], more], axis=1), best, axis=1)
            todo[row] = np.take_along_axis(np.concatenate([todo[row], more >= 0], axis=1), best, axis=1)
            floor[row] = sims[row].min(axis=1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(float)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Shard:
    """The vectors of a shard, their graph, and the groups that links between graph neighbours make."""

    def __init__(self, ids, weights, vectors, exact, graph: Graph, root, least: float, beam: int = BEAM):
        self.ids, self.weights, self.vectors, self.exact, self.graph, self.root, self.least, self.beam = ids, weights, vectors, exact, graph, root, least, beam

    @classmethod
    def build(cls, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray, least: float) -> Shard:
        exact = unit(vectors)
        out = cls(ids, weights, vectors, exact, Graph.build(exact), np.arange(len(ids)), least)
        links = out.graph.layers[-1]
        for i in range(0, len(ids), 4096):
            a, j = np.nonzero(links[i : i + 4096] >= 0)
            a, b = a + i, links[i : i + 4096][a, j]
            out._join(*(x[out._true(exact[a], b)] for x in (a, b)))
        return out

    def stored(self) -> bytes:
        """The vectors as they came, and of each layer the nodes that have links there."""
        f = io.BytesIO()
        layers = {}
        for i, links in enumerate(self.graph.layers):
            nodes = np.flatnonzero((links >= 0).any(axis=1))
            layers |= {f"nodes{i}": nodes, f"layer{i}": links[nodes]}
        np.savez(f, ids=self.ids, weights=self.weights, vectors=self.vectors, root=self.root, first=self.graph.first, beam=self.beam, **layers)
        return f.getvalue()

    @classmethod
    def load(cls, data: bytes, least: float) -> Shard:
        with np.load(io.BytesIO(data)) as z:
            vectors, layers = z["vectors"], []
            for i in range(sum(k.startswith("layer") for k in z.files)):
                some = z[f"layer{i}"]
                layers.append(np.full((len(vectors), some.shape[1]), -1, np.int32))
                layers[-1][z[f"nodes{i}"]] = some
            exact = unit(vectors)
            return cls(z["ids"], z["weights"], vectors, exact, Graph(exact.astype(np.float32), layers, int(z["first"])), z["root"], least, int(z["beam"]))

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            np.minimum.at(self.root, b, a)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def _true(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.einsum("nd,nd->n", q, self.exact[b]) >= self.least

    def links(self, q: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, group, links): how many vectors (copies counted) of each group are linked to each query, the query itself not counted.

        own: each query's place in this shard, or -1. A walk whose beam holds links only is carried on over all of them.
        """
        size = len(self.ids)
        if 2 * beam >= size:
            out = [(a + i, r, n) for i in range(0, len(q), BLOCK) for a, r, n in [self._flood(q[i : i + BLOCK], own[i : i + BLOCK], np.arange(size), False)]]
            return tuple(np.concatenate(c) for c in zip(*out, strict=True))
        x = q.astype(np.float32)
        start, far = own.copy(), np.flatnonzero(own < 0)
        start[far] = self.graph.entry(x[far], self.graph.layers[:-1])
        ids, s = self.graph.walk(x, start, self.graph.layers[-1], beam)
        low = np.float32(self.least) - DOUBT
        full = s.min(axis=1) >= low
        a, j = np.nonzero((s >= low) & ~full[:, None])
        b = ids[a, j]
        sure = self._true(q[a], b) & (b != own[a])
        out = [self._grouped(a[sure], b[sure])]
        full = np.flatnonzero(full)
        full = full[np.argsort(self.root[ids[full, s[full].argmax(axis=1)]], kind="stable")]  # likes together
        for i in range(0, len(full), BLOCK):
            f = full[i : i + BLOCK]
            c, r, n = self._flood(q[f], own[f], np.unique(ids[f]), True)
            out.append((f[c], r, n))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _grouped(self, a: np.ndarray, b: np.ndarray):
        key, at = np.unique(a * len(self.ids) + self.root[b], return_inverse=True)
        n = np.bincount(at, weights=self.weights[b], minlength=len(key)).astype(np.int64)
        return key // len(self.ids), key % len(self.ids), n

    def _flood(self, q: np.ndarray, own: np.ndarray, nodes: np.ndarray, spread: bool):
        """As links, by products with whole sets of nodes: the given ones and, with `spread`, those that linked ones lead to."""
        x, ground, low = q.astype(np.float32), self.graph.layers[-1], np.float32(self.least)
        seen = np.zeros(len(self.ids), bool)
        seen[nodes] = True
        out = []
        while len(nodes):
            met = []
            for i in range(0, len(nodes), 8192):
                some = nodes[i : i + 8192]
                some = some[np.argsort(self.root[some], kind="stable")]
                s = x @ self.graph.x[some].T
                near = s >= low - DOUBT
                if np.count_nonzero(near) * 16 < near.size:
                    a, j = np.nonzero(near)
                    hot = s[a, j] >= low + DOUBT
                    hot[~hot] = self._true(q[a[~hot]], some[j[~hot]])
                    a, j = a[hot], j[hot]
                    met.append(some[np.unique(j)])
                    a, j = a[some[j] != own[a]], j[some[j] != own[a]]
                    out.append(self._grouped(a, some[j]))
                    continue
                hot = s >= low + DOUBT
                a, j = np.nonzero(near & ~hot)
                hot[a, j] = self._true(q[a], some[j])
                met.append(some[hot.any(axis=0)])
                hot &= some != own[:, None]
                group = self.root[some]
                first = np.flatnonzero(np.diff(group, prepend=-1))
                n = np.add.reduceat(hot * self.weights[some], first, axis=1)
                a, j = np.nonzero(n)
                out.append((a, group[first[j]], n[a, j]))
            if not spread:
                break
            nodes = np.unique(ground[np.concatenate(met)])
            nodes = nodes[nodes >= 0]
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def _counted(self, q: np.ndarray, own: np.ndarray, beam: int) -> np.ndarray:
        got = self.links(q, own, beam)
        return np.bincount(got[0], weights=got[2], minlength=len(q))

    def recall(self, q: np.ndarray, own: np.ndarray, true: np.ndarray | None = None) -> float:
        """Mean share of its true links (by brute force, unless given) that the walk finds of each query that has any."""
        true = self._counted(q, own, len(self.ids)) if true is None else true
        some = true > 0
        return float((self._counted(q[some], own[some], self.beam) / true[some]).mean()) if some.any() else 1.0

    def probes(self) -> np.ndarray:
        """Vectors just inside the threshold from members of the shard: links that an audit must find even where the data have none."""
        at = np.unique(np.linspace(0, len(self.ids) - 1, PROBES).astype(int))
        v = self.exact[at]
        side = (randoms(31, v.size) >> np.uint64(11)).astype(float).reshape(v.shape) / 2**53 - 0.5
        side -= (side * v).sum(axis=1, keepdims=True) * v
        if v.shape[1] == 1:
            return v
        c = min(self.least + 1e-3, 1.0)
        return c * v + np.sqrt(1 - c * c) * unit(side)

    def audit(self, q: np.ndarray, own: np.ndarray, probes: bool = True) -> float:
        """Widen the beam until the audit of these queries, and of the probes, passes; at its widest the search is brute force."""
        p = self.probes() if probes else q[:0]
        asked = [(x, at, self._counted(x, at, len(self.ids))) for x, at in ((p, np.full(len(p), -1)), (q, own)) if len(x)]
        while True:
            r = min((self.recall(*x) for x in asked), default=1.0)
            if r >= RECALL or 2 * self.beam >= len(self.ids):
                return r
            self.beam += max(1, self.beam // 2)


def _vectors(part: pa.RecordBatch, at: int, where: np.ndarray) -> np.ndarray:
    v = part.column(at).filter(pa.array(where))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(where.sum(), -1)


def _built(parts, least: float):
    """The rows of one shard (shard, node, n, embedding) to the parts of its stored graph."""
    shard, ids, weights, vectors = 0, [], [], []
    for part in parts:
        if len(part):
            shard = part.column(0)[0].as_py()
            ids.append(part.column(1).to_numpy())
            weights.append(part.column(2).to_numpy())
            vectors.append(_vectors(part, 3, np.ones(len(part), bool)))
    if ids:
        built = Shard.build(np.concatenate(ids), np.concatenate(weights), np.concatenate(vectors), least)
        built.audit(vectors[0][:0], ids[0][:0])  # the beam that the probes need is stored with the graph
        data = built.stored()
        for i, at in enumerate(range(0, len(data), PART)):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([i], pa.int32()), pa.array([data[at : at + PART]], pa.binary())], ["shard", "part", "data"])


def _searched(parts, least: float, slices: int):
    """The parts of one stored graph (role 0), then queries (role 1): node, n, other of each query and group that it meets."""
    stored, shard = [], None

    def told(node, n, other):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (node, n, other)], ["node", "n", "other"])

    for part in parts:
        asked = part.column(1).to_numpy() == 1
        stored += part.column(5).filter(pa.array(~asked)).to_pylist()
        if not asked.any() or shard is None and not stored:  # a small table can leave a shard empty
            continue
        if shard is None:
            shard = Shard.load(b"".join(stored), least)
            stored.clear()
            if part.column(0)[0].as_py() % slices == 0:
                far = np.flatnonzero(shard.root != np.arange(len(shard.root)))
                yield told(shard.ids[far], np.zeros(len(far), np.int64), shard.ids[shard.root[far]])
            order = np.argsort(shard.ids)
            fresh = True
        ids, q = part.column(2).to_numpy()[asked], unit(_vectors(part, 4, asked))
        near = order[np.minimum(np.searchsorted(shard.ids, ids, sorter=order), len(order) - 1)]
        own = np.where(shard.ids[near] == ids, near, -1)
        if fresh:
            some = np.unique(np.linspace(0, len(ids) - 1, PROBES).astype(int))
            shard.audit(q[some], own[some], probes=False)
            fresh = False
        a, group, n = shard.links(q, own, shard.beam)
        yield told(ids[a], n, shard.ids[group])


VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)"


def near_vectors(rows: DataFrame, least: float = 0.95, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row for each row of (vec_id, embedding).

    Equal vectors make a class, of which one is indexed. Classes are dealt by a hash to shards as large as a task's
    memory allows (FEWEST at least), each shard builds its graph in one task, and the graph is written to the shared
    folder. Then every class is searched in every shard, by slices of the classes: slices and shards go to tasks one to
    one, two for each core, since a task loads a whole graph. So the work is rows times shards, and a walk costs what its
    steps do, whatever the shard's size. n_links counts the other
    vectors linked directly, copies under other vec_ids included. Vectors that are null, empty, zero or have null or non-finite components,
    and rows without vec_id, link with nothing (component_id is then vec_id itself); vectors of different lengths link
    with nothing either. A vec_id that repeats with the same vector counts once; its different vectors are vectors of
    their own, linked only if they are near. Other columns are ignored; an empty table gives no rows.
    """
    spark = rows.sparkSession
    # 32-bit components stay so until a task takes them: half as many bytes to shuffle
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    ok = rows.where(VALID).where("vec_id is not null")
    # a class has a number of its own: one vec_id may have several vectors
    classes = cut(ok.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    size = F.greatest(F.lit(SHARD_LEAST) if shard_bytes == SHARD_BYTES else F.lit(1), F.floor(F.lit(shard_bytes) / (4 * F.col("dims"))))
    lengths = classes.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("many"))
    lengths = lengths.withColumn("shards", F.greatest(F.least(F.lit(FEWEST), "many"), F.ceil(F.col("many") / size)).cast("int"))
    # a row for each length of vectors
    lengths = cut(lengths.withColumn("base", (F.sum("shards").over(W.orderBy("dims")) - F.col("shards")).cast("int")))
    total = lengths.agg(F.sum("shards")).first()[0] or 1
    # two rounds of tasks: each loads a whole graph, so more would only copy and audit it more often
    slices = max(1, min(shuffle_partitions(spark), 2 * spark.sparkContext.defaultParallelism) // total)
    named = classes.join(F.broadcast(lengths), F.size("embedding") == F.col("dims"))
    own = (F.col("base") + F.pmod(F.xxhash64("least", "dims"), F.col("shards"))).cast("int")
    members = named.select(own.alias("shard"), "node", "n", "embedding", "least").repartitionById(total, F.col("shard")).sortWithinPartitions("least", "node").drop("least")
    graphs = cut(members.mapInArrow(lambda parts: _built(parts, least), "shard int, part int, data binary"))
    task = lambda shard, slice_: (shard * slices + slice_).cast("int").alias("task")
    none = lambda kind: F.lit(None).cast(kind)
    slice_ = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    held = graphs.withColumn("slice", slice_).select(task(F.col("shard"), F.col("slice")), F.lit(0).alias("role"), F.col("part").cast("long").alias("node"), none("long").alias("n"), none(kind).alias("embedding"), "data")
    asked = named.withColumn("shard", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("shards") - 1))).select(task(F.col("shard"), F.pmod(F.xxhash64("least", F.lit(1)), F.lit(slices))), F.lit(1).alias("role"), "node", "n", "embedding", none("binary").alias("data"))
    stream = held.union(asked).repartitionById(total * slices, F.col("task")).sortWithinPartitions("role", "node").select("task", "role", "node", "n", "embedding", "data")
    found = cut(stream.mapInArrow(lambda parts: _searched(parts, least, slices), "node long, n long, other long"))
    labels = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    outer = found.groupBy("node").agg(F.sum("n").alias("outer"))
    known = cut(classes.select("node", "least", "n").join(outer, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    lowest = known.groupBy("label").agg(F.min("least").alias("component"))
    by_class = known.join(lowest, "label").select("node", "n", (F.coalesce("outer", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component").join(classes.select("node", "embedding"), "node")
    # the copies of a vector that many rows have are dealt to SALTS tasks; HUB_SHARE of all rows each, so these are few
    most = max(HUB_LEAST, int(HUB_SHARE * ok.count()))
    hubs = F.broadcast(classes.where(F.col("n") > most).select("embedding", F.lit(True).alias("hub")))
    salted = ok.join(hubs, "embedding", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > most, SALTS - 1).otherwise(0)))
    of = salted.join(by_class.withColumn("salt", copies), ["embedding", "salt"]).select("vec_id", "n_links", "component")
    rest = rows.where(f"not ({VALID}) or vec_id is null or ({VALID}) is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = of.union(rest)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
