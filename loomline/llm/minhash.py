"""MinHash near-duplicates: min-max signatures, banding, and exact confirmation on full shingle sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, randoms, shuffle_partitions, table
from .components import components
from .shingles import batches, set_key, shingle_sets

PERMUTATIONS, ROWS = 80, 5
#: Members of a hub that one group verifies; a larger hub is dealt to more groups.
GROUP = 128
#: Turns; the last one searches what is left by its rarest shingles.
TURNS = 3


def min_max_bands(s: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Band hashes of a set. Each permutation x -> a x + b is evaluated once and gives its minimum and its maximum.

    Bands take their rows from the minima or from the maxima, so that no band holds both ends of a permutation.
    """
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(s), 2048):
        h = a[:, None] * s[None, i : i + 2048] + b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    v = np.concatenate([low, high]).reshape(-1, rows)
    c = randoms(7, rows) | np.uint64(1)
    return mix((mix(v) * c).sum(axis=1) + randoms(8, len(v))).view(np.int64)


def sketches(docs: DataFrame, k: int = 4, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, key (names the set; null if empty), bands."""

    def run(parts):
        a, b = randoms(5, permutations) | np.uint64(1), randoms(6, permutations)
        for part in parts:
            pa.default_memory_pool().release_unused()  # what earlier batches and stages of this worker held
            ids, texts = part.column(0), part.column(1).to_pylist()
            n, keys, bands = [], [], []
            for i, j in batches(texts):
                for s in shingle_sets(texts[i:j], k):
                    n.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    bands.append(min_max_bands(s, a, b, rows) if len(s) else np.zeros(0, np.int64))
            sizes = np.cumsum([0] + [len(x) for x in bands]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(sizes), flat)], ["doc_id", "n_shingles", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, key binary, bands array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a hub, b) whose full shingle sets have 100 |A & B| >= percent |A | B|.

    A hub's members are dealt to groups of about GROUP; each group gets the hub's text and streams its members past it.
    """
    groups = F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
    sized = pairs.groupBy("a").agg(F.count("*").alias("n")).select(F.col("a").alias("hub"), groups.alias("groups"))
    members = pairs.join(sized, pairs.a == sized.hub).select("hub", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    hubs = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("hub").alias("node"))
    asked = members.union(hubs).join(texts, "node")
    dealt = asked.repartition(max(shuffle_partitions(pairs.sparkSession), 2), "hub", "salt").sortWithinPartitions("hub", "salt", "role", "node").select("hub", "salt", "role", "node", "text")

    def run(parts):
        at, own = None, []
        for part in parts:
            hub, salt, role, node = (part.column(i).to_pylist() for i in range(4))
            texts_ = part.column(4).to_pylist()
            a_out, b_out = [], []
            for i, j in batches(texts_):
                for q, s in enumerate(shingle_sets(texts_[i:j], k), i):
                    if (hub[q], salt[q]) != at:
                        at, own = (hub[q], salt[q]), []
                    if role[q] == 0:
                        own.append(s)
                    elif any(_alike(s, o, percent) for o in own):
                        a_out.append(hub[q])
                        b_out.append(node[q])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m) or not n:
        return False
    both = n + m - len(np.unique(np.concatenate([x, y])))
    return 100 * both >= percent * (n + m - both)


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept, one row for each row of docs.

    Copies share a class from their set's key on; only one of them goes on. Candidates meet in a band's bucket. Each
    bucket first compares its members with one hub, and links join them into components; buckets that still hold
    several components take other hubs, and after TURNS of these what is left is searched exactly by its rarest
    shingles (prefix_pairs). So no candidate link between components is lost, large groups of likes cost a comparison
    a member, and large groups of half-likes are not compared pair by pair.
    A null, empty or blank text has an empty set and is linked with nothing. A null doc_id has component_id null
    and stays (kept true). Rows that repeat a doc_id are one document. Other columns are ignored.
    """
    known = cut(sketches(docs, k, permutations, rows))
    sets = known.where("n_shingles > 0 and doc_id is not null")
    one = cut(sets.groupBy("key").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("key", F.col("x.doc_id").alias("node"), F.col("x.bands").alias("bands")))
    # a document of several texts has several classes: they are one document
    rows_ = one.select("node", F.posexplode("bands").alias("band", "h")).select("node", F.xxhash64("band", "h").alias("bucket"))
    shared = rows_.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    active = cut(rows_.join(shared.select("bucket", "least"), "bucket").select("bucket", "node", F.col("least").alias("hub")))
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(active.select("node").distinct(), "node", "left_semi"))

    tested = cut(active.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = cut(confirmed(tested, texts, k, percent))
    spread = active.select("bucket", "node")
    for turn in range(1, TURNS + 1):
        labels = components(links)
        spread, rest = _unsettled(spread.select("bucket", "node"), labels)
        if rest.isEmpty():
            break
        if turn == TURNS:
            new = prefix_pairs(texts.join(spread.select("node", "label").distinct(), "node"), k, percent)
        else:
            pick = rest.groupBy("bucket").agg(F.min(F.struct(F.when(F.col("outside"), 0).otherwise(1), F.xxhash64("node", F.lit(turn)), "node", "label")).alias("h"))
            new = rest.join(pick, "bucket").where("label <> h.label").select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
        new = cut(new.join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(new)
        links = links.union(cut(confirmed(new, texts, k, percent)))
    labels = components(links)
    of_key = one.join(labels, "node", "left").select("key", F.coalesce("label", "node").alias("component"))
    out = known.select("doc_id", "n_shingles", "key").join(of_key, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def prefix_pairs(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of different labels among (node, label, text) that can be percent alike, exactly: a superset of those that are.

    With all shingles in one order, rarest first, sets of n shingles that are so alike share one of their first
    n - ceil(percent n / 100) + 1; those that one node alone holds come first and match nothing. Sizes and the
    places of the shared shingle bound what two sets can share, and pairs beyond that bound are not made.
    """

    def run(parts):
        for part in parts:
            nodes, labels, texts_ = (part.column(i).to_pylist() for i in range(3))
            for i, j in batches(texts_):
                sets = shingle_sets(texts_[i:j], k)
                sizes = [len(s) for s in sets]
                of = np.repeat(np.arange(i, j), sizes)
                columns = [np.array(nodes, np.int64)[of], np.array(labels, np.int64)[of], np.repeat(sizes, sizes).astype(np.int64), np.concatenate(sets).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "label", "n", "h"])

    held = cut(texts.select("node", "label", "text").mapInArrow(run, "node long, label long, n long, h long").distinct())
    often = held.groupBy("h").agg(F.count("*").alias("c"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("c > 1")
    common = held.join(often, "h").groupBy("node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h", (F.col("l0") < F.col("l1")).alias("mixed")))).alias("order"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    alone = F.col("n") - F.size("order")
    prefix = common.select("node", "label", "n", alone.alias("alone"), F.posexplode(F.slice("order", F.lit(1), F.greatest(first - alone, F.lit(0)).cast("int"))).alias("i", "s"))
    prefix = cut(prefix.where("s.mixed").select("node", "label", "n", F.col("s.h").alias("h"), (F.col("alone") + F.col("i") + 1).alias("at")))
    need = f"ceil({percent} * (x.n + y.n) / (100.0 + {percent}))"
    alike = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and 1 + least(x.n - x.at, y.n - y.at) >= {need}"
    return prefix.alias("x").join(prefix.alias("y"), F.expr(f"x.h = y.h and x.node < y.node and x.label <> y.label and {alike}")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _unsettled(spread: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Buckets of several components: all their rows with labels, and again with `outside`: not of the bucket's largest one."""
    at = spread.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = at.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("members")).where("labels > 1 and members > 2")
    at = cut(at.join(open_.select("bucket", F.col("top.label").alias("top")), "bucket"))
    return at, at.withColumn("outside", F.col("label") != F.col("top"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
