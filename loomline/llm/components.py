"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

#: A node with more than this share of all links is a hub, and one with HUB_LEAST at least; its links are dealt to SALTS tasks.
HUB_SHARE, HUB_LEAST, SALTS = 1e-4, 1000, 64


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links, in either direction and repeated at will, to (node, label): the smallest node reachable.

    Each turn takes the least label of a node's neighbours, then jumps to the label's own label; it ends when nothing
    changed. A label is sent to a node's links by a join on the node; the links of hubs (2 / HUB_SHARE at most, so they
    can be broadcast) are salted there, and their labels copied to each salt. Null ends are ignored; no links give no rows.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = cut(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    most = max(HUB_LEAST, int(HUB_SHARE * both.count()))
    hubs = F.broadcast(cut(both.groupBy(F.col("b").alias("hub")).agg(F.count("*").alias("links")).where(F.col("links") > most).select("hub")))
    salt = F.when(F.col("hub").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(SALTS))).otherwise(0).cast("int")
    links = both.join(hubs, both.b == F.col("hub"), "left").select("a", "b", salt.alias("salt"))
    while True:
        copies = F.explode(F.sequence(F.lit(0), F.when(F.col("hub").isNotNull(), SALTS - 1).otherwise(0)))
        sent = labels.join(hubs, labels.node == F.col("hub"), "left").select("node", "label", copies.alias("salt"))
        near = links.join(sent, (links.b == sent.node) & (links.salt == sent.salt)).groupBy("a").agg(F.min("label").alias("m"))
        lower = cut(labels.join(near, labels.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was")))
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        jumped = cut(lower.join(up, lower.label == up.up).select("node", F.least("label", "up_label").alias("label"), "was"))
        discard(lower)
        discard(labels)
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").isEmpty():
            return labels
