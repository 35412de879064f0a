"""Document fingerprints from closed syncmers: k-mers whose least inner substring lies at an edge."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, randoms, shuffle_partitions, table

#: Code points of a k-mer and of its inner substrings; a fingerprint keeps the anchors of the lowest SHARE of all hashes,
#: so that its size follows the text's, and ANCHORS at least.
K, S, ANCHORS, SHARE = 12, 4, 64, 1 / 32
_LOW, _ALL = np.uint64(int(SHARE * 2**64)), np.uint64(2**64 - 1)
_PLACE = randoms(21, 64) | np.uint64(1)


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of every closed syncmer of a text, by position; a text under k code points is one anchor, an empty one has none.

    Whether a k-mer is chosen depends on its own code points alone, so equal passages have equal anchors wherever they stand.
    """
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(x) < k:
        whole = mix((mix(x + np.uint64(1)) * _PLACE[: len(x)]).sum(keepdims=True) + np.uint64(len(x))) if len(x) else x
        return whole, np.zeros(len(whole), np.int64)
    c = x * np.uint64(0x9E3779B97F4A7C15)
    n = len(x) - s + 1
    inner = c[:n] * _PLACE[0]
    for j in range(1, s):
        inner += c[j : j + n] * _PLACE[j]
    mix(inner)
    width = k - s + 1
    least, span = inner, 1
    while span < width:
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    first, last = inner[: len(least)], inner[width - 1 :]
    at = np.flatnonzero((first == least) | (last == least))
    parts = [*range(0, k - s + 1, s), k - s]
    h = np.zeros(len(at), np.uint64)
    for j, p in enumerate(dict.fromkeys(parts)):
        h += inner[at + p] * _PLACE[32 + j]
    return mix(h), at


def fingerprint(text: str, most: int = ANCHORS) -> tuple[np.ndarray, np.ndarray]:
    """The anchors of the lowest SHARE of hashes, and of the `most` least ones (of equal ones the first), by hash.

    Both are the same part of any two texts' anchors, so that parts can be compared as the texts would be.
    """
    h, at = anchors(text)
    if len(h) > 4 * most:  # what cannot be among them need not be sorted
        near = max(_LOW, np.uint64(int(_ALL) // len(h) * 3 * most))
        low = h <= near
        if len(np.unique(h[low])) >= most:
            h, at = h[low], at[low]
    h, first = np.unique(h, return_index=True)
    n = max(most, int(np.searchsorted(h, _LOW, side="right")))
    return h[:n], at[first[:n]]


def reach(print_: tuple[np.ndarray, np.ndarray], most: int = ANCHORS) -> np.uint64:
    """The hash up to which a fingerprint holds all its text's anchors."""
    return _ALL if len(print_[0]) < most else max(_LOW, print_[0][-1])


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """hash:position of each anchor, hexadecimal."""
    return " ".join(f"{int(h) >> 24:010x}:{int(p):x}" for h, p in zip(*print_, strict=True))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], most: int = ANCHORS) -> float:
    """Share, among the anchors up to the hash that both prints reach, of those in both at the most common distance or near it.

    Anchors that two texts share by chance stand at scattered distances and count half. Two empty prints are alike.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    upto = min(reach(a, most), reach(b, most))
    (x, p), (y, q) = ((h[h <= upto], at[h <= upto]) for h, at in (a, b))
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    shift = p[i] - q[j]
    value, count = np.unique(shift, return_counts=True)
    near = np.abs(shift - value[count.argmax()]) <= 64
    return float((near.sum() + 0.5 * (~near).sum()) / (len(x) + len(y) - len(i)))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by the first as many code points, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(parts, fields):
    """Pairs (row, next text of the block) of a stream sorted by block, own rows before the guest that follows them."""
    before = None
    for part in parts:
        out = [[] for _ in fields]

        def told(row, following, out=out):
            doc, text, own, _ = row
            other = edited(text, following[1])
            fp, next_ = own, following[2]
            fe = fingerprint(other)
            values = (doc, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), written(fp), written(fe), likeness(fp, fe), likeness(fp, next_))
            for c, v in zip(out, values, strict=True):
                c.append(v)

        for block, guest, doc, text in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            row = (doc, text, fingerprint(text), (block, guest))
            if before is not None and before[3] == (block, 0):
                told(before, row)
            before = row
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, fields.values(), strict=True)], list(fields))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for each row of docs.

    The next document is the one of the next lower doc_id (rows of one doc_id follow each other by the hash of their
    text, null doc_ids come last, after the last comes the first). Documents are dealt to blocks of doc_ids by quantiles
    and sorted there; only the first of each block goes to the block before as well. Null texts are empty, other
    columns are ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = min(8 * shuffle_partitions(spark), 4000)
    marks = rows.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] + [1.0], 100_000)).first()[0]
    top = marks[-1] if marks else None
    bounds = sorted({m for m in marks or [] if m != top}, reverse=True)
    mark = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    block = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(F.size(F.filter(mark, lambda b: b >= F.col("doc_id"))))
    is_top = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
    guest = F.when(is_top, len(bounds)).when(F.array_contains(mark, F.col("doc_id")), block - 1)
    place = F.array(F.struct(block.cast("int").alias("block"), F.lit(0).alias("guest")), F.struct(guest.cast("int").alias("block"), F.lit(1).alias("guest")))
    dealt = rows.select(F.explode(F.filter(place, lambda p: p["block"].isNotNull())).alias("p"), "doc_id", "text").select("p.block", "p.guest", "doc_id", "text")
    dealt = dealt.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block", "guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    fields = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    return dealt.mapInArrow(lambda parts: _rows(parts, fields), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))
