"""Packing of token sequences: bounded-space online best fit, and best-fit decreasing with packed id matrices."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .tokens import cuts, encode, slices

#: Places of a sequence, and bins that are open at once: the bound is reached in ordinary streams of documents.
LENGTH, OPEN_BINS = 2048, 64
#: Ids that one task packs (about), and most tasks; ids held at once by best-fit decreasing.
TASK_IDS, MOST_TASKS, HELD_IDS = 32_000_000, 20_000, 4_000_000


class OpenBins:
    """Online best fit with a fixed number of open bins; a bitset has bit f where some open bin has f free places."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.bits, self.open, self.closed = length, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.next = 0

    def _put(self, bin_: int, free: int) -> None:
        if free:
            self.by_free[free].append(bin_)
            self.bits |= 1 << free
            self.open += 1

    def _take(self, free: int) -> int:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset): the open bin with the least sufficient room, else a new one; when all are open the fullest closes first."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most and size < self.length:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            free, bin_ = self.length, self.next
            self.next += 1
        self._put(bin_, free - size)
        return bin_, self.length - free


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids (a null text has the id 0 alone)."""

    def run(parts):
        for part in parts:
            ids, texts = part.column(0), part.column(1)
            pa.default_memory_pool().release_unused()  # what earlier batches and tasks of this worker held
            for i, j in slices(texts):
                flat, offsets = encode(texts.slice(i, j - i), path, added=True)
                flat = flat.astype("<u4", copy=False)
                row, out = [], ([], [], [], [])
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for p, (s, n) in enumerate(cuts(b - a, length)):
                        row.append(i + k)
                        for c, v in zip(out, (p, s, n, zlib.crc32(flat[a + s : a + s + n])), strict=True):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS, path: str | None = None) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenised where they are read; only the narrow pieces are dealt out, to tasks of about TASK_IDS ids
    (more past MOST_TASKS), each of which packs its pieces as they arrive, by doc_id and piece, with its own open bins:
    its memory does not grow with the input. Null texts hold the id 0 alone; null and repeated doc_ids are packed row
    by row; equal rows are alike, so their order does not matter; other columns are ignored; an empty table packs to
    nothing.
    """
    found = cut(pieces(docs, length, path))
    total = found.agg(F.sum("length")).first()[0] or 0
    tasks = int(min(max(1, total // TASK_IDS), MOST_TASKS))
    dealt = found.repartition(tasks).sortWithinPartitions("doc_id", "piece", "ids_crc32").withColumn("task", F.spark_partition_id())

    def run(parts):
        bins = OpenBins(length, open_bins)
        for part in parts:
            sizes = part.column(3).to_pylist()
            got = [bins.place(n) for n in sizes]
            base = (part.column(5)[0].as_py() << 40) if len(sizes) else 0
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


class CapacityTree:
    """Segment tree over free capacities; a leaf counts the bins with so much room. best(size): the least capacity that suffices."""

    def __init__(self, length: int):
        self.width = 1 << length.bit_length()
        self.tree = [0] * (2 * self.width)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, bin_: int) -> None:
        self.bins.setdefault(free, []).append(bin_)
        self._count(free, 1)

    def take(self, free: int) -> int:
        self._count(free, -1)
        return self.bins[free].pop()

    def _count(self, free: int, by: int) -> None:
        at = free + self.width
        while at:
            self.tree[at] += by
            at >>= 1

    def best(self, size: int) -> int | None:
        at = size + self.width
        if self.tree[at]:
            return size
        while at > 1 and (at & 1 or not self.tree[at + 1]):  # climb to the first right sibling that counts any
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.width:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.width


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item positions; items go in by decreasing size (ties by position), each to the fullest bin that has room."""
    tree, bins = CapacityTree(length), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        free = tree.best(sizes[i])
        if free is None:
            bin_, free = len(bins), length
            bins.append([])
        else:
            bin_ = tree.take(free)
        bins[bin_].append(i)
        if free > sizes[i]:
            tree.add(free - sizes[i], bin_)
    return bins


def id_matrices(docs: DataFrame, length: int = LENGTH, path: str | None = None, full: float = 0.98) -> DataFrame:
    """Packed sequences: sequence_id, n_ids, ids (little-endian unsigned 32-bit, padded with 0 to `length`), cu_seqlens,
    positions (little-endian unsigned 16-bit, restarting at each segment, as many as ids), doc_ids, pieces, starts.

    Every task packs what it reads, HELD_IDS ids at a time, by best-fit decreasing; bins under `full` wait, and their
    pieces are packed again with the next ones. Nothing is shuffled. Overlong documents are cut without loss. Null
    texts hold the id 0 alone; null and repeated doc_ids stay as they are; other columns are ignored.
    """
    fields = ["sequence_id", "n_ids", "ids", "cu_seqlens", "positions", "doc_ids", "pieces", "starts"]
    schema = "sequence_id long, n_ids int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, pieces array<int>, starts array<long>"

    def rows(bins, held, first):
        out = [[] for _ in fields]
        for b in bins:
            segments = [held[i] for i in b]
            sizes = [len(s[3]) for s in segments]
            n = sum(sizes)
            ids, positions = np.zeros(length, "<u4"), np.zeros(length, "<u2")
            ids[:n] = np.concatenate([s[3] for s in segments])
            positions[:n] = np.concatenate([np.arange(x) for x in sizes])
            for c, v in zip(out, (first, n, ids.tobytes(), [0, *np.cumsum(sizes).tolist()], positions.tobytes(), [s[0] for s in segments], [s[1] for s in segments], [s[2] for s in segments]), strict=True):
                c.append(v)
            first += 1
        types = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], fields)

    def run(parts):
        held, many, done, base = [], 0, 0, 0
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1)
            base = part.column(2)[0].as_py() << 40 if len(ids) else base
            for i, j in slices(texts):
                flat, offsets = encode(texts.slice(i, j - i), path, added=True)
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    for p, (s, n) in enumerate(cuts(b - a, length)):
                        held.append((ids[i + k], p, s, flat[a + s : a + s + n].copy()))
                        many += n
                if many >= HELD_IDS:
                    bins = best_fit_decreasing([len(h[3]) for h in held], length)
                    close = [b for b in bins if sum(len(held[x][3]) for x in b) >= full * length]
                    if not close:
                        close = bins
                    yield rows(close, held, base + done)
                    done += len(close)
                    gone = {x for b in close for x in b}
                    held = [h for x, h in enumerate(held) if x not in gone]
                    many = sum(len(h[3]) for h in held)
        if held:
            yield rows(best_fit_decreasing([len(h[3]) for h in held], length), held, base + done)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("task")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_matrices(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
