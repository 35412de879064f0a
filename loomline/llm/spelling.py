"""Spelling variants: a dictionary of trie-node pairs (prefix node, suffix node) finds words one edit apart exactly."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, mix, shuffle_partitions, table
from .merkle import CRC_TABLE, crc_sql

#: Code points of a word and its occurrences, at least; a form occurs this many times as often; one run in DROP loses a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, DROP = 6, 5, 5, 199
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters of a text that are split at a time, distinct words that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 200_000


def runs(text: str, size: int = PIECE):
    """Lists of the runs of a lower-cased text, in order, from pieces of about `size` characters that end between runs."""
    at = 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text) and _RUN.match(text, end - 1) and (m := _RUN.match(text, end)):
            end = m.end()
        yield _RUN.findall(text, at, end)
        at = end


def occurring(doc_id, text: str | None, least: int = LEAST_LETTERS, drop: int = DROP) -> Counter:
    """How often a text holds each word; where `drop` divides crc32 of `<doc_id>:<run>`, the run loses a letter. A null id is empty."""
    out: Counter = Counter()
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # of bytes: A-Z only
    for found in runs(lowered):
        for word, n in Counter(found).items():
            if len(word) >= least:
                h = zlib.crc32(word.encode(), head)
                if h % drop == 0:
                    k = h % len(word)
                    word = word[:k] + word[k + 1 :]
                    if len(word) < least:
                        continue
                out[word] += n
    return out


def vocabulary(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """(word, n): the distinct words of all texts that occur `count` times at least. Tasks count what they read first."""

    def run(parts):
        held: Counter = Counter()
        told = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for part in parts:
            ids, texts = part.column(0), part.column(1)
            for i in range(len(part)):
                held.update(occurring(ids[i].as_py(), texts[i].as_py(), least, drop))
                if len(held) >= HELD:
                    yield told()
                    held.clear()
        yield told()

    words = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def numbered(words: DataFrame) -> DataFrame:
    """words with `id`, ascending in code-point order."""
    placed = words.repartitionByRange(shuffle_partitions(words.sparkSession), "word").sortWithinPartitions("word")
    return cut(placed.withColumn("id", F.monotonically_increasing_id()))


def trie_nodes(codes: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """For each word the numbers of the nodes of its prefixes, from the empty one (the root, 0) to the whole word.

    A node's number is a sum of one 64-bit number for each letter and place, so tasks number the same trie alike without
    exchange; distinct_nodes() proves for a vocabulary that no two nodes have one number.
    """
    sizes = np.array([len(c) for c in codes])
    first = np.cumsum(sizes) - sizes
    flat = np.concatenate(codes).astype(np.uint64) if len(codes) else np.zeros(0, np.uint64)
    place = (np.arange(len(flat)) - np.repeat(first, sizes)).astype(np.uint64)
    with np.errstate(over="ignore"):
        values = mix((flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + (place + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        return [(sums[a : a + n + 1] - sums[a]).view(np.int64) for a, n in zip(first, sizes, strict=True)]


def _codes(words: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]


def distinct_nodes(words: DataFrame, seed: int, number=trie_nodes) -> bool:
    """Whether every number of a node, in the forward and in the reversed trie, has one parent and letter, and the root's is its alone.

    Then a number leads back to one path only: numbers name nodes exactly.
    """

    def run(parts):
        for part in parts:
            codes = _codes(part.column(0).to_pylist())
            for side, own in enumerate((codes, [c[::-1] for c in codes])):
                nodes = number(own, seed + side)
                rows = {(int(n), int(p), int(c)) for x, word in zip(nodes, own, strict=True) for n, p, c in zip(x[1:], x[:-1], word, strict=True)}
                columns = [*zip(*rows, strict=True)] or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array([side] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["side", "node", "parent", "letter"])

    edges = words.select("word").mapInArrow(run, "side int, node long, parent long, letter long")
    edge = F.struct("parent", "letter")
    return edges.groupBy("side", "node").agg(F.min(edge).alias("a"), F.max(edge).alias("b")).where("a <> b or node = 0").isEmpty()


def pair_dictionary(words: DataFrame, seed: int) -> DataFrame:
    """(p, s, skips, splits) for pairs of a prefix node and a suffix node that join several words.

    A word stands under (prefix before i, suffix after i) as a skip of its letter i, and under (prefix before i, suffix
    from i) as a split. Two skips of one pair differ in one letter; a skip and a split differ in an inserted one, and
    only the first of equal letters in a row counts there (`first`), so that a link is found once. A pair has one split
    at most, and skips at most as many as letters: lists are bounded by the alphabet.
    """

    def run(parts):
        for part in parts:
            texts, ns, ids = part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy()
            codes = _codes(texts)
            forward, back = trie_nodes(codes, seed), [x[::-1] for x in trie_nodes([c[::-1] for c in codes], seed + 1)]
            for a in range(0, len(codes), 256):
                p, s, role = [], [], []
                some = range(a, min(a + 256, len(codes)))
                for k in some:
                    c, f, b = codes[k], forward[k], back[k]
                    new = np.ones(len(c), np.int32)
                    new[1:] += c[1:] != c[:-1]
                    if len(new):
                        new[0] = 2
                    p += [f[:-1], f]
                    s += [b[1:], b]
                    role += [new, np.zeros(len(f), np.int32)]
                times = [2 * len(codes[k]) + 1 for k in some]
                columns = [*map(np.concatenate, (p, s, role)), np.repeat(ns[a : a + 256], times), np.repeat(ids[a : a + 256], times)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["p", "s", "role", "n", "id"])

    # role 0: split, 1: skip, 2: skip of the first of equal letters
    entries = words.select("word", "n", "id").mapInArrow(run, "p long, s long, role int, n long, id long")
    member = F.struct(F.col("n"), (-F.col("id")).alias("neg"), (F.col("role") == 2).alias("first"))
    held = entries.groupBy("p", "s").agg(F.collect_list(F.when(F.col("role") > 0, member)).alias("skips"), F.max(F.when(F.col("role") == 0, F.struct(F.col("n"), (-F.col("id")).alias("neg")))).alias("split"))
    return held.where("size(skips) > 1 or (size(skips) = 1 and split is not null)")


def neighbours(words: DataFrame, seed: int) -> DataFrame:
    """(id, n_near, best): of each word that has near words their number, and (n, minus id) of the most frequent, smallest one."""
    ordered = F.sort_array("skips", asc=False)
    pairs = pair_dictionary(words, seed).select(ordered.alias("skips"), "split")
    plain = lambda m: F.struct(m["n"].alias("n"), m["neg"].alias("neg"))

    def of_skip(m):
        other = F.when(m["neg"] != F.col("skips")[0]["neg"], plain(F.col("skips")[0])).when(F.size("skips") > 1, plain(F.get("skips", F.lit(1))))
        inserted = F.when(m["first"], F.col("split"))
        links = F.size("skips") - 1 + F.when(inserted.isNotNull(), 1).otherwise(0)
        return F.struct((-m["neg"]).alias("id"), links.cast("long").alias("links"), F.greatest(other, inserted).alias("best"))

    firsts = F.filter("skips", lambda m: m["first"])
    of_split = F.struct((-F.col("split.neg")).alias("id"), F.size(firsts).cast("long").alias("links"), plain(F.get(firsts, F.lit(0))).alias("best"))
    told = F.concat(F.transform("skips", of_skip), F.when(F.col("split").isNotNull(), F.array(of_split)).otherwise(F.array().cast("array<struct<id:long,links:long,best:struct<n:long,neg:long>>>")))
    each = pairs.select(F.explode(told).alias("x")).where("x.links > 0")
    return each.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.links").alias("n_near"), F.max("x.best").alias("best"))


def followed(forms: DataFrame) -> DataFrame:
    """(id, root) of (id, form): forms followed to the last by pointer jumping; form null ends.

    Counts grow at least TIMES-fold from a word to its form, so there are no rings, and few turns.
    """
    at = cut(forms.select("id", F.coalesce("form", "id").alias("root"), F.col("form").isNull().alias("done")))
    while not at.where("not done").isEmpty():
        up = at.select(F.col("id").alias("up"), F.col("root").alias("up_root"), F.col("done").alias("up_done"))
        # a word is done when the one that it points to is
        new = cut(at.join(up, at.root == up.up).select("id", F.col("up_root").alias("root"), F.col("up_done").alias("done")))
        discard(at)
        at = new
    return at.select("id", "root")


def variants(docs: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT, times: int = TIMES, drop: int = DROP) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each distinct word of the texts.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its near word of
    largest n (ties: the smallest in code-point order), if that n is `times` the word's n at least; root follows forms to
    the last. Null and empty texts have no words; rows that repeat a doc_id count each; a null doc_id is the empty text
    in the rule that drops letters. Texts and runs may have any length. Other columns are ignored; no words, no rows.
    """
    if times <= 1:
        raise ValueError("with times of 1 or less, forms could form rings")
    words = numbered(cut(vocabulary(docs, least, count, drop)))
    seed = next(s for s in itertools.count(1, 2) if distinct_nodes(words, s))
    near = cut(words.select("id", "n").join(neighbours(words, seed), "id", "left"))
    form = F.when(F.col("best.n") >= times * F.col("n"), -F.col("best.neg"))
    known = near.select("id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best.n")).alias("form_n"))
    roots = followed(known)
    name = lambda key: words.select(F.col("id").alias(f"{key}_id"), F.col("word").alias(f"{key}_word"))
    out = words.join(known, "id").join(roots, "id")
    out = out.join(name("form"), F.col("form") == F.col("form_id"), "left").join(name("root"), F.col("root") == F.col("root_id"))
    return out.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), runs AS (
  SELECT run, c, coalesce(doc_id::VARCHAR, '') || ':' || run AS line FROM (SELECT doc_id, run, count(*) AS c FROM said WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL)
), hashed AS (SELECT run, c, {crc_sql("line")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT c, CASE WHEN h % {DROP} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed
  ) WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}
), skips AS (
  SELECT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), shorter AS (SELECT DISTINCT s.word AS long_word, s.n AS long_n, v.word AS short_word, v.n AS short_n FROM skips s JOIN words v ON v.word = s.a || s.b
), near AS (
  SELECT x.word, x.n, y.word AS other, y.n AS other_n FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT long_word, long_n, short_word, short_n FROM shorter
  UNION SELECT short_word, short_n, long_word, long_n FROM shorter
), best AS (
  SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other END AS form, CASE WHEN b.other_n >= {TIMES} * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word AND b.place = 1
), way AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL
  SELECT y.word, f.word, f.form FROM way y JOIN formed f ON f.word = y.next
)
SELECT f.word, f.form, y.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN way y ON y.word = f.word AND y.next IS NULL
"""
