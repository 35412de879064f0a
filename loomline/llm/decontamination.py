"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items; texts are scanned once."""

from __future__ import annotations

import functools
import itertools
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Words of a window.
WINDOW = 10
#: Bytes of windows and item ids that one automaton holds (some 0.6 MB of memory for each 0.1 MB); more windows are dealt to several.
AUTOMATON_BYTES = 16 << 20
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of a lower-cased text in UTF-8: digits, letters and all that is not ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS = "array<struct<first:long,last:long,start:long,end:long>>"
_SCHEMA = f"doc_id long, text string, n_words long, hits {_HITS}, items array<string>"


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(words, items): each distinct window of the items, and the ids of those that have it, sorted as strings.

    Of an item with fewer than `size` words all are one window; one without words has none.
    """
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), _UPPER, _UPPER.lower()), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    split = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where("size(w) > 0")
    places = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = split.select("item", F.explode(F.transform(places, lambda i: F.array_join(F.slice("w", i, size), " "))).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def automaton(rows: list) -> tuple[dict[bytes, int], ahocorasick.Automaton, int]:
    """Numbers of the windows' words, the automaton over windows as sequences of these numbers, words of the longest window."""
    numbers: dict[bytes, int] = {}
    machine, longest = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE), 0
    for words, items in rows:
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in words.encode().split(b" "))
        machine.add_word(key, (len(key), items))
        longest = max(longest, len(key))
    machine.make_automaton()
    return numbers, machine, longest


@functools.lru_cache(1)
def _built(held: Broadcast) -> tuple:
    """The automaton of broadcast windows, built once in each worker process."""
    return automaton(held.value)


def pieces(data: bytes, size: int = PIECE):
    """(offset, part) of a lower-cased text in UTF-8, in parts of about `size` bytes that end between words."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data) and (m := _WORD.match(data, end)) and _WORD.match(data, end - 1):
            end = m.end()
        yield at, data[at:end]
        at = end


def scanned(data: bytes, numbers: dict[bytes, int], machine: ahocorasick.Automaton, longest: int, size: int = PIECE) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of a text, the words (first, last) that occurring windows cover, as disjoint ranges apart, and the items of those windows."""
    n, ranges, items, before = 0, [], set(), ()
    number, none = numbers.get, itertools.repeat(0)
    for _, part in pieces(data, size):
        line = before + tuple(map(number, _WORD.findall(part), none))
        base = n - len(before)
        for end, (held, ids) in machine.iter(line) if len(machine) else ():
            if end >= len(before):
                items.update(ids)
                first, last = base + end - held + 1, base + end
                while ranges and ranges[-1][1] >= first - 1:
                    first = min(first, ranges.pop()[0])
                ranges.append((first, last))
        n = base + len(line)
        before = line[max(0, len(line) - longest + 1) :]  # a window may begin there and end in the next part
    return n, ranges, items


def located(data: bytes, ranges: list[tuple[int, int]], size: int = PIECE) -> list[tuple[int, int]]:
    """Code points (start, end exclusive) of ranges of words in the original text, which has as many bytes as the lower-cased one."""
    out, k, word, chars = [], 0, 0, 0
    for _, part in pieces(data, size):
        if k == len(ranges):
            break
        spans = [m.span() for m in _WORD.finditer(part)]
        begins = np.cumsum((np.frombuffer(part, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
        while k < len(ranges):
            first, last = ranges[k][0] - word, ranges[k][1] - word
            if len(out) == k and first < len(spans):
                out.append((chars + int(begins[spans[first][0]]) - 1, -1))
            if last >= len(spans):
                break
            out[k] = (out[k][0], chars + int(begins[spans[last][1] - 1]))
            k += 1
        word += len(spans)
        chars += int(begins[-1])
    return out


def _merged(old: list[dict], new: list[tuple]) -> list[tuple]:
    """Both lists of (first, last, start, end), united; ranges of words that touch become one."""
    out: list[tuple] = []
    for x in sorted([tuple(o.values()) for o in old] + new):
        if out and out[-1][1] >= x[0] - 1:
            y = out.pop()
            x = (y[0], max(x[1], y[1]), y[2], max(x[3], y[3]))
        out.append(x)
    return out


def _scan(rows: DataFrame, held: Broadcast) -> DataFrame:
    """rows of _SCHEMA with what the windows in `held` add to n_words, hits and items."""

    def run(parts):
        known_windows = _built(held)
        for part in parts:
            texts, before, known = part.column(1).cast(pa.binary()), part.column(3), part.column(4)
            n, hits, items = [], [], []
            for i in range(len(part)):
                data = (texts[i].as_py() or b"").lower()
                words, ranges, found = scanned(data, *known_windows)
                new = [(*r, *s) for r, s in zip(ranges, located(data, ranges), strict=True)] if ranges else []
                n.append(words)
                hits.append([dict(zip(("first", "last", "start", "end"), x, strict=True)) for x in _merged(before[i].as_py(), new)] if new else before[i].as_py())
                items.append(sorted(found.union(known[i].as_py())))
            kinds = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(hits, kinds), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hits", "items"])

    return rows.mapInArrow(run, _SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, hits, items, one row for each row of docs, in which `items` are those of whose windows some occur.

    hits: the passages that occurring windows cover, from the word `first` to `last`, code points `start` to `end`
    (exclusive) of the text as it was; passages that touch are one. Words are those of the contract, A-Z lower-cased.
    Null and empty texts have no words and no hits; an item without words, or an empty benchmark, hits nothing. Rows of
    one item_id are one item; windows of an item without an id hit words but are named nowhere. Rows that repeat a
    doc_id, or lack one, are judged row by row. Other columns are ignored.

    The windows go to the tasks as one automaton if their bytes, counted first, are within `most`; beyond that, they are
    dealt by hash to automata of about that size, one pass over the rows for each, cut between passes.
    """
    spark = docs.sparkSession
    held = cut(windows(benchmark, size))
    weight = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    total = held.agg(F.sum(weight)).first()[0] or 0
    slices = max(1, -(-total // most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast(_HITS).alias("hits"), F.array().cast("array<string>").alias("items"))
    for k in range(slices):
        part = held.where(F.pmod(F.xxhash64("words"), F.lit(slices)) == k).collect()
        rows = _scan(rows if k == 0 else cut(rows), spark.sparkContext.broadcast([(r["words"], r["items"]) for r in part]))
    return rows.select("doc_id", "n_words", "hits", "items")


def digest(found: DataFrame) -> DataFrame:
    """The columns of op12."""
    n_hit: Column = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def _words_sql(source: str, key: str) -> str:
    return rf"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {source}"


OP12_SQL = rf"""
WITH docs AS ({_words_sql("documents", "row_number() OVER () AS id, doc_id")}),
items AS ({_words_sql("benchmark", "item_id::VARCHAR AS item")}),
wins AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i : i + {WINDOW} - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), spots AS (
  SELECT id, i, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM wins) WHERE len(w) >= size)
), met AS (SELECT s.id, s.i, s.size, x.item FROM spots s JOIN wins x ON x.size = s.size AND x.words = s.words),
hits AS (SELECT id, count(DISTINCT place) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT id, i, size FROM met)) GROUP BY id),
named AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item FROM met WHERE item IS NOT NULL) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (id) LEFT JOIN named USING (id)
"""
