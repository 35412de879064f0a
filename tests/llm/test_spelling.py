"""Spelling variants against all pairs of words compared."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomline.llm import spelling

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def counted(docs, least, drop):
    out = Counter()
    for row in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(docs, least, count, times, drop):
    n = {w: c for w, c in counted(docs, least, drop).items() if c >= count}
    links = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(links[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(links[w]), n.get(form[w])))
    return sorted(out, key=str)


def documents(seed):
    r = random.Random(seed)
    letters = "aAbBéÉ÷"
    stems = ["".join(r.choice("ab") for _ in range(r.randint(2, 5))) for _ in range(12)]

    def word():
        w = r.choice(stems[: r.choice([1, 2, 12])])
        if r.random() < 0.3:
            k = r.randrange(len(w) + 1)
            w = w[:k] + r.choice(letters) + w[k + r.choice([0, 1]) :]
        return w

    return [(r.choice([None, i]), " ".join(word() + r.choice(["", ".", "ő", "7"]) for _ in range(r.randint(0, 80))), 1, "mine") for i in range(80)] + [(1, None, 1, ""), (2, "", 1, ""), (2, "aaab", 1, "")]


@pytest.mark.parametrize("seed", range(3))
def test_words_forms_and_roots_are_those_of_all_pairs(spark, seed):
    docs = documents(seed)
    frame = spark.createDataFrame(docs, "doc_id long, text string, n int, word string")
    got = spelling.variants(frame, least=2, count=2, times=2, drop=7).collect()
    want = expected(docs, 2, 2, 2, 7)
    assert sorted(map(tuple, got), key=str) == want
    assert any(w[1] and w[2] != w[1] for w in want) and any(w[4] > 3 for w in want)


def test_a_number_that_two_nodes_share_is_noticed(spark):
    words = spark.createDataFrame([("aab", 5, 0), ("abb", 5, 1), ("b", 5, 2)], "word string, n long, id long")
    assert spelling.distinct_nodes(words, 1)
    by_depth = lambda codes, seed: [np.arange(len(c) + 1) for c in codes]
    assert not spelling.distinct_nodes(words, 1, by_depth)
    to_root = lambda codes, seed: [np.zeros(len(c) + 1, np.int64) for c in codes]
    assert not spelling.distinct_nodes(words.where("word = 'b'"), 1, to_root)


def test_nodes_are_equal_for_equal_prefixes_only():
    words = ["", "a", "ab", "abé", "ba", "aba", "abab", "é" * 500]
    nodes = spelling.trie_nodes(spelling._codes(words), 1)
    paths = {}
    for w, x in zip(words, nodes, strict=True):
        for i, k in enumerate(x.tolist()):
            assert paths.setdefault(k, w[:i]) == w[:i]
    assert len(paths) == len({w[:i] for w in words for i in range(len(w) + 1)})


def test_runs_of_pieces_are_those_of_the_text():
    text = "abc é÷d 7 xyz" * 40 + "q" * 300
    for size in (1, 2, 5, 64, 10_000):
        assert [x for p in spelling.runs(text, size) for x in p] == spelling._RUN.findall(text)


def test_very_long_runs_and_empty_tables(spark):
    run = "".join(random.Random(1).choice("abc") for _ in range(20_000))
    docs = [(1, f"{run} {run}x"), (2, f"{run} {run}"), (3, f"{run} {run}")]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), count=1, drop=1 << 40).collect()
    assert sorted((len(g.word), g.n, g.n_near, g.form_n, len(g.root)) for g in got) == [(20_000, 5, 1, None, 20_000), (20_001, 1, 1, 5, 20_000)]
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError, match="rings"):
        spelling.variants(spark.createDataFrame([], "doc_id long, text string"), times=1)
