"""The automaton's findings against every window looked up in turn; offsets point into the original texts."""

import hashlib
import random
import re

import pytest

from loomline.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def split(text):
    return [(m.group(), *m.span()) for m in WORD.finditer((text or "").translate(LOWER))]


def expected(text, items, size):
    words = split(text)
    plain = [w for w, _, _ in words]
    hit, named = set(), set()
    for item, t in items:
        own = [w for w, _, _ in split(t)]
        wins = [own[i : i + size] for i in range(max(len(own) - size + 1, 1))] if own else []
        for w in wins:
            for i in range(len(plain) - len(w) + 1):
                if plain[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    named |= {str(item)} - {"None"}
    return words, sorted(hit), sorted(named)


def cases(seed):
    r = random.Random(seed)
    vocabulary = ["a", "B", "ca", "é", "É", "7", "日本", "😀x", "a1"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", "-", "\n\n", "...", "_", "\t"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 4, 5, 9, 30]))) for i in range(12)] + [(3, text(8)), (90, None), (91, " .. "), (None, text(6))]
    docs = [(i, text(r.randint(0, 60)) + (r.choice(items)[1] or "") + r.choice(["", " b"]) + text(r.randint(0, 20)), "x", [1]) for i in range(60)]
    return docs + [(None, None, "x", None), (5, "", "x", None), (5, items[0][1], "x", None)], items


@pytest.mark.parametrize("most", [1 << 20, 150])
def test_hits_are_those_of_every_window(spark, most):
    docs, items = cases(most % 97)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string, hits string, items array<int>"), spark.createDataFrame(items, "item_id long, text string")
    found = d.contaminated(frame, bench, size=4, most=most)
    want, digests = [], []
    for doc, text, _, _ in docs:
        words, hit, named = expected(text, items, 4)
        ranges = [(k, max(i for i in hit if set(range(k, i + 1)) <= set(hit))) for k in hit if k - 1 not in hit]
        want.append((doc, len(words), [(a, b, words[a][1], words[b][2]) for a, b in ranges], named))
        digests.append((doc, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    got = [(g.doc_id, g.n_words, [tuple(h) for h in g.hits], g["items"]) for g in found.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(w[2] for w in want)
    assert sorted(map(tuple, d.digest(found).collect()), key=str) == sorted(digests, key=str)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_texts_read_in_pieces_give_the_same(size):
    docs, items = cases(size)
    rows = {}
    for item, text in items:
        own = [w for w, _, _ in split(text)]
        for i in range(max(len(own) - 3, 1) if own else 0):
            rows.setdefault(" ".join(own[i : i + 4]), []).append(str(item))
    machine = d.automaton(list(rows.items()))
    for _, text, _, _ in docs:
        data = (text or "").encode().lower()
        whole, parts = d.scanned(data, *machine), d.scanned(data, *machine, size)
        assert whole == parts and d.located(data, whole[1]) == d.located(data, whole[1], size)


def test_pieces_cover_a_text_and_end_between_words():
    data = ("é日本😀 ab." * 50).encode()
    for size in (1, 2, 3, 5, 17, 1000):
        parts = list(d.pieces(data, size))
        assert b"".join(p for _, p in parts) == data
        assert [w for _, p in parts for w in d._WORD.findall(p)] == d._WORD.findall(data)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id string, text string")
    assert [tuple(x) for x in d.contaminated(docs, none).collect()] == [(1, 2, [], [])]
    assert d.contaminated(docs.limit(0), none).collect() == []


def test_an_item_of_a_long_text_and_a_very_long_text(spark):
    words = " ".join(f"w{i}" for i in range(3000))
    long_ = "x " * 600_000 + words + " y" * 600_000
    got = d.contaminated(spark.createDataFrame([(1, long_)], "doc_id long, text string"), spark.createDataFrame([("q", words)], "item_id string, text string")).first()
    assert got.n_words == 1_203_000 and [tuple(h) for h in got.hits] == [(600_000, 602_999, 1_200_000, 1_200_000 + len(words))]
