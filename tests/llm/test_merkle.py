"""The manifest against a plain-loop version."""

import hashlib
import random
import zlib

import pytest

from loomline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, hash string, path string, `a.b` int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(hashes):
    """The root and, for each leaf, (left, right) level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = k // 16 * 16
            paths[i].append(("".join(level[run:k]), "".join(level[k + 1 : run + 16])))
            at[i] = k // 16
        level = [H(*level[k : k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


def expected(rows):
    by, out = {}, []
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        tops[s] = (own, *tree([leaf(r, r[4]) for r in own]))
    root, above = tree([tops[s][1] for s in sources])
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for s, up in zip(sources, above, strict=True):
        own, subroot, paths = tops[s]
        for r, path in zip(own, paths, strict=True):
            path = path + up
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            h = leaf(r, r[4] and r[4].translate(lower)) if hit else leaf(r, r[4])
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf(r, r[4]), subroot, root, H(*(a + b for a, b in path)), h, h == root))
    return out


def rows_of(n, seed):
    r = random.Random(seed)
    sources = [None, "", "s", "src1", "ñ", "z" * 40, "hot", "hot", "hot"]
    out = [(i, r.choice(sources), r.choice([None, "en", "d:e"]), r.choice([None, i]), r.choice([None, "", "Abc", "12:É x", f"Text {i}\0"]), "mine", "mine", 1) for i in range(n)]
    return out + [(None, "hot", "en", 1, "A", "", "", 1), (None, "hot", "en", 1, "B", "", "", 1), *out[:3], *out[:1]]


@pytest.mark.parametrize("n", [1, 16, 17, 600])
def test_manifest_is_that_of_plain_loops(spark, n):
    rows = rows_of(n, n)
    got = [tuple(x) for x in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)
    assert any(not x[-1] for x in got) or n < 17


def test_one_leaf_is_its_own_root(spark):
    rows = [(4, None, None, None, None, None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).first()
    assert got.leaf == got.subroot == got.root == H("1:4", "-" * 4) and got.proof_sha256 == H() and got.verified


def test_many_sources_of_one_leaf(spark):
    rows = [(i, f"src{i}", "en", 3, "Abc", "", "", 0) for i in range(300)]
    got = [tuple(x) for x in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(expected(rows), key=str)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
