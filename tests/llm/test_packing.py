from collections import Counter

import numpy as np

from loomline.llm import packing, tokens


def bounded_best_fit(sizes, length, most):
    """(bin, offset) of each item, and how often a bin with room was closed: plain lists, every open bin looked at."""
    open_, out, made, closed = [], [], 0, 0
    for n in sizes:
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            least = min(f for f, _ in fits)
            b = [b for b in open_ if b[0] == least][-1]
            open_.remove(b)
        else:
            if len(open_) >= most and n < length:
                fullest = min(f for f, _ in open_)
                open_.remove([b for b in open_ if b[0] == fullest][-1])
                closed += 1
            b, made = (length, made), made + 1
        out.append((b[1], length - b[0]))
        if b[0] > n:
            open_.append((b[0] - n, b[1]))
    return out, closed


def test_open_bins_are_brute_force_and_close():
    g = np.random.default_rng(4)
    for most in (1, 3, 8, 2000):
        sizes = np.concatenate([g.integers(1, 101, 400), g.integers(40, 70, 400), [100, 100, 1, 1]]).tolist()
        bins = packing.OpenBins(100, most)
        got = [bins.place(n) for n in sizes]
        want, closed = bounded_best_fit(sizes, 100, most)
        assert got == want and bins.closed == closed and bins.open <= most
        assert (closed > 0) == (most < 2000)


def test_the_bound_binds_in_ordinary_streams_and_costs_little():
    g = np.random.default_rng(5)
    sizes = np.minimum(np.exp(g.normal(5.5, 1.2, 60000)).astype(int) + 1, 2048).tolist()
    bins = packing.OpenBins(packing.LENGTH, packing.OPEN_BINS)
    for n in sizes:
        bins.place(n)
    assert bins.closed > 0 and bins.next <= 1.03 * sum(sizes) / packing.LENGTH


def test_packed_rows_arrive_by_doc_id(spark):
    """The sequences are those of the brute force over the pieces by doc_id, also with ties, repeated rows and nulls."""
    g = np.random.default_rng(6)
    rows = [(i, " ".join(g.choice(["alpha", "be", "c"], n))) for i, n in enumerate(g.integers(0, 90, 150).tolist())] + [(3, "c"), (3, "c"), (None, None), (None, None), (None, "x y")]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), length=64, open_bins=4).toPandas()
    got = got.sort_values(["doc_id", "piece", "ids_crc32"], na_position="first", kind="stable")
    want, closed = bounded_best_fit(got.length.tolist(), 64, 4)
    by = lambda pairs: sorted(Counter(b for b, _ in pairs).values())
    assert closed and by(want) == by(zip(got.sequence_id, got.offset, strict=True)) and len(set(got.sequence_id)) == len({b for b, _ in want})


def test_slices_and_whole_batches_give_the_same_ids():
    import pyarrow as pa

    texts = pa.array(["one two", None, " x", "", "a  b\n c"] * 50 + ["word " * 4000])
    whole, at = tokens.encode(texts, added=True)
    parts = [tokens.encode(texts.slice(i, j - i), added=True) for i, j in tokens.slices(texts, 64)]
    assert np.array_equal(np.concatenate([p for p, _ in parts]), whole) and sum(len(o) - 1 for _, o in parts) == len(at) - 1
