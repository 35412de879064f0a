"""Word shingles as 64-bit hashes, vectorised over many documents at a time."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import mix, randoms

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = randoms(1, 256)
_PLACE = randoms(2, 4096) | np.uint64(1)
_STEP = randoms(3, 64) | np.uint64(1)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (split at ASCII white space, A-Z lower-cased) and each text's offsets into them.

    A null text has no words. Equal words have equal hashes whatever surrounds them.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    blank = _SPACE[data]
    start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    offsets = np.concatenate([[0], np.searchsorted(start, ends, side="right")])
    if not len(start):
        return np.zeros(0, np.uint64), offsets
    size = stop - start
    kept = _BYTE[_LOWER[data[~blank]]]
    first = np.cumsum(size) - size
    place = np.arange(len(kept)) - np.repeat(first, size)
    factor = _PLACE[place % len(_PLACE)]
    if size.max() > len(_PLACE):  # past the table each place still has a factor of its own
        factor += (place // len(_PLACE)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)
    return mix(np.add.reduceat(kept * factor, first) + size.astype(np.uint64)), offsets


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingle hashes; with fewer words the whole sequence as one; without words none."""
    words, offsets = word_hashes(texts)
    n = len(words)
    whole = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        whole += words[j : j + len(whole)] * _STEP[j]
    mix(whole)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches(texts: list[str | None], most: int = 1 << 18):
    """Index ranges of texts that hold about `most` characters (one text at least)."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set: equal sets have equal keys."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
