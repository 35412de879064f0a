"""Toxicity scores: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network is written and trained in numpy on the driver, from a bounded sample of labelled rows of any length. Spark
tasks read their whole texts: they count the evidence of words, pick the windows that the driver trains on, and find the
highest window of each for calibration. Spark tasks then score every overlapping window of every whole text, and a
document's score is that of its highest window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, mix, named, randoms, shuffle_partitions, table, unused
from .shingles import batches, shingle_sets
from .tokens import slices

#: Bounds of the training sample: labelled rows of each kind.
MOST_TOXIC, MOST_CLEAN = 1500, 3000
WINDOW, STRIDE = 48, 32
BUCKETS, WIDTH, HIDDEN, ATTEND = 1 << 15, 8, 12, 12
#: Min-hashes of a text, and how many must equal those of an earlier text of the same label for a copy of it.
SIGNATURE, COPY = 32, 28
#: Windows of a text that the driver trains on: all up to MOST_WINDOWS; of more, HINTED with most evidence, others by hash.
MOST_WINDOWS, HINTED = 24, 18
GRAMS = (3, 5, 7)
#: Embeddings begin at a bucket's log odds, the more so the less likely its share of toxic texts is by chance (half of them
#: at this log); how far embeddings learn beside the other weights, their decay, and the share of words that training leaves out.
SURPRISE, SLOW, DECAY, DROPPED = 7.0, 0.03, 1e-3, 0.05
#: Updates before the network's own scores, in place of the words' log odds, say which window of a text is its highest.
UNTAUGHT = 80
#: One in so many training texts is kept back for calibration.
KEPT_BACK = 5

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[[i for i in range(128) if not chr(i).isalnum()]] = 32
_BYTE, _PLACE, _AT = randoms(11, 256), randoms(12, 64) | np.uint64(1), randoms(13, 64) | np.uint64(1)


def _grams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams' buckets of some words, each between two blanks, word after word, and how many each word has (one at least)."""
    long = size + 2
    begin = np.cumsum(long) - long
    of = np.repeat(np.arange(len(start)), long)
    flat = data[np.repeat(start - 1, long) + np.arange(len(of)) - np.repeat(begin, long)]
    grams, owners = [], []
    for n in GRAMS:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h += _BYTE[flat[j : j + m]] * _AT[j]
        inside = of[:m] == of[n - 1 :]
        grams.append((mix(h[inside] + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        owners.append(of[:m][inside])
    owner = np.concatenate(owners)
    return np.concatenate(grams)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(start))


class Words:
    """The words of some texts: for each a dictionary index, and for each dictionary entry its hash buckets."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = _CLEAN[np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)]
        ends = np.cumsum([len(r) + 1 for r in raw])
        blank = data == 32
        start = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
        stop = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        self.offsets = np.concatenate([[0], np.searchsorted(start, ends, side="right")])
        if not len(start):
            self.index, self.word, self.gram, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        size = stop - start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        keys = mix(np.add.reduceat(_BYTE[data[~blank]] * (_PLACE[place & 63] + (place >> 6).astype(np.uint64)), np.cumsum(size) - size) + size.astype(np.uint64))
        self.index = pa.array(keys).dictionary_encode().indices.to_numpy().astype(np.int64)
        once = np.flatnonzero(np.diff(np.maximum.accumulate(self.index), prepend=-1))
        self.word = (keys[once] & np.uint64(BUCKETS - 1)).astype(np.int64)
        parts = [_grams(data, start[x], size[x]) for i in range(0, len(once), 1 << 14) for x in [once[i : i + (1 << 14)]]]
        many = np.concatenate([m for _, m in parts])
        self.gram, self.first = np.concatenate([g for g, _ in parts]), np.cumsum(many) - many

    def inputs(self, p: dict) -> np.ndarray:
        """Word embedding beside the mean of the character n-gram embeddings, for each dictionary entry."""
        if not len(self.word):
            return np.zeros((0, 2 * WIDTH), np.float32)
        count = np.diff(np.append(self.first, len(self.gram)))[:, None].astype(np.float32)
        return np.concatenate([p["word"][self.word], np.add.reduceat(p["gram"][self.gram], self.first, axis=0) / count], axis=1)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows (positions of words, -1 past a text's end) and the text of each; an empty text has one empty window."""
        n = np.diff(self.offsets)
        many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), many)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        places = self.offsets.astype(np.int32 if self.offsets[-1] < 2**31 - WINDOW else np.int64)
        at = (places[text] + begin.astype(places.dtype))[:, None] + np.arange(WINDOW, dtype=places.dtype)
        at[at >= places[text + 1][:, None]] = -1
        return at, text


def _sigmoid(x):
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def start_weights(seed: int = 1) -> dict:
    g = np.random.default_rng(seed)
    r = lambda *s: (g.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {k: np.zeros((BUCKETS, WIDTH), np.float32) for k in ("word", "gram")}
    for d in "fb":
        p |= {f"x{d}": r(2 * WIDTH, 3 * HIDDEN), f"u{d}": r(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
    return p | {"att": r(2 * HIDDEN, ATTEND), "v": r(ATTEND), "out": r(2 * HIDDEN), "bias": np.zeros(1, np.float32), "slope": np.ones(1, np.float32), "shift": np.zeros(1, np.float32)}


def _gru(p: dict, d: str, rows: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States (steps, windows, HIDDEN). rows: projected inputs by dictionary entry; index, mask: (steps, windows)."""
    u, n = p[f"u{d}"], index.shape[1]
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((len(index), n, HIDDEN), np.float32)
    full = mask.all(axis=1)
    for t in range(len(index)) if d == "f" else range(len(index) - 1, -1, -1):
        x, hu = rows[index[t]], h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = c + z * (h - c)
        if not full[t]:
            new *= mask[t][:, None]
        if keep is not None:
            keep.append((t, h, z, r, c, hu[:, 2 * HIDDEN :]))
        out[t] = h = new
    return out


def forward(p: dict, rows: tuple[np.ndarray, np.ndarray], index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """One logit for each window."""
    kept = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
    h = np.concatenate([_gru(p, d, x, index, mask, kept[d]) for d, x in zip("fb", rows, strict=True)], axis=2)
    a = np.tanh(h @ p["att"])
    e = np.where(mask, a @ p["v"], np.float32(-30))
    w = np.exp(e - e.max(axis=0))
    w /= w.sum(axis=0)
    pooled = (h * w[:, :, None]).sum(axis=0)
    if keep is not None:
        keep |= {"kept": kept, "h": h, "a": a, "w": w, "pooled": pooled}
    return pooled @ p["out"] + p["bias"]


def backward(p: dict, k: dict, d_logit: np.ndarray, mask: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the dense weights, and of the projected inputs in each direction."""
    g = {"out": k["pooled"].T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pool = d_logit[:, None] * p["out"]
    h, w, a = k["h"], k["w"], k["a"]
    dw = (h * d_pool).sum(axis=2)
    de = w * (dw - (w * dw).sum(axis=0)) * mask
    da = de[:, :, None] * p["v"] * (1 - a * a)
    g["v"] = (a * de[:, :, None]).sum(axis=(0, 1))
    g["att"] = np.einsum("tbi,tbj->ij", h, da)
    dh_all = w[:, :, None] * d_pool + da @ p["att"].T
    dx = {}
    for i, d in enumerate("fb"):
        u, own = p[f"u{d}"], dh_all[:, :, i * HIDDEN : (i + 1) * HIDDEN]
        dx[d] = np.zeros((*own.shape[:2], 3 * HIDDEN), np.float32)
        gu, dh = np.zeros_like(u), np.zeros(own.shape[1:], np.float32)
        for t, before, z, r, c, hc in reversed(k["kept"][d]):
            dh = (dh + own[t]) * mask[t][:, None]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            dx[d][t] = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            gu += before.T @ du
            dh = dh * z + du @ u.T
        g[f"u{d}"], g[f"c{d}"] = gu, dx[d].sum(axis=(0, 1))
    return g, dx


def _sum_by(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    at = index[order]
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def _counts(texts: list[str | None], y: np.ndarray) -> np.ndarray:
    """For the buckets of words and of n-grams (BUCKETS each): toxic texts that hold one, and all texts that do."""
    out = np.zeros((2, 2, BUCKETS), np.int64)
    for i, j in batches(texts, 1 << 18):
        w = Words(texts[i:j])
        owner = np.repeat(np.arange(j - i), np.diff(w.offsets))
        many = np.diff(np.append(w.first, len(w.gram)))[w.index]
        at = np.repeat(w.first[w.index], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        for k, (buckets, of) in enumerate(((w.word[w.index], owner), (w.gram[at], np.repeat(owner, many)))):
            pairs = np.unique(of * BUCKETS + buckets)
            out[k, 0] += np.bincount(pairs % BUCKETS, weights=y[i:j][pairs // BUCKETS], minlength=BUCKETS).astype(np.int64)
            out[k, 1] += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
    return out


def _log_odds(counts: np.ndarray, base: float) -> dict[str, np.ndarray]:
    """For the buckets of words and of n-grams: log odds that a text that holds one is toxic, drawn towards 0 as far as chance explains them."""
    out = {}
    for k, (one, all_) in zip(("word", "gram"), counts, strict=True):
        share = np.clip(one / np.maximum(all_, 1), 1e-9, 1 - 1e-9)
        surprise = all_ * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base)))
        odds = np.clip(np.log((one + base) / (all_ - one + 1 - base) * (1 - base) / base), -2, 5)
        out[k] = (odds / (1 + np.exp(np.clip(2 * (SURPRISE - surprise), -30, 30)))).astype(np.float32)
    return out


def _picked(texts: list[str | None], odds: dict) -> list[tuple[list[bytes], list[int]]]:
    """For each text the words of its windows for training, one window after another, and how many each has."""
    words = Words(texts)
    at, text = words.windows()
    hint = words.inputs({k: odds[k][:, None] for k in ("word", "gram")}).sum(axis=1)
    score = np.where(at >= 0, hint[words.index[at]] if len(hint) else 0, 0).max(axis=1)
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for t, i, j in zip(texts, ends[:-1], ends[1:], strict=True):
        keep = np.arange(j - i)
        if len(keep) > MOST_WINDOWS:
            by = np.argsort(-score[i:j], kind="stable")
            rest = by[HINTED:]
            keep = np.sort(np.concatenate([by[:HINTED], rest[np.argsort(mix(rest.astype(np.uint64) + np.uint64(1)))[: MOST_WINDOWS - HINTED]]]))
        said = _CLEAN[np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)].tobytes().split()
        parts = [said[k * STRIDE : k * STRIDE + WINDOW] for k in keep.tolist()]
        out.append(([w for x in parts for w in x], [len(x) for x in parts]))
    return out


def _signatures(texts: list[str | None]) -> list[np.ndarray]:
    """Min-hashes of each whole text's shingles; none of a text without words."""
    a = randoms(14, SIGNATURE) | np.uint64(1)
    return [np.array([(x * s).min() for x in a]) if len(s) else np.zeros(0, np.uint64) for j, k in batches(texts) for s in shingle_sets(texts[j:k], 4)]


def _unlike(signatures: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Positions of texts of which no near copy with the same label stands before them: a copied text must not count as
    many witnesses. Texts without words are no copies."""
    kept, label, out = np.zeros((len(signatures), SIGNATURE), np.uint64), np.zeros(len(signatures), int), []
    for i, (s, v) in enumerate(zip(signatures, np.asarray(y, int).tolist(), strict=True)):
        n = len(out)
        if len(s) and ((kept[:n] == s).sum(axis=1)[label[:n] == v] >= COPY).any():
            continue
        kept[n], label[n] = (s, v) if len(s) else (0, -1)
        out.append(i)
    return np.array(out, int)


def train(texts: list[str | None], y: np.ndarray, epochs: int = 8) -> dict:
    """Fit on texts with labels of 0 and 1 (either may be absent: the score is then the same for all)."""
    unlike = _unlike(_signatures(texts), y)
    texts, y = [texts[i] for i in unlike], np.asarray(y, np.float32)[unlike]
    if not len(y) or y.min() == y.max():
        return _untold(y)
    back = _kept_back(y)
    seen, heard = [t for t, b in zip(texts, back, strict=True) if not b], [t for t, b in zip(texts, back, strict=True) if b]
    odds = _log_odds(_counts(seen, y[~back]), y[~back].mean())
    picked = _picked(seen, odds)
    p = _fitted(pa.array((w for x, _ in picked for w in x), pa.binary()), [len(x) for _, x in picked], np.array([n for _, x in picked for n in x]), y[~back], odds, epochs)
    return p | _calibrated(_tops(p, heard or seen), y[back] if heard else y)


def _kept_back(y: np.ndarray) -> np.ndarray:
    """Of each label every KEPT_BACK-th text, which only calibrates: scores of texts that were trained on are too sure. None of a label
    with fewer than 3 * KEPT_BACK texts."""
    out = np.zeros(len(y), bool)
    if min((y == 0).sum(), (y == 1).sum()) >= 3 * KEPT_BACK:
        for v in (0, 1):
            out[np.flatnonzero(y == v)[KEPT_BACK - 1 :: KEPT_BACK]] = True
    return out


def _untold(y: np.ndarray) -> dict:
    """Weights where there is nothing to tell apart."""
    p = start_weights()
    p["out"][:] = 0
    p["shift"][:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 9))
    return p | {"slope": np.zeros(1, np.float32)}


def _fitted(said: pa.Array, many: list[int] | np.ndarray, sizes: np.ndarray, y: np.ndarray, odds: dict, epochs: int = 8, batch: int = 256, seed: int = 1) -> dict:
    """Weights, not calibrated yet, from the words of all windows, the windows of each text, the words of each window, and the texts' labels.

    Every word and n-gram has an embedding that is trained; its first component starts as its log odds. A toxic text is
    toxic in some window, not in all: each epoch takes its highest window as the toxic example, and a clean text's
    highest and one other as clean ones. Embeddings decay, and DROPPED of the words have no input in training, so that
    no text is learned by its rare words alone.
    """
    p = start_weights(seed)
    for k in ("word", "gram"):
        p[k][:, 0] = 0.5 * odds[k]
    coded = said.dictionary_encode()
    words = Words([b" ".join(coded.dictionary.to_pylist()).decode("utf-8", "surrogatepass")])
    words.index = words.index.astype(np.int32)[coded.indices.to_numpy()]
    del said, coded
    words.offsets = np.concatenate([[0], np.cumsum(sizes)])
    at, _ = words.windows()  # one each
    text = np.repeat(np.arange(len(many)), many)
    for d in "fb":
        p[f"x{d}"][[0, WIDTH]] += np.float32(0.5)
    index, mask = np.where(at >= 0, words.index[at], 0).T if len(words.index) else np.zeros_like(at).T, (at >= 0).T
    hint = words.inputs(p)[:, [0, WIDTH]].sum(axis=1)
    score = np.where(mask, hint[index] if len(hint) else 0, -9).max(axis=0).astype(np.float32)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    epochs = max(epochs, min(40, -(-240 * batch // (2 * len(y)))))  # a small sample needs its updates too
    weight = np.float32(min(8.0, (1 - y.mean()) / y.mean() / 2 + 1))
    for epoch in range(epochs):
        if step >= UNTAUGHT and epoch % 2:
            score = _scores(p, words, index, mask)
        order = np.lexsort((-score, text))
        first = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        other = rng.permutation(len(text))[: len(first)]
        chosen = np.concatenate([first, other[y[text[other]] == 0]])
        rng.shuffle(chosen)
        rate = np.float32(0.01 * (1 - 0.8 * epoch / epochs))
        for i in range(0, len(chosen), batch):
            c = chosen[i : i + batch]
            used, inner = np.unique(index[:, c], return_inverse=True)
            inner = inner.reshape(index[:, c].shape)
            sub = Words.__new__(Words)
            sub.word = words.word[used]
            grams = np.diff(np.append(words.first, len(words.gram)))[used]
            sub.first = np.cumsum(grams) - grams
            sub.gram = words.gram[np.repeat(words.first[used] - sub.first, grams) + np.arange(grams.sum())]
            kept = (rng.random(len(used)) >= DROPPED).astype(np.float32)[:, None]
            x = sub.inputs(p) * kept
            keep: dict = {}
            logit = forward(p, tuple(x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb"), inner, mask[:, c], keep)
            t = y[text[c]]
            g, dx = backward(p, keep, (_sigmoid(logit) - t) * np.where(t > 0, weight, 1).astype(np.float32) / len(c), mask[:, c])
            d_in = np.zeros_like(x)
            for d in "fb":
                summed = _sum_by(inner.ravel(), dx[d].reshape(-1, 3 * HIDDEN), len(used))
                g[f"x{d}"] = x.T @ summed
                d_in += summed @ p[f"x{d}"].T
            d_in *= kept
            g["word"] = _sum_by(sub.word, d_in[:, :WIDTH], BUCKETS)
            g["gram"] = _sum_by(sub.gram, np.repeat(d_in[:, WIDTH:] / grams[:, None], grams, axis=0), BUCKETS)
            step += 1
            for k, v in g.items():
                m[k] += np.float32(0.1) * (v - m[k])
                s[k] += np.float32(0.01) * (v * v - s[k])
                if k in ("word", "gram"):
                    p[k] *= np.float32(1 - DECAY)
                p[k] -= rate * (np.float32(SLOW) if k in ("word", "gram") else np.float32(1)) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return p


def _scores(p: dict, words: Words, index: np.ndarray, mask: np.ndarray, block: int = 512) -> np.ndarray:
    """Logit of each window."""
    x = words.inputs(p) if len(words.word) else np.zeros((1, 2 * WIDTH), np.float32)
    rows = tuple(x @ p[f"x{d}"] + p[f"c{d}"] for d in "fb")
    out = np.zeros(index.shape[1], np.float32)
    for i in range(0, len(out), block):
        out[i : i + block] = forward(p, rows, index[:, i : i + block], mask[:, i : i + block])
    return out


def _calibrated(top: np.ndarray, y: np.ndarray) -> dict:
    """Slope and shift of a logistic curve from the highest window's logit to the document's label, by damped Newton steps."""
    x = np.clip(top.astype(float), -30, 30)
    mid, wide = np.median(x), max(x.std(), 0.1)
    x = (x - mid) / wide
    at, damp = np.array([wide, mid]), 1e-3

    def loss(at):
        z = at[0] * x + at[1]
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (at[0] / wide - 1) ** 2

    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w, e = q * (1 - q), q - y
        grad = np.array([(e * x).sum() + (at[0] / wide - 1) / wide, e.sum()])
        hess = np.array([[(w * x * x).sum() + wide**-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess + damp * np.eye(2), grad)
        if loss(at - step) <= loss(at):
            at, damp = at - step, damp / 4
        else:
            damp *= 8
        if abs(step).max() < 1e-8:
            break
    slope = max(at[0] / wide, 0.05)
    return {"slope": np.array([slope], np.float32), "shift": np.array([at[1] - slope * mid], np.float32)}


def _tops(p: dict, texts: list[str | None]) -> np.ndarray:
    """Logit of the highest window of each whole text."""
    words = Words(texts)
    at, text = words.windows()
    index, mask = (np.where(at >= 0, words.index[at], 0) if len(words.index) else np.zeros_like(at)).T, (at >= 0).T
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, text, _scores(p, words, np.ascontiguousarray(index), np.ascontiguousarray(mask)).astype(float))
    return top


def score_texts(p: dict, texts: list[str | None]) -> np.ndarray:
    """Score in [0, 1] of each whole text: that of its highest window."""
    return 1 / (1 + np.exp(-np.clip(p["slope"][0] * _tops(p, texts) + p["shift"][0], -30, 30)))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of at most MOST_TOXIC + MOST_CLEAN distinct labelled doc_ids that are not held out.

    They are drawn in the order of a hash of doc_id; labels are null-safe, a doc_id labelled twice counts as toxic if
    any label is. A doc_id of several rows counts once and is read once, with its least text: rows become one in Spark,
    before the limit and before anything is collected.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    docs = docs.where(F.col("text").isNotNull())
    known = docs.select("doc_id").distinct().join(marked, "doc_id")
    some = None
    for value, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.union(part)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))


def _over(rows: DataFrame, run, schema: str) -> DataFrame:
    """run(texts, labels) over texts a batch at a time; it returns the columns beside doc_id."""
    names = [f.name for f in rows.select("doc_id").schema.fields] + [c.split()[0] for c in schema.split(", ")]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def go(parts):
        for part in parts:
            texts, y = part.column(1).to_pylist(), part.column(2).to_numpy()
            for i, j in batches(texts):
                yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), *run(texts[i:j], y[i:j])], names)

    return rows.select("doc_id", "text", "toxic").mapInArrow(go, f"doc_id {kind}, {schema}")


def _evidence(rows: DataFrame) -> np.ndarray:
    """_counts of all rows, added up in Spark."""

    def go(parts):
        total = np.zeros((2, 2, BUCKETS), np.int64)
        for part in parts:
            total += _counts(part.column(0).to_pylist(), part.column(1).to_numpy())
        flat = total.transpose(0, 2, 1).reshape(-1, 2)
        at = np.flatnonzero(flat[:, 1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at, 0]), pa.array(flat[at, 1])], ["at", "one", "every"])

    found = rows.select("text", "toxic").mapInArrow(go, "at long, one long, every long").groupBy("at").agg(F.sum("one").alias("one"), F.sum("every").alias("every")).toPandas()
    out = np.zeros((2 * BUCKETS, 2), np.int64)
    out[found["at"].to_numpy(int)] = found[["one", "every"]].to_numpy()
    return out.reshape(2, BUCKETS, 2).transpose(0, 2, 1)


def fit(docs: DataFrame, labels: DataFrame, epochs: int = 8) -> dict:
    """train() on the sample, whose whole texts are read in Spark tasks only; the driver gets at most MOST_WINDOWS windows of each."""
    rows = sample(docs, labels)
    rows = cut(rows.repartition(shuffle_partitions(rows.sparkSession), "doc_id"))
    signed = _over(rows, lambda t, y: [pa.array(y, pa.int32()), pa.array([s.tobytes() for s in _signatures(t)], pa.binary())], "toxic int, signature binary").toPandas().sort_values("doc_id")
    signed = signed.iloc[_unlike([np.frombuffer(s, np.uint64) for s in signed.signature], signed.toxic)]
    y = signed.toxic.to_numpy(np.float32)
    if not len(y) or y.min() == y.max():
        return _untold(y)
    back = _kept_back(y)
    ids = rows.sparkSession.createDataFrame(list(zip(signed.doc_id.tolist(), back.tolist(), strict=True)), rows.select("doc_id", F.lit(True).alias("back")).schema)
    rows = rows.join(F.broadcast(ids), "doc_id")  # as many as the sample at most
    seen, heard = rows.where("not back"), rows.where("back") if back.any() else rows
    odds = _log_odds(_evidence(seen), y[~back].mean())
    windows = _over(seen, lambda t, _: [pa.array(c, k) for c, k in zip(zip(*_picked(t, odds)), (pa.list_(pa.binary()), pa.list_(pa.int32())), strict=True)], "words array<binary>, sizes array<int>")
    windows = windows.toArrow().sort_by("doc_id").combine_chunks()  # no Python object for each word: the driver is small
    flat, each = (windows[c].chunk(0) for c in ("words", "sizes"))
    del windows
    p = _fitted(flat.flatten(), np.diff(each.offsets.to_numpy()), each.flatten().to_numpy(), y[~back], odds, epochs)
    del flat, each
    pa.default_memory_pool().release_unused()  # what follows runs beside this process, in a small driver
    top = _over(heard, lambda t, _: [pa.array(_tops(p, t))], "top double").toPandas().sort_values("doc_id").top
    return p | _calibrated(top.to_numpy(), y[back] if back.any() else y)


def scored(docs: DataFrame, model: dict, keep: list[str], name: str = "score") -> DataFrame:
    """The columns `keep` of docs with the score of each whole text in a last column `name`, which no kept column may have.

    Null and empty texts get a score too; rows are scored one by one, whatever repeats; an empty table gives no rows.
    """
    if name.lower() in (c.lower() for c in keep):
        raise ValueError(f"a column {name} is there already")
    # numbers for names in between: mapInArrow looks columns up by name, and would stop at back quotes
    kept = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(named(docs, *keep))], F.col("text").cast("string").alias("text"))
    fields = kept.schema.fields[:-1]
    schema = StructType([*fields, StructField("score", DoubleType())])

    def run(parts):
        for part in parts:
            pa.default_memory_pool().release_unused()  # what earlier batches and stages of this worker held
            for a, b in slices(part.column(len(fields))):
                some = part.slice(a, b - a)
                texts = some.column(len(fields)).to_pylist()
                got = [score_texts(model, texts[i:j]) for i, j in batches(texts)]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(fields)], pa.array(np.concatenate(got))], schema.names)

    return kept.mapInArrow(run, schema).toDF(*keep, name)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs whose whole text scores under the threshold, with their columns as they were, whatever their names.

    Null and empty texts are scored as texts without words; repeated rows have one score and stay or go together.
    """
    name = unused(docs, "score")
    return scored(docs, fit(docs, labels), docs.columns, name).where(F.col(name) < threshold).select(*named(docs))
