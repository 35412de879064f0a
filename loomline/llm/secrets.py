"""Secret scans: base rules, and a character convolutional network over every candidate with its surroundings."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .shingles import batches

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: What the network judges: runs of 8 such characters and more with a letter and a digit; values of 6 and more after a
#: name and : or =, after the words of an authorization, and the password of an address; and every base span.
RUN, DIGITS, LETTER = re.compile(r"[A-Za-z0-9+/_=.-]+"), re.compile("[0-9]+"), re.compile("[A-Za-z]")
VALUE = re.compile(r"""[A-Za-z0-9_]["']?\x20?[:=]\x20?["']?([^\s"'<>,;:=()\[\]{}]{6,})""")
BEARER = re.compile(r"(?:bearer|basic|authorization:?)\x20+([^\s\"'<>,;]{6,})", re.IGNORECASE | re.ASCII)
ADDRESS = re.compile(r"://[^\s/:@]*:([^\s/@]{4,})@")
#: Characters before a candidate, of it (longer ones are judged part by part), and after it.
BEFORE, INSIDE, AFTER = 24, 64, 8
#: Made-up labelled findings of each label at the start, and at least in a pass over all tasks; for a batch of labelled
#: snippets as many as one in MADE_SHARE of them; least recall of the threshold.
MADE_UP, MADE_SHARE, RECALL = 1500, 20, 0.98
#: Documents whose snippets one task trains on (about); snippets that are gone through in all, again and again in a small
#: table; one in KEPT_BACK of the labelled is kept back; fixed-point units of weights, and steps of a logit, that are added up.
TASK_DOCS, UPDATED, KEPT_BACK, UNITS, STEPS = 2000, 200_000, 4, 1 << 24, 1000
EMBED, FILTERS, REACH, SYMBOLS = 8, 24, 5, 98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' matches, leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the network judges in a text, by start: base spans, and what else may be a secret where no base span touches it."""
    found = []
    at = 0
    for m in DIGITS.finditer(text):  # runs with a digit, from the digit outwards
        if m.start() < at:
            continue
        start = m.start()
        while start > at and RUN.match(text[start - 1]):
            start -= 1
        at = RUN.match(text, m.start()).end()
        while start < at and text[start] in ".-/=":
            start += 1
        end = at
        while end > start and text[end - 1] in ".-/":
            end -= 1
        if end - start >= 8 and LETTER.search(text, start, end):
            found.append((start, end))
    if ":" in text or "=" in text:
        found += [m.span(1) for m in VALUE.finditer(text)]
        if "@" in text:
            found += [m.span(1) for m in ADDRESS.finditer(text)]
    low = text.lower()
    if "bearer" in low or "basic" in low or "authorization" in low:
        found += [m.span(1) for m in BEARER.finditer(text)]
    out, end = [], 0
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        if a >= end:  # of overlapping ones the first, of equal starts the longest
            out.append((a, b))
            end = b
    at, free = 0, []
    for a, b in out:
        while at < len(base) and base[at][2] <= a and (at + 1 == len(base) or base[at + 1][0] <= a):
            at += 1
        if not any(s < b and a < e for s, _, e in base[max(0, at - 3) : at + 4]):
            free.append((a, b))
    return sorted(set(free) | {(a, e) for a, _, e in base})


def views(text: str, start: int, end: int) -> list[np.ndarray]:
    """A candidate's parts with their surroundings as symbol codes: 0 beyond the text, 1..95 ASCII, 96 others, 97 line ends."""
    out = []
    for a in range(start, end, INSIDE):
        b = min(a + INSIDE, end)
        left, right = text[max(0, a - BEFORE) : a], text[b : b + AFTER]
        part = text[a:b]
        x = np.zeros(BEFORE + INSIDE + AFTER, np.int64)
        for at, piece in ((BEFORE - len(left), left), (BEFORE, part), (BEFORE + len(part), right)):
            c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            x[at : at + len(c)] = np.where((c >= 32) & (c < 127), c - 31, np.where(c == 10, 97, 96))
        out.append(x)
    return out


def _columns(e: np.ndarray) -> np.ndarray:
    return np.concatenate([e[:, j : e.shape[1] - REACH + 1 + j] for j in range(REACH)], axis=2)


def logits(p: dict, x: np.ndarray) -> np.ndarray:
    out = []
    for i in range(0, len(x), 512):
        h = np.maximum(_columns(p["embed"][x[i : i + 512]]) @ p["conv"] + p["shift"], 0)
        out.append(np.concatenate([h.max(axis=1), h.mean(axis=1)], axis=1) @ p["out"] + p["bias"])
    return np.concatenate(out) if out else np.zeros(0)


SIGNS = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"))
#: Usual beginnings of tokens, names that secrets follow, and names that other values follow.
HEADS = ("ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "xoxp-", "eyJhbGciOi", "AIza", "glpat-", "npm_", "SG.", "AKIA", "")
SECRET_NAMES = ("password=", "passwd: ", "pwd=", "PASS=", "secret: ", "client_secret=", "token=", "access_token: ", "auth=", "Authorization: Bearer ", "Bearer ", "api-key: ", "private_key=", "credential: ", "session=", "signature=", "postgres://admin:", "https://user:")
OTHER_NAMES = ("id=", "name: ", "version: ", "file=", "date: ", "page=", "lang=", "ref: ", "see: ", "note: ", "title=", "path=", "color: ", "size=", "")


def findings(rng: np.random.Generator, n: int, words: list[str]) -> list[tuple[str, int, int, float]]:
    """n made-up labelled findings of each label: (text, start, end, label).

    Secrets are random strings of several alphabets and lengths, after a name or alone with a usual beginning; so are
    passwords of a word with digits and signs after a name. The others are what texts hold besides: stamps, versions,
    file names, identifiers, numbers, words and placeholders, after names of secrets too.
    """
    pick = lambda c: c[int(rng.integers(len(c)))]
    word = lambda: pick(words) if words else "word"
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for i in range(2 * n):
        left, right = f"{word()} {word()} ", f" {word()}"
        if i < n:
            kind = rng.random()
            if kind < 0.75:
                v = "".join(rng.choice(SIGNS[: pick((62, 62, 66, 36))], rng.integers(20, 61)))
                v, name = (pick(HEADS) + v, "") if rng.random() < 0.5 else (v, pick(SECRET_NAMES))
            else:
                name = pick(SECRET_NAMES)
                v = "".join(rng.choice(SIGNS, rng.integers(10, 20))) if kind < 0.9 else f"{word().capitalize()}{pick('!#$%&*')}{number(3)}{pick('!?xQz')}{''.join(rng.choice(SIGNS[:62], 4))}"
            right = f"@{word()}.example" if "://" in name else right
        else:
            name = pick(OTHER_NAMES) if rng.random() < 0.8 else pick(SECRET_NAMES[:5])
            v = (
                lambda: f"20{number(2)}-0{1 + int(number(1)) % 9}-1{number(1)}T1{number(1)}:{number(2)}:00Z", lambda: f"v{number(1)}.{number(2)}.{number(1)}-beta{number(1)}",
                lambda: f"IMG_20{number(6)}_{number(3)}.jpg", lambda: f"{word()}{word().capitalize()}{number(2)}", lambda: f"{word()}_{word()}_{number(3)}", lambda: f"{word()}-{word()}-{number(2)}",
                lambda: number(int(rng.integers(8, 17))), lambda: word() + word(), lambda: f"/{word()}/{word()}/{number(4)}.html", lambda: f"{word()}{number(4)}", lambda: f"your_{word()}_here", lambda: pick(("xxxxxxxx", "changeme", "********", "undefined")),
            )[int(rng.integers(12))]()
        out.append((left + name + v + right, len(left + name), len(left + name + v), float(i < n)))
    return out


def labelled(text: str) -> list[tuple[str, int, int, float]]:
    """Snippets (text, start, end, label) of a text: every part of its base spans is a finding, ordinary runs are none.

    What may be a secret and no rule touches is not labelled: the network is to judge it, not to be told that it is none.
    """
    base = base_spans(text)
    open_ = candidates(text, base)
    out, at = [], 0

    def add(a, b, y):
        for i in range(a, b, INSIDE):
            low, end = max(0, i - BEFORE), min(b, i + INSIDE)
            out.append((text[low : end + AFTER], i - low, end - low, y))

    for a, _, e in base:
        add(a, e, 1.0)
    taken = sorted([(a, b) for a, b in open_] + [(a, e) for a, _, e in base])
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not any(a < m.end() and m.start() < b for a, b in taken[at : at + 4]):
            add(m.start(), m.end(), 0.0)
    return out


def calibration(z: np.ndarray, y: np.ndarray, many: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve from logits to chances of greatest likelihood, by Newton steps; `many`: times each counts.

    Labels are smoothed by one finding and one other, so that a perfect separation has a curve too.
    """
    many = np.ones(len(y)) if many is None else many.astype(float)
    n, k = float(many.sum()), float((many * y).sum())
    t = np.where(y > 0, (k + 1) / (k + 2), 1 / (n - k + 2))
    w = np.zeros(2)
    x = np.stack([z, np.ones(len(y))], 1)
    loss = lambda w: float(np.sum(many * (np.logaddexp(0, x @ w) - t * (x @ w))))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (many * (q - t))
        step = np.linalg.solve(x.T @ (x * (many * q * (1 - q))[:, None]) + 1e-6 * np.eye(2), g)
        rate = 1.0
        while loss(w - rate * step) > loss(w) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def start_weights(rng: np.random.Generator) -> dict:
    p = {"embed": rng.standard_normal((SYMBOLS, EMBED)) * 0.3, "conv": rng.standard_normal((REACH * EMBED, FILTERS)) * 0.15, "shift": np.zeros(FILTERS), "out": rng.standard_normal(2 * FILTERS) * 0.1, "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def viewed(rng: np.random.Generator, snippets: list[tuple[str, int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of snippets; a quarter of the findings have their surroundings blotted out, so that the network learns the strings too."""
    xs, ys = np.zeros((len(snippets), BEFORE + INSIDE + AFTER), np.int64), np.zeros(len(snippets), np.float32)
    for i, (t, a, b, y) in enumerate(snippets):
        xs[i], ys[i] = views(t, a, b)[0], y
        if y and rng.random() < 0.25:
            xs[i, :BEFORE] = 1
    return xs, ys


def descend(p: dict, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int, even: bool = False) -> dict:
    """Weights after so many passes over views and labels; `even`: both labels weigh as much, however many of each there are."""
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    use, share = np.arange(len(x)), float(y.mean()) if len(y) else 0.0
    weigh = np.where(y > 0, 0.5 / max(share, 0.01), 0.5 / max(1 - share, 0.01)).astype(np.float32) if even else np.ones(len(x), np.float32)
    for _ in range(epochs):
        rng.shuffle(use)
        for i in range(0, len(use), 128):
            b = use[i : i + 128]
            xb = x[b]
            wide = min(x.shape[1], int(np.flatnonzero(xb.any(axis=0))[-1]) + REACH + 1)
            over = x.shape[1] - wide  # columns beyond are those of nothing, like the last one that is left
            xb = xb[:, :wide]
            cols = _columns(p["embed"][xb])
            h = np.maximum(cols @ p["conv"] + p["shift"], 0)
            many = h.shape[1] + over
            top = h.argmax(axis=1)
            pooled = np.concatenate([h.max(axis=1), (h.sum(axis=1) + np.float32(over) * h[:, -1]) / np.float32(many)], axis=1)
            d = weigh[b] * (1 / (1 + np.exp(-(pooled @ p["out"] + p["bias"]))) - y[b]) / len(b)
            g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
            dp = d[:, None] * p["out"]
            dh = np.repeat(dp[:, None, FILTERS:] / np.float32(many), h.shape[1], axis=1)
            dh[:, -1] *= over + 1
            np.add.at(dh, (np.arange(len(b))[:, None], top, np.arange(FILTERS)[None]), dp[:, :FILTERS])
            dh *= h > 0
            g["conv"] = cols.reshape(-1, REACH * EMBED).T @ dh.reshape(-1, FILTERS)
            g["shift"] = dh.sum(axis=(0, 1))
            dc = dh @ p["conv"].T
            de = np.zeros((*xb.shape, EMBED), np.float32)
            for j in range(REACH):
                de[:, j : j + dc.shape[1]] += dc[:, :, j * EMBED : (j + 1) * EMBED]
            g["embed"] = np.zeros_like(p["embed"])
            for e in range(EMBED):
                g["embed"][:, e] = np.bincount(xb.ravel(), de[..., e].ravel(), SYMBOLS)
            step += 1
            for k, v in g.items():
                m[k] += np.float32(0.1) * (v - m[k])
                s[k] += np.float32(0.01) * (v * v - s[k])
                p = p | {k: (p[k] - np.float32(0.005) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s[k] / np.float32(1 - 0.99**step)) + np.float32(1e-7))).astype(np.float32)}
    return p


def thresholded(p: dict, z: np.ndarray, t: np.ndarray, many: np.ndarray | None = None) -> dict:
    """p with what kept back logits and labels (each `many` times) tell: calibration, threshold, recall and precision there.

    The threshold is the largest that still finds RECALL of the findings, whatever that value is. `held` has chances and
    labels: all up to a million, of more as many in proportion.
    """
    many = np.ones(len(z), np.int64) if many is None else many
    a, c = calibration(z.astype(float), t, many)
    q = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
    order = np.argsort(q[t > 0], kind="stable")
    upto = np.cumsum(many[t > 0][order])
    least = float(q[t > 0][order][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), side="right")])
    told, found = q >= least, many * t
    shown = -(-many // max(1, int(many.sum()) // 1_000_000))
    return p | {"a": a, "c": c, "threshold": least, "recall": float(found[told].sum() / found.sum()), "precision": float(found[told].sum() / many[told].sum()), "held": (np.repeat(q, shown), np.repeat(t, shown))}


def train(snippets: list[tuple[str, int, int, float]], epochs: int = 10, seed: int = 1) -> dict:
    """Fit on labelled snippets and on made-up labelled findings among their words; a quarter of all is kept back for thresholded()."""
    rng = np.random.default_rng(seed)
    words = sorted({w for t, *_ in snippets for w in re.findall("[a-z]{3,9}", t)})
    x, y = viewed(rng, [*snippets, *findings(rng, MADE_UP, words)])
    held = rng.random(len(x)) < 1 / KEPT_BACK
    p = descend(start_weights(rng), x[~held], y[~held], rng, epochs)
    return thresholded(p, logits(p, x[held]), y[held])


def judged(p: dict, texts: list[str], base: list[list]) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of every candidate of each text; a long one has its highest part's score."""
    out, asked, rows = [{} for _ in texts], [], []
    for i, t in enumerate(texts):
        for a, b in candidates(t, base[i]):
            parts = views(t, a, b)
            asked += [(i, a, b)] * len(parts)
            rows += parts
    if rows:
        q = 1 / (1 + np.exp(-np.clip(p["a"] * logits(p, np.array(rows)) + p["c"], -30, 30)))
        for (i, a, b), v in zip(asked, q.tolist(), strict=True):
            out[i][a, b] = max(v, out[i].get((a, b), 0.0))
    return [[(a, b, v) for (a, b), v in x.items()] for x in out]


def network_spans(p: dict, found: list[tuple[int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Judged candidates of a text that the network takes for secrets, beside the base spans."""
    own = {(a, e) for a, _, e in base}
    return [(a, 3, b) for a, b, v in found if v >= p["threshold"] and (a, b) not in own]


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def examples(docs: DataFrame) -> DataFrame:
    """h, snippet, start, end, label: every distinct labelled snippet of all whole texts, without the words around it.

    A snippet keeps what adjoins it up to white space. Rows and texts that repeat count once. h, a hash, is the order in a file.
    """

    def run(parts):
        for part in parts:
            found = set()
            for t in part.column(0).to_pylist():
                for x, a, b, y in labelled(t):
                    left = x[:a].split()[-1] if a and not x[a - 1].isspace() else ""
                    right = x[b:].split()[0] if b < len(x) and not x[b].isspace() else ""
                    found.add((left + x[a:b] + right, len(left), len(left) + b - a, y))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 4, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["snippet", "start", "end", "label"])

    names = ["h", "snippet", "start", "end", "label"]
    texts = docs.where(F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, "snippet string, start int, end int, label double").select(F.xxhash64("snippet", "start", "end", "label").alias("h"), "*")
    return cut(rows.repartition(max(1, docs.count() // TASK_DOCS), "h").dropDuplicates(names).sortWithinPartitions(*names))


def _surrounded(part: pa.RecordBatch, seed: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Views and labels of a batch of examples() and of made-up findings.

    Around a snippet stand beginnings of others of the batch, drawn: of themselves surroundings must not tell a label.
    """
    h, texts, start, end, label = (part.column(i).to_pylist() for i in range(5))
    n = len(texts)
    rng = np.random.default_rng([seed, h[0] & (2**63 - 1)])
    some = [t for t, y in zip(texts, label, strict=True) if not y] or ["word"]
    near = [some[i][:k] for i, k in zip(rng.integers(0, len(some), 3 * n).tolist(), rng.integers(2, 10, 3 * n).tolist(), strict=True)]
    lefts = [f"{a} {b} " for a, b in zip(near[:n], near[n : 2 * n], strict=True)]
    whole = [f"{a}{t} {c}" for a, t, c in zip(lefts, texts, near[2 * n :], strict=True)]
    size, before = np.array([len(t) for t in whole]), np.array([len(t) for t in lefts])
    begin = np.cumsum(size) - size
    c = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where((c >= 32) & (c < 127), c - 31, np.where(c == 10, 97, 96))
    first, last = begin + before + np.array(start), begin + before + np.array(end)
    at = (first - BEFORE)[:, None] + np.arange(BEFORE + INSIDE + AFTER)
    inside = (at >= begin[:, None]) & (at < np.minimum(last + AFTER, begin + size)[:, None])
    x, y = np.where(inside, c[np.clip(at, 0, len(c) - 1)], 0), np.array(label, np.float32)
    x[(y > 0) & (rng.random(n) < 0.25), :BEFORE] = 1
    words = [w for t in some for w in re.findall("[a-z]{3,9}", t)[:1]]
    made = viewed(rng, findings(rng, max(least, n // MADE_SHARE), words))
    return np.concatenate([x, made[0]]), np.concatenate([y, made[1]])


def fit(docs: DataFrame) -> dict:
    """Train on every labelled snippet of all texts, in tasks; one in KEPT_BACK of them, by hash, calibrates and sets the threshold instead.

    All tasks start from the same weights, and the network has the mean of theirs by the rows that they read. Weights and
    counts of logits are added up in Spark as whole numbers, so that no order of tasks changes the sums; the driver gets
    one number for each weight, and counts by label and logit (in steps of 1 / STEPS).
    """
    rows = examples(docs)
    start = train([])  # made-up findings alone: where tasks begin, and what an empty table leaves
    p = {k: start[k] for k in ("embed", "conv", "shift", "out", "bias")}
    kept = F.pmod("h", F.lit(KEPT_BACK)) == 0
    passes = min(8, max(1, -(-UPDATED // max(1, rows.count()))))
    least = MADE_UP // max(1, docs.count() // TASK_DOCS)

    def learn(parts, first=p):
        own, n = first, 0
        for part in parts:
            if part.num_rows:
                for turn in range(passes):
                    own = descend(own, *_surrounded(part, turn, least), np.random.default_rng([turn, part.num_rows]), 1, even=True)
                n += part.num_rows
        if n:
            flat = np.concatenate([v.ravel() for v in own.values()]).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.rint(flat * UNITS).astype(np.int64) * n), pa.array(np.full(len(flat), n))], ["at", "total", "n"])

    def judge(parts):
        for part in parts:
            if part.num_rows:
                x, y = _surrounded(part, passes, least // KEPT_BACK)
                pairs, n = np.unique(np.stack([np.rint(logits(p, x) * STEPS).astype(np.int64), y.astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), pa.array(n)], ["z", "y", "n"])

    got = rows.where(~kept).mapInArrow(learn, "at long, total long, n long").groupBy("at").agg((F.sum(F.col("total").cast("decimal(38,0)")) / F.sum("n")).cast("double").alias("v")).orderBy("at").toPandas()
    if len(got):
        flat, ends = got.v.to_numpy(float) / UNITS, np.cumsum([0, *(v.size for v in p.values())])
        p = {k: flat[i:j].reshape(v.shape).astype(np.float32) for (k, v), i, j in zip(p.items(), ends[:-1], ends[1:], strict=True)}
    got = rows.where(kept).mapInArrow(judge, "z long, y long, n long").groupBy("z", "y").agg(F.sum("n").alias("n")).orderBy("z", "y").toPandas()
    return thresholded(p, got.z.to_numpy(float) / STEPS, got.y.to_numpy(float), got.n.to_numpy(np.int64)) if len(got) else start


def scanned(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_cnn, scores, one row for each row of docs.

    scores has start:end:score of every candidate that the network judged, base spans too; spans has the base spans and
    the candidates at its threshold or above. Null and empty texts have no spans; very long texts are scanned whole;
    repeated rows and null doc_ids are scanned row by row; other columns are ignored; an empty table gives no rows.
    """

    model = {k: v for k, v in model.items() if k != "held"}  # tasks need the network alone

    def run(parts):
        for part in parts:
            texts = [t or "" for t in part.column(1).to_pylist()]
            out = [[] for _ in range(7)]
            for i, j in batches(texts):
                base = [base_spans(t) for t in texts[i:j]]
                for b, found in zip(base, judged(model, texts[i:j], base), strict=True):
                    counts = [sum(k == q for _, k, _ in b) for q in range(3)]
                    more = network_spans(model, found, b)
                    scores = ",".join(f"{a}:{e}:{v:.3f}" for a, e, v in found)
                    for c, v in zip(out, (*counts, hashlib.sha256(listed(b).encode()).hexdigest(), listed(sorted(b + more)), len(more), scores), strict=True):
                        c.append(v)
            types = (pa.int64(),) * 3 + (pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "scores"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, scores string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scanned(docs, fit(docs))
