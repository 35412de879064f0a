"""Measurements of many series of one length at once, in numpy: a row of `v` is a series."""

from __future__ import annotations

import numpy as np

#: Values that are measured at once.
BLOCK = 1 << 18


def by_length(rows: list[np.ndarray]):
    """(places, matrix): rows of equal length together, about BLOCK values at a time."""
    size = np.array([len(r) for r in rows], int)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, BLOCK // max(int(n), 1))
        for i in range(0, len(at), step):
            yield at[i : i + step], np.stack([rows[k] for k in at[i : i + step]])


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson of the rows of a with those of b; 0 for fewer than 3 pairs or a standard deviation under 1e-12."""
    if a.shape[-1] < 3:
        return np.zeros(len(b))
    x, y = a - a.mean(axis=-1, keepdims=True), b - b.mean(axis=-1, keepdims=True)
    va, vb = (x * x).mean(axis=-1), (y * y).mean(axis=-1)
    fine = (np.sqrt(va) >= 1e-12) & (np.sqrt(vb) >= 1e-12)
    return np.where(fine, (x * y).mean(axis=-1) / np.sqrt(np.where(fine, va * vb, 1)), 0.0)


def slope(v: np.ndarray) -> np.ndarray:
    """Least-squares slope over places; 0 for fewer than two values."""
    t = np.arange(v.shape[1]) - (v.shape[1] - 1) / 2
    return (v - v.mean(axis=1, keepdims=True)) @ t / (t @ t) if len(t) > 1 else np.zeros(len(v))


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Period and share of the strongest frequency after removing a line; 0 for fewer than eight values, and without power."""
    n = v.shape[1]
    if n < 8:
        return np.zeros(len(v)), np.zeros(len(v))
    t = np.arange(n) - (n - 1) / 2
    power = np.abs(np.fft.rfft(v - v.mean(axis=1, keepdims=True) - slope(v)[:, None] * t)) ** 2
    power[:, 0] = 0
    total, k = power.sum(axis=1), power.argmax(axis=1)
    fine = total > 1e-12
    return np.where(fine, n / np.maximum(k, 1), 0.0), np.where(fine, power[np.arange(len(v)), k] / np.where(fine, total, 1), 0.0)


def outlier(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest deviation from the median over 1.4826 MAD (the standard deviation where that is under 1e-12), and where it first lies, from 0 to 1."""
    dev = np.abs(v - np.median(v, axis=1, keepdims=True))
    mad = np.median(dev, axis=1)
    scale = np.where(mad > 1e-12, 1.4826 * mad, np.maximum(v.std(axis=1), 1e-12))
    return dev.max(axis=1) / scale, dev.argmax(axis=1) / max(v.shape[1] - 1, 1)


def polynomial(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """R2 of a line and of a parabola, and the coefficient of t squared for standardised values, t from -1 to 1; NaN for constant rows."""
    t = np.linspace(-1, 1, v.shape[1])
    sd = v.std(axis=1)
    some = sd >= 1e-12
    r1, r2 = correlation(t[None], v) ** 2, correlation(t[None] ** 2, v) ** 2
    x = t * t - (t * t).mean()
    curve = (v - v.mean(axis=1, keepdims=True)) @ x / (x @ x) / np.where(some, sd, 1)
    return tuple(np.where(some, c, np.nan) for c in (r1, r1 + r2, curve))


def segments(v: np.ndarray, parts: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean, deviation and slope (over places) of near-equal parts, longer ones first."""
    return [(p.mean(axis=1), p.std(axis=1), slope(p)) for p in np.array_split(v, parts, axis=1)]
