"""Corrections of a reference forecast towards its candidates, as column formulas over arrays (nine deciles; candidates by model)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOTS, CORE = 8, 8


def lower_median(v: Column) -> Column:
    """The middle value, of two the lower."""
    return F.element_at(F.array_sort(v), ((F.size(v) + 1) / 2).cast("int"))


def clipped(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def floor_of(median: Column) -> Column:
    return F.greatest(F.abs(median) * 1e-4, F.lit(1e-3))


def disagreement(reference: Column, candidates: Column) -> Column:
    """Median distance of the candidates' medians (each candidate sorted first) from the reference's."""
    return lower_median(F.transform(candidates, lambda q: F.abs(F.array_sort(q)[4] - reference[4])))


def step_scale(reference: Column, candidates: Column) -> Column:
    """The larger of the candidates' disagreement, the reference's median spacing of deciles, and a floor."""
    spacing = lower_median(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.greatest(F.get(reference, k + 1) - F.get(reference, k), F.lit(0.0))))
    return F.greatest(disagreement(reference, candidates), spacing, floor_of(reference[4]))


def descriptor(reference: Column, candidates: Column, step: Column, horizon: Column, scale: Column) -> Column:
    """The values that describe a step (53 for thirteen candidates), each within 20: offsets of the reference's deciles and of the
    candidates' medians, widths and asymmetries in units of the scale, the position (0 to 1), its sine and cosine, ln(horizon), ln(1 + scale)."""
    s = F.greatest(scale, F.lit(1e-6))
    mid = reference[4]
    sorted_ = F.transform(candidates, lambda q: F.array_sort(q))
    of = lambda f: F.transform(sorted_, lambda q: f(q) / s)
    at = F.when(horizon > 1, (step - 1) / F.greatest(horizon - 1, F.lit(1))).otherwise(0.0)
    place = F.array(at, F.sin(2 * math.pi * at), F.cos(2 * math.pi * at), F.log(F.greatest(horizon, F.lit(1)).cast("double")))
    parts = F.concat(F.transform(reference, lambda q: (q - mid) / s), of(lambda q: q[4] - mid), of(lambda q: q[8] - q[0]), of(lambda q: q[8] + q[0] - 2 * q[4]), place, F.array(F.least(F.log1p(s), F.lit(90.0))))
    return F.transform(parts, lambda x: clipped(x, 20.0))


def mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)


def deviation(v: Column) -> Column:
    m = mean(v)
    return F.sqrt(F.greatest(mean(F.transform(v, lambda x: (x - m) * (x - m))), F.lit(0.0)))


def offset_summary(reference: Column, candidates: Column, scale: Column, level: int) -> Column:
    """(core_mean, core_sd, all_mean, all_sd) of the candidates' offsets at a level, the core being the first eight."""
    s = F.greatest(scale, F.lit(1e-6))
    offsets = F.transform(candidates, lambda q: clipped((F.array_sort(q)[level] - reference[level]) / s, 20.0))
    core = F.slice(offsets, 1, CORE)
    return F.struct(mean(core).alias("core_mean"), deviation(core).alias("core_sd"), mean(offsets).alias("all_mean"), deviation(offsets).alias("all_sd"))


def resampled(knots: Column, horizon: Column) -> Column:
    """An array at `horizon` even places between its ends, on the lines between its values."""
    n = F.size(knots)

    def one(i):
        at = F.when(horizon > 1, i * (n - 1) / F.greatest(horizon - 1, F.lit(1)).cast("double")).otherwise(0.0)
        low = F.least(F.floor(at).cast("int"), n - 1)
        a, b = F.get(knots, low), F.get(knots, F.least(low + 1, n - 1))
        return a + (b - a) * (at - low)

    return F.transform(F.sequence(F.lit(0), (horizon - 1).cast("int")), one)


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    e = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def correction(head: Column, reference: Column, candidates: Column, scale: Column) -> Column:
    """Within a half: from a head of one value and a weight for each candidate, towards the weighted mean of their medians."""
    s = F.greatest(scale, F.lit(1e-6))
    weights = softmax(F.slice(head, F.lit(2), F.size(head) - 1))
    target = F.aggregate(F.zip_with(weights, candidates, lambda w, q: w * F.array_sort(q)[4]), F.lit(0.0), lambda a, x: a + x)
    return 0.5 * F.tanh(head[0]) * F.tanh((target - reference[4]) / s)


def gate(reference: Column, candidates: Column) -> Column:
    """The share of a correction that is kept: less where candidates disagree beside the reference's own spread."""
    wide = F.greatest(F.greatest(reference[6] - reference[2], F.lit(0.0)), floor_of(reference[4]))
    d = disagreement(reference, candidates)
    return wide * wide / (wide * wide + d * d)


def shifted(reference: Column, by: Column) -> Column:
    return F.transform(reference, lambda q: q + by)


def correction_loss(rows, keys: list[str], beta: float = 0.05, edit: float = 0.2):
    """keys, loss: from (correction, y, median, scale, weight), a row a knot: smooth error to the clipped target, and the edit's square."""
    target = clipped((F.col("y") - F.col("median")) / F.col("scale"), 0.5)
    d = F.abs(F.col("correction") - target)
    fit = F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)
    total = F.greatest(F.sum("weight"), F.lit(1e-12))
    return rows.groupBy(*keys).agg(((F.sum(fit * F.col("weight")) + edit * F.sum(F.col("correction") * F.col("correction") * F.col("weight"))) / total).alias("loss"))
