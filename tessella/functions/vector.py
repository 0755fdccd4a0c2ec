"""Column functions over ARRAY<DOUBLE> vectors; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def as_double(v: Column | str) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def scaled(v: Column, by: Column) -> Column:
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, b: x * b)


def l2_normalize(v: Column, eps: float = EPS) -> Column:
    """x / max(|x|, eps).  The vector is bound once and its norm taken once, not once for each element."""
    unit = lambda w: F.zip_with(w, F.array_repeat(F.greatest(norm(w), F.lit(eps)), F.size(w)), lambda x, n: x / n)
    return F.transform(F.array(v), unit)[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(EPS)) * F.greatest(norm(b), F.lit(EPS)))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def residual(x: Column, center: Column) -> Column:
    return F.zip_with(x, center, lambda a, b: a - b)


def weighted_concat(a: Column, b: Column, weight: float) -> Column:
    """concat(a, weight * b), L2-normalised."""
    return l2_normalize(F.concat(a, F.transform(b, lambda x: x * weight)))


def renormalize(v: Column, mean: float, std: float, new_mean: float, new_std: float) -> Column:
    """Undoes (mean, std) and applies another pair."""
    return F.transform(v, lambda x: (x * std + mean - new_mean) / new_std)


def fourier(value: Column, frequencies: int) -> Column:
    """[sin, cos] of value * 2**f * pi for each f, in that order."""
    steps = F.sequence(F.lit(0), F.lit(frequencies - 1))
    angle = lambda f: value * F.pow(F.lit(2.0), f.cast("double")) * math.pi
    return F.flatten(F.transform(steps, lambda f: F.array(F.sin(angle(f)), F.cos(angle(f)))))


def centroid_fourier(x: Column, y: Column, frequencies: int) -> Column:
    """Per frequency: sin x, cos x, sin y, cos y."""
    steps = F.sequence(F.lit(0), F.lit(frequencies - 1))
    w = lambda f: F.pow(F.lit(2.0), f.cast("double")) * math.pi
    return F.flatten(F.transform(steps, lambda f: F.array(F.sin(x * w(f)), F.cos(x * w(f)), F.sin(y * w(f)), F.cos(y * w(f)))))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def r6(c: Column) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)
