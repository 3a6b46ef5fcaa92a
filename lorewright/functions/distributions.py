"""Vectors and distributions as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x / by)


def dot(a: Column, b: Column, scale: float = 1.0) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) * scale


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    return scaled(v.cast("array<double>"), norm(v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine with not-a-number as 0 and everything from 1 up as 0.999."""
    c = F.nanvl(F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    return F.when(c >= 1, 0.999).otherwise(c)


def _rel(p: Column, q: Column) -> Column:
    return F.when(p == 0, F.lit(0.0)).otherwise(p * F.ln(p / q))


def kl(p: Column, q: Column) -> Column:
    """Divergence of p from q, both made to sum to 1, base e."""
    return total(F.zip_with(scaled(p, total(p)), scaled(q, total(q)), _rel))


def jensen_shannon(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Half the sum of the divergences from the midpoint; sums get eps added, zeros become eps."""
    a, b = scaled(p, total(p) + eps), scaled(q, total(q) + eps)
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    up = lambda v: F.transform(v, lambda x: F.when(x == 0, F.lit(eps)).otherwise(x))
    a, b, m = up(a), up(b), up(m)
    return (total(F.zip_with(a, m, _rel)) + total(F.zip_with(b, m, _rel))) / 2


def jensen_shannon_distance(p: Column, q: Column) -> Column:
    """Root of the divergence between the normalized distributions."""
    a, b = scaled(p, total(p)), scaled(q, total(q))
    m = F.zip_with(a, b, lambda x, y: (x + y) / 2)
    return F.sqrt(F.greatest((total(F.zip_with(a, m, _rel)) + total(F.zip_with(b, m, _rel))) / 2, F.lit(0.0)))


def kl_elementwise(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """Sum of p ln(p / q) - p + q after eps is added to both; the inputs stay as they are."""
    return total(F.zip_with(p, q, lambda x, y: (x + eps) * F.ln((x + eps) / (y + eps)) - (x + eps) + (y + eps)))


def softmax(v: Column, alpha: float = 1.0) -> Column:
    if alpha <= 0:
        raise ValueError("alpha must be above 0")
    e = F.transform(v, lambda x: F.exp(x * alpha))
    return scaled(e, total(e))


def positional_difference(a: Column, b: Column) -> Column:
    """Differing characters, place by place, and the gap in length. Not an edit distance."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(at, lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))) + F.abs(F.length(a) - F.length(b))


def perplexity(mean_loss: Column) -> Column:
    return F.exp(mean_loss)
