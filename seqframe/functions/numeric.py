"""Numeric column expressions (X13-X16, P7, A13/A14 per-row losses)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sigmoid(x) -> Column:
    """Logistic function."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def relu(x) -> Column:
    """max(x, 0)."""
    return F.greatest(_c(x), F.lit(0.0))


def tanh(x) -> Column:
    """X16."""
    return F.tanh(_c(x))


def sigmoid_score(a, b, threshold: float = 1.0) -> Column:
    """sigma(a - th) * sigma(b - th) - 1, a joint score of two measures."""
    t = F.lit(float(threshold))
    return sigmoid(_c(a) - t) * sigmoid(_c(b) - t) - F.lit(1.0)


def logsumexp(arr) -> Column:
    """Stable log(sum(exp(x))) over an array column, via higher-order functions."""
    a = _c(arr)
    m = F.array_max(a)
    s = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return m + F.log(s)


def cross_entropy(logits, label) -> Column:
    """A13 per row: -log softmax(logits)[label], label 0-based class index."""
    a = _c(logits)
    picked = F.try_element_at(a, (_c(label) + F.lit(1)).cast("int"))
    return logsumexp(a) - picked


def bce_with_logits(logits, targets) -> Column:
    """A14 per row: mean over labels of max(z,0) - z*y + log(1 + exp(-|z|))."""
    z = _c(logits)
    y = _c(targets)
    terms = F.zip_with(z, y, lambda zi, yi: F.greatest(zi, F.lit(0.0)) - zi * yi
                       + F.log1p(F.exp(-F.abs(zi))))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / F.size(terms)


def argmax_index(arr) -> Column:
    """0-based index of the (first) maximum of an array."""
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int")
