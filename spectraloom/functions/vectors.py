"""Similarity metrics of vectors: as column expressions and, for blocks, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Added to every denominator.
EPSILON = 1e-6


def _wide(v: Column) -> Column:
    return v.cast("array<double>")


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(_wide(a), _wide(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPSILON)


def plain_cosine(a: Column, b: Column) -> Column:
    """Cosine without the added constant; null for a vector of length zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def tanimoto(a: Column, b: Column) -> Column:
    d = dot(a, b)
    return d / (dot(a, a) + dot(b, b) - d + EPSILON)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint support, where a component is in the support if it is not 0."""
    both = F.zip_with(a, b, lambda x, y: F.when((x != 0) & (y != 0), 1.0).otherwise(0.0))
    either = F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))
    return _total(both) / (_total(either) + EPSILON)


def _centred(a: Column) -> Column:
    mean = _total(_wide(a)) / F.size(a)
    return F.transform(_wide(a), lambda x: x - mean)


def pearson(a: Column, b: Column) -> Column:
    x, y = _centred(a), _centred(b)
    return dot(x, y) / (F.sqrt(dot(x, x) * dot(y, y)) + EPSILON)


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.sqrt(_squares(a))[:, None] * np.sqrt(_squares(b))[None, :] + EPSILON)


def _plain_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return (a @ b.T) / (np.sqrt(_squares(a))[:, None] * np.sqrt(_squares(b))[None, :])


def _tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a @ b.T
    return d / (_squares(a)[:, None] + _squares(b)[None, :] - d + EPSILON)


def _jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = (a != 0).astype(np.float64), (b != 0).astype(np.float64)
    both = x @ y.T
    return both / (x.sum(1)[:, None] + y.sum(1)[None, :] - both + EPSILON)


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    return (x @ y.T) / (np.sqrt(_squares(x)[:, None] * _squares(y)[None, :]) + EPSILON)


@dataclass(frozen=True)
class VectorMetric:
    """``expr`` compares two array columns, ``block`` the rows of two matrices."""

    name: str
    expr: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


METRICS = {
    m.name: m
    for m in (
        VectorMetric("cosine", cosine, _cosine),
        VectorMetric("plain_cosine", plain_cosine, _plain_cosine),
        VectorMetric("dot", dot, lambda a, b: a @ b.T),
        VectorMetric("tanimoto", tanimoto, _tanimoto),
        VectorMetric("jaccard", jaccard, _jaccard),
        VectorMetric("pearson", pearson, _pearson),
    )
}


def metric(which: str | VectorMetric) -> VectorMetric:
    """A registered metric by name, or the caller's own."""
    if isinstance(which, VectorMetric):
        return which
    if which not in METRICS:
        raise ValueError(f"unknown metric {which!r}; known: {sorted(METRICS)}")
    return METRICS[which]
