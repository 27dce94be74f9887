"""Cosine as a Column (the form tests check against) and as numpy blocks (the form jobs run)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + F.coalesce(p, F.lit(0.0)))

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def is_finite(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    """Stack equal-length vectors and scale each to length one; a zero vector stays zero."""
    vectors = list(vectors)
    m = np.concatenate(vectors).astype(np.float64).reshape(len(vectors), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
