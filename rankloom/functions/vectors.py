"""Similarity of array columns with a constant vector, and base64 forms of vectors. Higher scores are better."""

from __future__ import annotations

import base64
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine_distance", "euclidean_squared")


def constant(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(column: Column, query: Sequence[float]) -> Column:
    """Cosine similarity in doubles; 0 for other lengths, empty vectors and zero norms; null for null."""
    v, q = column.cast("array<double>"), [float(x) for x in query]
    norm = float(np.sqrt(sum(x * x for x in q)))
    if not q or norm == 0:
        return F.when(column.isNotNull(), 0.0)
    own = F.sqrt(dot(v, v))
    return F.when(column.isNull(), None).when((F.size(v) != len(q)) | (own == 0), 0.0).otherwise(dot(v, constant(q)) / (own * norm))


def negated_l2(column: Column, query: Sequence[float]) -> Column:
    """Minus the squared Euclidean distance; minus infinity for other lengths; null for null."""
    v = column.cast("array<double>")
    d = _sum(F.zip_with(v, constant(query), lambda x, y: (x - y) * (x - y)))
    return F.when(column.isNull(), None).when(F.size(v) != len(query), float("-inf")).otherwise(-d + 0.0)


def similarity(column: Column, query: Sequence[float], metric: str) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric: {metric}")
    return cosine(column, query) if metric == METRICS[0] else negated_l2(column, query)


def scores32(matrix: np.ndarray, query: np.ndarray, metric: str) -> np.ndarray:
    """The same in single precision, row by row, for half-precision columns."""
    m, q = matrix.astype(np.float32), query.astype(np.float32)
    if metric == METRICS[1]:
        return -((m - q) ** 2).sum(axis=1)
    norms = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    return np.divide(m @ q, norms, out=np.zeros(len(m), np.float32), where=norms > 0)


def half(column: Column) -> Column:
    """Each entry rounded to half precision and widened again, as a half-precision column stores it."""

    @F.pandas_udf("array<float>")
    def rounded(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, np.float16).astype(np.float32))

    return rounded(column.cast("array<float>"))


def _dtype(bits: int) -> str:
    if bits not in (16, 32):
        raise ValueError("vectors have 16 or 32 bits an entry")
    return "<f4" if bits == 32 else "<f2"


def encode(vector: Sequence[float], bits: int = 32) -> str:
    return base64.b64encode(np.asarray(vector, _dtype(bits)).tobytes()).decode()


def decode(text: str, bits: int = 32) -> list[float]:
    raw = base64.b64decode(text, validate=True)
    if not raw or len(raw) % (bits // 8):
        raise ValueError(f"{len(raw)} bytes are no vector of {bits}-bit floats")
    return np.frombuffer(raw, _dtype(bits)).astype(float).tolist()


def encoded(column: Column, bits: int = 32) -> Column:
    """Little-endian floats in base64."""
    kind = _dtype(bits)

    @F.pandas_udf("binary")
    def raw(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.asarray(x, kind).tobytes())

    return F.translate(F.base64(raw(column.cast("array<float>"))), "\r\n", "")


def decoded(column: Column, bits: int = 32) -> Column:
    kind = _dtype(bits)

    @F.pandas_udf("array<float>")
    def floats(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(x, kind).astype(np.float32))

    return floats(F.unbase64(column))
