"""Arithmetic on embedding columns, in double precision, and their codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def is_valid(v: Column, dimensions: int) -> Column:
    """Right number of finite values, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite & (dot(v, v) > 0), F.lit(False))


def literal(vector: Column) -> Column:
    """A vector as text: numbers in brackets, whole ones without a fraction."""
    shown = F.transform(vector, lambda x: F.regexp_replace(x.cast("float").cast("string"), r"\.0$", ""))
    return F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))


def from_literal(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def to_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def made(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return made(vector)


def from_bytes(blob: Column) -> Column:
    @F.pandas_udf("array<float>")
    def made(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return made(blob)
