"""Vector expressions over ARRAY<FLOAT>, in double precision, and the binary exchange format."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of a query a and a candidate b; 0 for a query of zeros, a candidate's zero norm counts as 1, null where lengths differ."""
    na, nb = norm(a), norm(b)
    value = F.when(na == 0, F.lit(0.0)).otherwise(dot(a, b) / (na * F.when(nb == 0, F.lit(1.0)).otherwise(nb)))
    return F.when(F.size(a) == F.size(b), value)


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def is_valid(a: Column) -> Column:
    """All components finite, not all zero."""
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (norm(a) > 0)


@F.pandas_udf(T.BinaryType())
def pack_vector(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpack_vector(raw: pd.Series, dim: pd.Series) -> pd.Series:
    """The vector of these bytes; a length that isn't 4 * dim raises ValueError."""

    def one(data, d):
        if data is None:
            return None
        if len(data) != 4 * d:
            raise ValueError(f"{len(data)} bytes for {d} components")
        return np.frombuffer(data, "<f4")

    return pd.Series([one(x, d) for x, d in zip(raw, dim)])
