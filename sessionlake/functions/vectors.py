"""Vector expressions: cosine similarity, norms, means, half precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity: 1 for two zero vectors, 0 for one; null for null or unequal lengths."""
    na, nb = norm(a), norm(b)
    value = F.when((na == 0) & (nb == 0), F.lit(1.0)).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))
    return F.when(F.size(a) == F.size(b), value)


def is_usable(v: Column, dimensions: int) -> Column:
    """Whether a vector is there, of the right length, finite and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(3.4028235e38)))
    return F.coalesce((F.size(v) == dimensions) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def query_vector(values: list[float], dimensions: int) -> list[float]:
    """A query's vector, checked: right length, finite, within half precision, not zero."""
    v = np.asarray(values, dtype=np.float64)
    if v.shape != (dimensions,):
        raise ValueError(f"a query vector needs {dimensions} numbers, got {v.size}")
    if not np.isfinite(v).all() or np.abs(v).max() > 65504:
        raise ValueError("a query vector must be finite and within half precision")
    if not v.any():
        raise ValueError("a query vector must not be zero")
    return half_precision(v).tolist()


def half_precision(values: np.ndarray) -> np.ndarray:
    """Numbers rounded to half precision, halves away from zero, too large ones infinite."""
    v = np.asarray(values, dtype=np.float64)
    size = np.abs(v)
    with np.errstate(divide="ignore"):
        exponent = np.where(size > 0, np.floor(np.log2(np.where(size > 0, size, 1.0))), -14.0)
    step = np.exp2(np.maximum(exponent, -14.0) - 10.0)
    rounded = np.floor(size / step + 0.5) * step
    return np.copysign(np.where(rounded > 65504.0, np.inf, rounded), v)


def to_half(v: Column) -> Column:
    """A vector column rounded to half precision, kept as floats."""

    @F.pandas_udf("array<float>")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else half_precision(np.asarray(x)).astype(np.float32))

    return rounded(v)


def mean_vector(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """``keys, vector, n_vectors``: the mean by position of each group's vectors; null ones do not count.

    Positions are averaged before they are gathered, so a group sends one partial sum for each position.
    """
    by_position = df.select(*keys, F.posexplode(vector).alias("_p", "_x")).groupBy(*keys, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count("*").alias("_n"))
    gathered = by_position.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", "_m"))).alias("_all"), F.max("_n").alias("n_vectors"))
    return gathered.select(*keys, F.transform("_all", lambda x: x["_m"]).alias("vector"), "n_vectors")
