"""Vector functions on array columns, in double precision."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_d(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike length, empty ones, nulls and zero vectors."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def cosine_shared(a: Column, b: Column) -> Column:
    """cosine() of the leading components that both have."""
    n = F.least(F.size(a), F.size(b))
    return cosine(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n))


def normalize(v: Column) -> Column:
    """Unit length; zeros for a zero vector or one of no finite length."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n), F.transform(_d(v), lambda x: x / n)).otherwise(F.transform(_d(v), lambda x: F.lit(0.0)))


def score_from_l2(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance * distance / 2)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def parse(json: Column) -> Column:
    """array<double> of a JSON array; null if it is none or holds a null or non-finite component."""
    v = F.from_json(json, "array<double>")
    return F.when(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), v)


def literal(v: Column) -> Column:
    """[a,b,...] with eight decimals, rounded from the exact value with ties to even, as C's printf does (format_string takes ties up); nulls are left out."""

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda x: None if x is None else "[" + ",".join(["%.8f" % c for c in x.tolist()]) + "]")

    return run(F.filter(_d(v), lambda x: x.isNotNull()))


def preview(v: Column, n: int = 8) -> Column:
    return F.struct(F.size(v).alias("dimension"), F.slice(v, 1, n).alias("head"))
