"""Vector expressions over arrays, and centroids as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def mean_vectors(df: DataFrame, keys: list[str], vec: str, weight: str | None = None, out: str = "centroid") -> DataFrame:
    """Mean (or weighted mean) of the unit vectors of each key, scaled to length one.

    Vectors are summed dimension by dimension with partial sums before the shuffle, so a key with a third of all rows
    is a few rows a task.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = df.select(*keys, w.alias("_w"), F.posexplode(l2(F.col(vec))).alias("_i", "_x"))
    sums = long.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.count("*").alias("n"))
    full = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_v"), F.max("n").alias("n"))
    return full.select(*keys, "n", l2(F.transform("_v", lambda s: s["_s"])).alias(out))
