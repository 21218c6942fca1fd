"""Repeatable samples by hashes, strata and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, *cols: Column) -> Column:
    """SHA-256 of seed and values: an order that any engine repeats."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *cols), 256)


def hash_sample(df: DataFrame, id_col: str, n: int, seed: str) -> DataFrame:
    return df.withColumn("hash_order", hash_order(seed, F.col(id_col).cast("string"))).orderBy("hash_order", id_col).limit(n)


def tercile(df: DataFrame, by: str, value: str, ties: str, out: str = "tercile") -> DataFrame:
    """short, medium or long by the rank of ``value`` among its group, edges as linear quantiles of the ranks."""
    d = df.where(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(by))
    r = F.row_number().over(Window.partitionBy(by).orderBy(value, ties))
    return d.withColumn(out, F.when(3 * (r - 1) < n - 1, "short").when(3 * (r - 1) < 2 * (n - 1), "medium").otherwise("long"))


def round_robin(df: DataFrame, source: str, strata: list[str], title: str, id_col: str, per_source: int, seed: str) -> DataFrame:
    """``per_source`` rows of each source, taken in turn from its strata in hash order, each title once.

    A title's first row in hash order stands for it; strata are visited in the order of their hashes and each gives
    one row a turn. Titles are settled by one aggregate and turns by row numbers, so no source is gathered whole.
    """
    h = hash_order(seed, F.col(id_col).cast("string"))
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in strata])
    rows = df.select("*", h.alias("_h"), stratum.alias("stratum")).where(F.col(id_col).isNotNull())
    first = rows.groupBy(source, title).agg(F.min(F.struct("_h", id_col)).alias("_f"))
    only = rows.join(first, [source, title]).where((F.col("_f._h") == F.col("_h")) & (F.col("_f")[id_col] == F.col(id_col))).dropDuplicates([source, id_col])
    turn = F.row_number().over(Window.partitionBy(source, "stratum").orderBy("_h", id_col))
    order = Window.partitionBy(source).orderBy("turn", F.sha2(F.concat_ws("|", F.lit(seed), "stratum"), 256), "stratum")
    return only.withColumn("turn", turn).where(F.col("turn") <= per_source).withColumn("sample_rank", F.row_number().over(order)).where(F.col("sample_rank") <= per_source).drop("_h", "_f")


def coverage_first(df: DataFrame, source: str, group: str, id_col: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each source: the first of every group in hash order, then the others in hash order."""
    h = hash_order(seed, F.col(id_col).cast("string"))
    first = F.row_number().over(Window.partitionBy(source, group).orderBy(h, id_col)) == 1
    d = df.withColumn("is_first", first)
    w = Window.partitionBy(source).orderBy(F.desc("is_first"), h, id_col)
    return d.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def quota_sample(df: DataFrame, categories: list[tuple[str, Column, int]], id_col: str, seed: str) -> DataFrame:
    """Rows for review: each row counts for the first category it fits, and each category gives its quota."""
    name = F
    for n, c, _ in categories:
        name = name.when(c, F.lit(n))
    quota = F
    for n, _, q in categories:
        quota = quota.when(F.col("category") == n, F.lit(q))
    d = df.withColumn("category", name.otherwise(None)).where("category is not null")
    w = Window.partitionBy("category").orderBy(hash_order(seed, F.col(id_col).cast("string")), id_col)
    return d.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= quota.otherwise(F.lit(0)))


def bootstrap(per_key: DataFrame, key: str, sums: list[str], replicates: int, seed: int = 1) -> DataFrame:
    """Sums of each replicate: keys drawn with replacement by Poisson(1) weights from hashes of (replicate, key).

    Input is one row a key; replicates are summed before the shuffle, so the result has ``replicates`` rows.
    """
    reps = per_key.select(key, *sums, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "replicate", key), F.lit(1 << 30)) + 0.5) / (1 << 30)
    cum, p, weight = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(8):
        cum += p
        weight = weight + (u > cum).cast("int")
        p /= k + 1
    return reps.withColumn("_w", weight).groupBy("replicate").agg(*[F.sum(F.col("_w") * F.col(s)).alias(s) for s in sums])


def percentile_bounds(boot: DataFrame, value: Column, name: str) -> DataFrame:
    return boot.agg(F.round(F.percentile(value, F.lit(0.025)), 6).alias(f"{name}_low"), F.round(F.percentile(value, F.lit(0.975)), 6).alias(f"{name}_high"))
