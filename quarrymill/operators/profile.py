"""Corpus profiles: one scan for all fields, exact quantiles, totals by ROLLUP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F


def describe(c: Column, prefix: str, places: int = 4) -> list[Column]:
    """Count, mean, median, deviation, range and quantiles of a number, nulls left out."""
    q = lambda p: F.round(F.percentile(c, F.lit(p)), places)
    return [
        F.count(c).alias(f"{prefix}_n"),
        F.round(F.avg(c), places).alias(f"{prefix}_mean"),
        q(0.5).alias(f"{prefix}_median"),
        F.round(F.stddev_samp(c), places).alias(f"{prefix}_std"),
        F.min(c).cast("double").alias(f"{prefix}_min"),
        q(0.05).alias(f"{prefix}_p05"),
        q(0.25).alias(f"{prefix}_p25"),
        q(0.75).alias(f"{prefix}_p75"),
        q(0.95).alias(f"{prefix}_p95"),
        F.max(c).cast("double").alias(f"{prefix}_max"),
    ]


def profile(df: DataFrame, by: str, aggs: list[Column], total: str = "ALL") -> DataFrame:
    """Aggregates of each group and of all rows, the latter named ``total``; a null group is ``(null)``."""
    keyed = df.withColumn("_g", F.coalesce(F.col(by).cast("string"), F.lit("(null)")))
    return keyed.rollup("_g").agg(F.grouping("_g").alias("_t"), *aggs).withColumn("_g", F.when(F.col("_t") == 1, total).otherwise(F.col("_g"))).withColumnRenamed("_g", by).drop("_t")


def null_rates(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Share of nulls of each field in each group, long form, from one scan."""
    rates = df.groupBy(by).agg(*[F.avg(F.col(f).isNull().cast("int")).alias(f) for f in fields])
    return rates.unpivot([by], fields, "field", "rate").withColumn("rate", F.round("rate", 6))


def shares(df: DataFrame, by: list[str], within: list[str] | None = None) -> DataFrame:
    """Count of each combination and its share of all rows, or of its ``within`` group."""
    w = Window.partitionBy(*(within or []))
    return df.groupBy(*by).agg(F.count("*").alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def top_n(df: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """The ``n`` most frequent items of each group, ties by the item."""
    counts = df.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def crosstab(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of ``values`` of ``col`` for each ``row``, with the row's total."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values], F.count("*").alias("total"))


def date_span(df: DataFrame, by: str, date: str) -> DataFrame:
    """First, middle and last date, and how many are missing."""
    d = F.unix_date(date)
    return df.groupBy(by).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.date_from_unix_date(F.floor(F.median(d)).cast("int")).alias("middle"), F.count_if(F.col(date).isNull()).alias("missing"))
