"""Keep-first selection, duplicate flags and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order; null keys form one group each."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def flag_duplicates(df: DataFrame, key: Column, order: list[Column], id_col: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>_key``, ``<prefix>_group`` (the id of the key's first row) and ``is_<prefix>_duplicate``.

    Only the leader of each key travels back to the rows, as one row a key; rows of an empty or null key are no
    duplicates. A key with a third of all rows is aggregated before the shuffle.
    """
    keyed = df.withColumn(f"{prefix}_key", key)
    rank = F.struct(*[F.struct(o.isNull(), o) for o in order], F.col(id_col))
    leaders = keyed.where(F.length(f"{prefix}_key") > 0).groupBy(f"{prefix}_key").agg(F.min(rank).alias("_lead"))
    lead = leaders.select(f"{prefix}_key", "_lead", F.col(f"_lead.{id_col}").alias(f"{prefix}_group"))
    out = keyed.join(lead, f"{prefix}_key", "left")
    return out.withColumn(f"is_{prefix}_duplicate", F.coalesce(rank > F.col("_lead"), F.lit(False))).drop("_lead")


def changed(old: DataFrame, new: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Full outer comparison of two versions by key: status added, removed, changed or same; nulls equal nulls."""
    o, n = old.select(F.col(key), *[F.col(c).alias(f"_o_{c}") for c in cols], F.lit(True).alias("_o")), new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in cols], F.lit(True).alias("_n"))
    same = F.lit(True)
    for c in cols:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_n_{c}"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(same, "same").otherwise("changed")
    return o.join(n, key, "full").select(key, status.alias("status"))


def upsert(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of ``fresh`` in place of those with their keys."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def assert_keys(df: DataFrame, keys: list[str], required: list[str] = ()) -> DataFrame:
    """``df`` itself; fails as it is read if a key repeats or a required column is null."""
    w = Window.partitionBy(*keys)
    bad = F.count("*").over(w) > 1
    for c in required:
        bad = bad | F.col(c).isNull()
    return df.withColumn("_bad", bad).where(F.assert_true(~F.col("_bad"), F.lit("repeated key or missing value")).isNull()).drop("_bad")
