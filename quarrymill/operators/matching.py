"""Matching of statements: greedy one-to-one, set similarity, overlapping spans, nearest by groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.operators.components import connected_components
from quarrymill.runtime import Workspace


#: Candidates of one task of the greedy choice, in whole connected sets.
SETS_OF_ROWS = 20_000


def greedy_pairs(cands: DataFrame, group: list[str], left: str, right: str, order: list[str], ws: Workspace | None = None) -> DataFrame:
    """One-to-one pairs: candidates in ``order`` (all descending by value), each taken if both its ends are free.

    The choice in one connected set of candidates never touches another, so each set is one task's group instead of
    each key, and sets stay small however many rows a key has. Ties fall to the smaller ends.
    """
    ws = ws or Workspace(cands.sparkSession, "greedy")
    c = ws.cut(cands.where(F.col(left).isNotNull() & F.col(right).isNotNull()).withColumn("_l", F.concat_ws("\x1f", F.lit("l"), *group, left)).withColumn("_r", F.concat_ws("\x1f", F.lit("r"), *group, right)), "candidates")
    comp = connected_components(c.select(F.col("_l").alias("a"), F.col("_r").alias("b")), ws=ws)
    placed = c.join(comp.toDF("_l", "_c"), "_l")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*order, left, right], ascending=[False] * len(order) + [True, True], kind="stable")
        used_l, used_r, keep = set(), set(), []
        for a, b in zip(pdf["_l"], pdf["_r"]):
            ok = a not in used_l and b not in used_r
            keep.append(ok)
            if ok:
                used_l.add(a)
                used_r.add(b)
        return pdf.loc[keep].drop(columns=["_l", "_r", "_c"])

    # sets never touch each other, so a bucket of whole sets gives the same pairs in one group instead of many
    buckets = max(1, -(-c.count() // SETS_OF_ROWS))
    return placed.groupBy(F.pmod(F.xxhash64("_c"), F.lit(buckets)).alias("_b")).applyInPandas(choose, cands.schema)


def near_sets(df: DataFrame, group: str, id_col: str, tokens: Column, least: float, ws: Workspace | None = None) -> DataFrame:
    """``(group, id, class_id, n_links)``: rows of one group whose token sets have a Jaccard similarity of ``least``.

    Rows with the same set are one class, named by its smallest id; ``n_links`` counts the other classes it is similar
    to. Classes meet only by the first tokens that a similar set must share (a prefix in the order of rising
    frequency) and only if their sizes allow it. Rows with an empty set have class null and no links.
    """
    ws = ws or Workspace(df.sparkSession, "near-sets")
    rows = df.where(F.col(group).isNotNull() & F.col(id_col).isNotNull()).select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tokens)).alias("t"))
    classes = ws.cut(rows.where(F.size("t") > 0).groupBy("g", "t").agg(F.min("id").alias("class_id")).withColumn("n", F.size("t")), "classes")
    freq = classes.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("f"))
    ranked = classes.select("g", "class_id", "n", F.explode("t").alias("w")).join(freq, "w").groupBy("g", "class_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda s: s["w"]).alias("o"))
    keys = ranked.withColumn("p", F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int")))
    k = ws.cut(keys.select("g", "class_id", "n", F.explode("p").alias("w")), "keys")
    a, b = k.toDF("g", "a", "na", "w"), k.toDF("g", "b", "nb", "w")
    met = a.join(b, ["g", "w"]).where((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("g", "a", "b").distinct()
    c = classes.select("g", "class_id", "t")
    common = F.size(F.array_intersect("ta", "tb"))
    good = met.join(c.toDF("g", "a", "ta"), ["g", "a"]).join(c.toDF("g", "b", "tb"), ["g", "b"]).where(common >= least * (F.size("ta") + F.size("tb") - common) - 1e-9).select("g", "a", "b")
    links = good.select("g", F.explode(F.array("a", "b")).alias("class_id")).groupBy("g", "class_id").agg(F.count("*").alias("n_links"))
    named = rows.join(classes.select("g", "t", "class_id"), ["g", "t"], "left").join(links, ["g", "class_id"], "left")
    return named.select(F.col("g").alias(group), F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_counts(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``n_overlaps``: how many other spans of its key each half-open span overlaps.

    Counted from two running totals (spans begun before its end, spans over by its start) instead of pairs, so a key
    with a third of all rows costs a sort. Rows with a null or empty span overlap nothing.
    """
    ok = F.col(end) > F.col(start)
    spans = df.where(ok)
    starts = spans.groupBy(*keys, F.col(start).alias("p")).agg(F.count("*").alias("s"), F.lit(0).cast("long").alias("e"))
    ends = spans.groupBy(*keys, F.col(end).alias("p")).agg(F.lit(0).cast("long").alias("s"), F.count("*").alias("e"))
    at = starts.unionByName(ends).groupBy(*keys, "p").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    run = Window.partitionBy(*keys).orderBy("p")
    total = at.withColumn("begun", F.sum("s").over(run) - F.col("s")).withColumn("over", F.sum("e").over(run))
    left, right = total.select(*keys, F.col("p").alias(end), "begun"), total.select(*keys, F.col("p").alias(start), "over")
    got = spans.join(left, [*keys, end]).join(right, [*keys, start]).withColumn("n_overlaps", F.col("begun") - F.col("over") - 1).drop("begun", "over")
    return got.unionByName(df.where(~F.coalesce(ok, F.lit(False))).withColumn("n_overlaps", F.lit(0).cast("long")))


def spans_inside(df: DataFrame, keys: list[str], side: str, start: str, end: str, step: int = 256) -> DataFrame:
    """``(keys, side, inside_side, start, end, n)``: for each distinct span the distinct spans of another side that lie
    within it, counted.

    Equal spans of a side count once, so a key with a third of all rows keeps as many spans as its text has. Spans meet
    in steps of ``step`` places: one that lies within another begins in a step the other touches. Null and empty
    spans take no part.
    """
    d = df.where(F.col(end) > F.col(start)).select(*keys, side, F.col(start).alias("_s"), F.col(end).alias("_e")).where(F.col(side).isNotNull()).distinct()
    at = lambda c: F.floor(F.col(c) / step).cast("long")
    outer = d.withColumn("_at", F.explode(F.sequence(at("_s"), at("_e"))))
    inner = d.select(*keys, F.col(side).alias("inside_side"), F.col("_s").alias("_t"), F.col("_e").alias("_u"), at("_s").alias("_at"))
    met = outer.join(inner, [*keys, "_at"]).where((F.col(side) != F.col("inside_side")) & (F.col("_t") >= F.col("_s")) & (F.col("_u") <= F.col("_e")))
    return met.groupBy(*keys, side, "inside_side", F.col("_s").alias(start), F.col("_e").alias(end)).agg(F.count("*").alias("n"))


def reconcile(expected: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """Ids that are missing, repeated or foreign among the answers."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(True))
    a = answered.groupBy(key).agg(F.count("*").alias("answers"))
    status = F.when(F.col("answers").isNull(), "missing").when(F.col("_e").isNull(), "foreign").when(F.col("answers") > 1, "repeated").otherwise("ok")
    return e.join(a, key, "full").select(key, status.alias("status"), F.coalesce("answers", F.lit(0)).alias("answers"))


def allowed_only(chosen: Column, allowed: Column) -> Column:
    """Choices that are in the list, in their order and once each."""
    return F.array_distinct(F.filter(chosen, lambda x: F.array_contains(allowed, x)))
