"""Evaluation of statements and labels: scores of pairs of producers, ordered rules, bins, ranks, baselines, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions.vectors import dot, l2


def first_failure(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null rule does not hold."""
    out = F
    for name, c in rules:
        out = out.when(c, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def pair_scores(df: DataFrame, group: str, producer: str, item: str) -> DataFrame:
    """``(a, b, groups, matched, precision_, recall, f1, macro_precision, macro_recall)`` of each two producers, a < b.

    Items match if they are equal within a group; ``b`` is held against ``a``. Micro scores are of the sums, macro
    scores the means over groups, where a producer without items in a group has none. Null values take no part.
    """
    d = df.where(F.col(group).isNotNull() & F.col(producer).isNotNull() & F.col(item).isNotNull()).select(F.col(group).alias("g"), F.col(producer).alias("p"), F.col(item).alias("t")).distinct()
    n = d.groupBy("g", "p").agg(F.count("*").alias("n"))
    each = n.select("p").distinct()
    pairs = each.toDF("a").join(each.toDF("b"), F.col("a") < F.col("b"))
    left = n.join(pairs.withColumn("p", F.col("a")), "p").select("a", "b", "g", F.col("n").alias("na"), F.lit(None).cast("long").alias("nb"))
    right = n.join(pairs.withColumn("p", F.col("b")), "p").select("a", "b", "g", F.lit(None).cast("long").alias("na"), F.col("n").alias("nb"))
    sizes = left.union(right).groupBy("a", "b", "g").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))
    # an item of a group is held by few producers: they are listed by one aggregate
    held = d.groupBy("g", "t").agg(F.array_sort(F.collect_set("p")).alias("ps")).where(F.size("ps") > 1)
    both = held.select("g", F.explode("ps").alias("a"), "ps").select("g", "a", F.explode("ps").alias("b")).where("a < b").groupBy("a", "b", "g").agg(F.count("*").alias("tp"))
    full = sizes.join(both, ["a", "b", "g"], "left").withColumn("tp", F.coalesce("tp", F.lit(0)))
    out = full.groupBy("a", "b").agg(F.count("*").alias("groups"), F.sum("tp").alias("matched"), F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.avg(F.try_divide(F.col("tp").cast("double"), F.col("nb").cast("double"))).alias("mp"), F.avg(F.try_divide(F.col("tp").cast("double"), F.col("na").cast("double"))).alias("mr"))
    p, r = S.precision(F.col("matched"), F.col("nb")), S.precision(F.col("matched"), F.col("na"))
    return out.select("a", "b", "groups", "matched", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall"), F.round(S.f1(p, r), 6).alias("f1"), F.round("mp", 6).alias("macro_precision"), F.round("mr", 6).alias("macro_recall"))


def quantile_bins(df: DataFrame, value: str, n: int, out: str = "bin") -> DataFrame:
    """``df`` with equal-frequency bins 1..n of a value, closed to the right; equal edges leave bins empty, nulls none."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("_e"))
    over = F.size(F.filter("_e", lambda e: F.col(value) > e))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(F.col(value).isNotNull(), over + 1)).drop("_e")


def global_rank(df: DataFrame, key: Column, ties: str, out: str = "rank") -> DataFrame:
    """``df`` with its place from 1 in the order of ``key`` (a hex digest) and ``ties``, without ordering all rows in one
    task: places before each of 4,096 buckets of the digest, and places within it."""
    d = df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, 3))
    before = d.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_b").orderBy("_k", ties))
    return d.join(F.broadcast(before), "_b").withColumn(out, F.col("_before") + within).drop("_b", "_k", "_before")


def permuted_labels(df: DataFrame, id_col: str, label: str, seed: str) -> DataFrame:
    """``(id, label)`` with the labels dealt anew in the order of the ids' hashes; sizes of labels stay."""
    d = df.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(id_col, label)
    to = global_rank(d.select(id_col), F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256), id_col)
    sizes = d.groupBy(label).agg(F.count("*").alias("_n"))
    # one row a label: labels hold consecutive places
    first = sizes.withColumn("_first", F.sum("_n").over(Window.orderBy(label)) - F.col("_n"))
    of = d.join(first, label).select(label, (F.col("_first") + F.row_number().over(Window.partitionBy(label).orderBy(id_col))).alias("rank"))
    return to.join(of, "rank").select(id_col, label)


def leave_one_out(df: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """``(id, label, own_sim, other_label, other_sim)``: the cosine of each row to its label's centroid made without it
    (null for a label's only row), and to the nearest other label's centroid, ties by label.

    Centroids come from sums of unit vectors: of the row v and its label's sum s, v.(s - v) is v.s - 1 and |s - v|^2 is
    |s|^2 - 2 v.s + 1, so nothing is summed anew.
    """
    d = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(id_col, F.col(label).alias("label"), l2(F.col(vec)).alias("v"))
    sums = d.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"))
    cents = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda t: t["x"]).alias("s")).withColumn("ss", dot(F.col("s"), F.col("s")))
    met = d.crossJoin(F.broadcast(cents.withColumnRenamed("label", "other"))).withColumn("d", dot(F.col("v"), F.col("s")))
    own = F.when(F.col("label") == F.col("other"), F.when(F.col("ss") - 2 * F.col("d") + 1 > 1e-9, (F.col("d") - 1) / F.sqrt(F.col("ss") - 2 * F.col("d") + 1)))
    far = F.when(F.col("label") != F.col("other"), F.struct(F.round(F.col("d") / F.sqrt("ss"), 6).alias("sim"), F.negate("other").alias("n"), F.col("other").alias("l")))
    got = met.groupBy(id_col, "label").agg(F.round(F.max(own), 6).alias("own_sim"), F.max(far).alias("b"))
    return got.select(id_col, "label", "own_sim", F.col("b.l").alias("other_label"), F.col("b.sim").alias("other_sim"))


def calibrated_margin(df: DataFrame, margin: Column, correct: Column, least: float) -> DataFrame:
    """One row ``(accuracy, margin, covered)``: the smallest margin (to two places) from which on the share of correct
    rows is ``least``, and the share of rows it covers; null if no margin does."""
    c = df.where(margin.isNotNull()).groupBy(F.round(margin, 2).alias("m")).agg(F.count("*").alias("n"), F.count_if(correct).alias("ok"))
    w = Window.orderBy(F.desc("m"))
    r = c.select("m", (F.sum("ok").over(w) / F.sum("n").over(w)).alias("p"), F.sum("n").over(w).alias("upto"))
    total = c.agg(F.sum("n").alias("all"), F.sum("ok").alias("right"))
    return r.crossJoin(total).agg(F.round(F.max(F.col("right") / F.col("all")), 6).alias("accuracy"), F.min(F.when(F.col("p") >= least, F.col("m"))).alias("margin"), F.round(F.max(F.when(F.col("p") >= least, F.col("upto") / F.col("all"))), 6).alias("covered"))


def check_table(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """``(name, ok, failures)``: each check is a table of one number, the failures it found."""
    out = None
    for name, df in checks:
        row = df.select(F.lit(name).alias("name"), (F.col(df.columns[0]) == 0).alias("ok"), F.col(df.columns[0]).cast("long").alias("failures"))
        out = row if out is None else out.union(row)
    return out
