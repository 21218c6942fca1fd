"""Top-k by cosine, graphs of nearest neighbours and statistics over partitions of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.vectors import dot, l2, mean_vectors

#: Queries and rows that meet in one task; bounds the scores held at once.
BLOCK, CHUNK = 1024, 8192


def _matrix(col: pd.Series) -> np.ndarray:
    x = np.stack(col.to_numpy()).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _met(queries: DataFrame, rows: DataFrame, kernel, schema: str) -> DataFrame:
    """Each block of queries ``(q, v, ..)`` against each chunk of rows ``(r, v, ..)``, a task of its own each.

    Queries are dealt by hash into blocks of about BLOCK and rows into chunks of about CHUNK. ``kernel`` gets both
    frames, rows in the order of ``r``, and their cosines to nine places. The work is queries x rows, so it suits a
    stated set of queries; all rows against all are ``neighbours.nearest``.
    """
    nb, nc = max(1, -(-queries.count() // BLOCK)), max(1, -(-rows.count() // CHUNK))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("block", part("q", nb)).withColumn("chunk", every(nc))
    right = rows.withColumn("chunk", part("r", nc)).withColumn("block", every(nb))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({n: [] for n in names})
        b = b.sort_values("r", ignore_index=True)
        return kernel(a, b, np.round(_matrix(a["v"]) @ _matrix(b["v"]).T, 9))

    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(run, schema)


def top_k(queries: DataFrame, rows: DataFrame, q_id: str, r_id: str, vec: str, k: int, keep_self: bool = False) -> DataFrame:
    """``(q_id, r_id, sim, rank)``: the ``k`` most similar rows of each query, ties by row id.

    Each task keeps its block's best ``k``, and the winners of all chunks are merged by one window. Null vectors take
    no part.
    """
    q = queries.where(F.col(vec).isNotNull()).select(F.col(q_id).alias("q"), F.col(vec).alias("v"))
    r = rows.where(F.col(vec).isNotNull()).select(F.col(r_id).alias("r"), F.col(vec).alias("v"))
    kind_q, kind_r = q.schema["q"].dataType.simpleString(), r.schema["r"].dataType.simpleString()

    def best(a, b, s):
        ids, rid = a["q"].to_numpy(), b["r"].to_numpy()
        if not keep_self:
            s[ids[:, None] == rid[None, :]] = -9
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        qi = np.repeat(np.arange(len(ids)), top.shape[1])
        sim = s[qi, top.ravel()]
        good = sim > -9
        return pd.DataFrame({"q": ids[qi[good]], "r": rid[top.ravel()[good]], "sim": sim[good]})

    out = _met(q, r, best, f"q {kind_q}, r {kind_r}, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "r")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(q_id), F.col("r").alias(r_id), F.round("sim", 6).alias("sim"), "rank")


def label_contrast(queries: DataFrame, rows: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """``(id, label, same, same_id, other)``: the best similarity of each query to another row of its label, that row
    (ties by id), and the best to a row of another label. One row a query and chunk leaves a task. Null vectors and
    labels take no part."""
    pick = lambda d, name: d.where(F.col(vec).isNotNull() & F.col(label).isNotNull()).select(F.col(id_col).alias(name), F.col(vec).alias("v"), F.col(label).alias("l"))
    q, r = pick(queries, "q"), pick(rows, "r")
    kind, kind_l = q.schema["q"].dataType.simpleString(), q.schema["l"].dataType.simpleString()

    def best(a, b, s):
        own = a["l"].to_numpy()[:, None] == b["l"].to_numpy()[None, :]
        same = np.where(own & (a["q"].to_numpy()[:, None] != b["r"].to_numpy()[None, :]), s, -9.0)
        at = same.argmax(1)
        return pd.DataFrame({"q": a["q"], "l": a["l"], "same": same[np.arange(len(a)), at], "r": b["r"].to_numpy()[at], "other": np.where(own, -9.0, s).max(1)})

    got = _met(q, r, best, f"q {kind}, l {kind_l}, same double, r {kind}, other double")
    one = got.groupBy("q", "l").agg(F.min(F.when(F.col("same") > -9, F.struct((-F.col("same")).alias("n"), "r"))).alias("s"), F.max(F.when(F.col("other") > -9, F.col("other"))).alias("other"))
    return one.select(F.col("q").alias(id_col), F.col("l").alias(label), (-F.col("s.n")).alias("same"), F.col("s.r").alias("same_id"), "other")


def target_ranks(queries: DataFrame, rows: DataFrame, id_col: str, vec: str, target: str, sim: str) -> DataFrame:
    """``(id, rank)``: the place of each query's target row among all other rows by similarity, ties by id.

    ``target`` and ``sim`` name the row and its similarity; each task only counts the rows before it.
    """
    q = queries.where(F.col(vec).isNotNull() & F.col(target).isNotNull()).select(F.col(id_col).alias("q"), F.col(vec).alias("v"), F.col(target).alias("t"), F.col(sim).alias("ts"))
    r = rows.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("r"), F.col(vec).alias("v"))
    kind = q.schema["q"].dataType.simpleString()

    def before(a, b, s):
        ids, rid, t = a["q"].to_numpy()[:, None], b["r"].to_numpy()[None, :], a["ts"].to_numpy()[:, None]
        ahead = ((s > t) | ((s == t) & (rid < a["t"].to_numpy()[:, None]))) & (rid != ids)
        return pd.DataFrame({"q": a["q"], "n": ahead.sum(1)})

    return _met(q, r, before, f"q {kind}, n long").groupBy("q").agg((F.sum("n") + 1).alias("rank")).withColumnRenamed("q", id_col)


def margins(top: DataFrame, q_id: str) -> DataFrame:
    """Best candidate, its similarity and lead over the second of each query."""
    d = top.groupBy(q_id).agg(F.max(F.when(F.col("rank") == 1, F.col("sim"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("sim"))).alias("top2"))
    return d.withColumn("margin", F.round(F.col("top1") - F.coalesce("top2", F.lit(0.0)), 6))


def edges_of(top: DataFrame, a: str, b: str, least: float = 0.0) -> DataFrame:
    """Undirected edges ``(a, b, w)``, a < b, of a top-k table, the larger weight of both directions."""
    return top.where(F.col("sim") > least).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max("sim").alias("w"))


def modularity(edges: DataFrame, labels: DataFrame, node: str, label: str, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of a labelling, share of edge weight inside, total weight."""
    la, lb = labels.select(F.col(node).alias("a"), F.col(label).alias("la")), labels.select(F.col(node).alias("b"), F.col(label).alias("lb"))
    e = edges.join(la, "a").join(lb, "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("la").alias("l"), "w"), F.struct(F.col("lb").alias("l"), "w"))).alias("x")).select("x.l", "x.w")
    degree = ends.groupBy("l").agg(F.sum("w").alias("d"))
    inside = e.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inner"))
    squares = degree.agg(F.sum(F.col("d") * F.col("d")).alias("dd"))
    return inside.crossJoin(squares).select(F.round(F.col("inner") / F.col("m") - resolution * F.col("dd") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"), F.round(F.col("inner") / F.col("m"), 6).alias("inside_share"), F.round("m", 6).alias("weight"))


def edge_shares(edges: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """Share of each node's edge weight to its own label, and whether most of it leaves."""
    both = edges.select("a", "b", "w").union(edges.select("b", "a", "w")).toDF("a", "b", "w")
    la, lb = labels.select(F.col(node).alias("a"), F.col(label).alias("la")), labels.select(F.col(node).alias("b"), F.col(label).alias("lb"))
    d = both.join(la, "a").join(lb, "b").groupBy("a").agg(F.round(F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)) / F.sum("w"), 6).alias("own_share"))
    return d.select(F.col("a").alias(node), "own_share", (F.col("own_share") < 0.5).alias("boundary"))


def label_votes(top: DataFrame, labels: DataFrame, q_id: str, r_id: str, label: str) -> DataFrame:
    """Label of each query by similarity-weighted votes of its neighbours, ties by label."""
    v = top.join(labels.select(F.col(labels.columns[0]).alias(r_id), F.col(label).alias("l")), r_id).groupBy(q_id, "l").agg(F.sum("sim").alias("s"))
    tot = v.groupBy(q_id).agg(F.max(F.struct(F.round("s", 9).alias("s"), F.negate("l").alias("n"), F.col("l").alias("l"))).alias("b"), F.sum("s").alias("t"))
    return tot.select(q_id, F.col("b.l").alias("vote"), F.round(F.col("b.s") / F.col("t"), 6).alias("confidence"))


def to_centroids(df: DataFrame, id_col: str, vec: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Centroids of the labels, and ``(id, label, centroid_label, sim)`` of every row with every centroid."""
    cents = mean_vectors(df, [label], vec)
    sims = df.select(id_col, F.col(label).alias("label"), l2(F.col(vec)).alias("v")).crossJoin(F.broadcast(cents.select(F.col(label).alias("centroid_label"), "centroid")))
    return cents, sims.select(id_col, "label", "centroid_label", F.round(dot(F.col("v"), F.col("centroid")), 6).alias("sim"))


def cohesion(sims: DataFrame, id_col: str) -> DataFrame:
    """Size, mean and median similarity of each label's rows to their own centroid."""
    own = sims.where(F.col("label") == F.col("centroid_label"))
    return own.groupBy("label").agg(F.count("*").alias("size"), F.round(F.avg("sim"), 5).alias("mean_sim"), F.round(F.percentile("sim", F.lit(0.5)), 5).alias("median_sim"), F.round(F.min("sim"), 5).alias("least_sim"))


def core_and_boundary(sims: DataFrame, id_col: str, n: int) -> DataFrame:
    """The ``n`` rows of each label nearest to its centroid, and the ``n`` farthest that are not among them."""
    own = sims.where(F.col("label") == F.col("centroid_label"))
    near, far = Window.partitionBy("label").orderBy(F.desc("sim"), id_col), Window.partitionBy("label").orderBy("sim", F.desc(id_col))
    d = own.withColumn("near", F.row_number().over(near)).withColumn("far", F.row_number().over(far))
    kind = F.when(F.col("near") <= n, "core").when(F.col("far") <= n, "boundary")
    return d.withColumn("kind", kind).where("kind is not null").select("label", id_col, "kind", "sim")


def memberships(sims: DataFrame, id_col: str) -> DataFrame:
    """Primary and secondary label of each row: the second nearest counts if its similarity reaches the 25th percentile
    of own similarities and its gap to the nearest is within the 10th percentile of gaps."""
    w = Window.partitionBy(id_col).orderBy(F.desc("sim"), "centroid_label")
    top = sims.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(id_col, "label").agg(F.max(F.when(F.col("r") == 1, F.struct("centroid_label", "sim"))).alias("p"), F.max(F.when(F.col("r") == 2, F.struct("centroid_label", "sim"))).alias("s"))
    own = sims.where(F.col("label") == F.col("centroid_label")).agg(F.percentile("sim", F.lit(0.25)).alias("p25"))
    gap = top.withColumn("gap", F.round(F.col("p.sim") - F.col("s.sim"), 6))
    p10 = gap.agg(F.percentile("gap", F.lit(0.10)).alias("p10"))
    good = (F.col("s.sim") >= F.col("p25")) & (F.col("gap") <= F.col("p10"))
    return gap.crossJoin(F.broadcast(own)).crossJoin(F.broadcast(p10)).select(id_col, "label", F.col("p.centroid_label").alias("primary_label"), F.when(good, F.col("s.centroid_label")).alias("secondary_label"), "gap")


# -- two labellings -----------------------------------------------------------------------------------------------------


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index, normalised mutual information (arithmetic mean) and Cramer's V."""
    c = contingency(df, a, b)
    pairs = lambda n: n * (n - 1) / 2
    ra, rb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    tot = c.agg(F.sum("n").alias("total"), F.sum(pairs(F.col("n"))).alias("ij"))
    pa = ra.crossJoin(F.broadcast(tot.select("total"))).agg(F.sum(pairs(F.col("na"))).alias("pa"), F.count("*").alias("ka"), F.sum(-(F.col("na") / F.col("total")) * F.ln(F.col("na") / F.col("total"))).alias("ha"))
    pb = rb.crossJoin(F.broadcast(tot.select("total"))).agg(F.sum(pairs(F.col("nb"))).alias("pb"), F.count("*").alias("kb"), F.sum(-(F.col("nb") / F.col("total")) * F.ln(F.col("nb") / F.col("total"))).alias("hb"))
    cell = c.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(tot.select("total")))
    mi = cell.agg(F.sum(F.col("n") / F.col("total") * F.ln(F.col("n") * F.col("total") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("phi"))
    d = tot.crossJoin(pa).crossJoin(pb).crossJoin(mi)
    expected = F.col("pa") * F.col("pb") / pairs(F.col("total"))
    ari = (F.col("ij") - expected) / ((F.col("pa") + F.col("pb")) / 2 - expected)
    return d.select(F.round(ari, 6).alias("ari"), F.round(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2), 6).alias("nmi"), F.round(F.sqrt((F.col("phi") - 1) / (F.least("ka", "kb") - 1)), 6).alias("cramers_v"), F.col("total").alias("n"))


def best_overlap(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each group of ``a`` the group of ``b`` of the highest Jaccard similarity, ties by the group."""
    c = contingency(df, a, b)
    na, nb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    j = c.join(na, "a").join(nb, "b").withColumn("jaccard", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6))
    w = Window.partitionBy("a").orderBy(F.desc("jaccard"), "b")
    return j.withColumn("r", F.row_number().over(w)).where("r = 1").select(F.col("a").alias(a), F.col("b").alias(b), "jaccard", F.col("na").alias("size"))


def otsu(df: DataFrame, value: str) -> DataFrame:
    """One row: the cut between observed values with the highest variance between the two sides."""
    c = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    # distinct values in order: a table as long as the distinct (rounded) values
    w = Window.orderBy("v")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    d = c.select("v", F.sum("n").over(below).alias("nl"), F.sum(F.col("n") * F.col("v")).over(below).alias("sl"), F.lag("v").over(w).alias("prev"), F.sum("n").over(Window.partitionBy()).alias("N"), F.sum(F.col("n") * F.col("v")).over(Window.partitionBy()).alias("S"))
    nr = F.col("N") - F.col("nl")
    gain = F.col("nl") * nr * F.pow(F.col("sl") / F.col("nl") - (F.col("S") - F.col("sl")) / nr, F.lit(2.0))
    return d.where("nl >= 2 and N - nl >= 2").agg(F.max_by((F.col("v") + F.col("prev")) / 2, F.struct(F.round(gain, 6), F.negate("v"))).alias("threshold")).select(F.round("threshold", 6).alias("threshold"))


def min_max(c: Column, w=None, invert: bool = False) -> Column:
    """Scaled to 0..1 over a window; 0.5 where all are equal."""
    w = w or Window.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    x = F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(0.5)
    return 1 - x if invert else x


def select_in_order(df: DataFrame, rules: list[tuple[str, float]], ties: list[Column]) -> DataFrame:
    """The row left when, rule by rule, only rows within a tolerance of the best stay; nulls lose."""
    pool = df
    for c, tol in rules:
        v = F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
        pool = pool.withColumn("_best", F.max(v).over(Window.partitionBy())).where(v >= F.col("_best") - tol).drop("_best")
    return pool.withColumn("_r", F.row_number().over(Window.orderBy(*ties))).where("_r = 1").drop("_r")
