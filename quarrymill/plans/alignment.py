"""Alignment queries: vectors against centroids and lists, baselines, calibration, hierarchies and topics of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions.embed import hashed_vector
from quarrymill.functions.text import STOPWORDS
from quarrymill.functions.vectors import dot, l2, mean_vectors
from quarrymill.operators import cluster, evaluation, keywords, neighbours, similarity
from quarrymill.operators.components import connected_components
from quarrymill.plans.registry import query
from quarrymill.plans.topics import _CENT, _emb
from quarrymill.runtime import Workspace, table

_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL"
_LOO = f"""WITH u AS ({_UNIT}), p AS (SELECT label, i, sum(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY 1, 2), c AS (SELECT label AS other, list(m ORDER BY i) AS s, list_sum(list(m * m)) AS ss FROM p GROUP BY 1),
d AS (SELECT vec_id, label, other, ss, list_dot_product(v, s) AS d FROM u, c), o AS (SELECT vec_id, label, round(max(CASE WHEN label = other AND ss - 2*d + 1 > 1e-9 THEN (d - 1) / sqrt(greatest(ss - 2*d + 1, 1e-12)) END), 6) AS own_sim FROM d GROUP BY 1, 2),
f AS (SELECT vec_id, other AS other_label, round(d / sqrt(ss), 6) AS other_sim, row_number() OVER (PARTITION BY vec_id ORDER BY round(d / sqrt(ss), 6) DESC, other) AS r FROM d WHERE label <> other), l AS (SELECT vec_id, label, own_sim, other_label, other_sim FROM o LEFT JOIN (SELECT * FROM f WHERE r = 1) USING (vec_id))"""


def _loo(spark, sf):
    return evaluation.leave_one_out(_emb(spark, sf), "vec_id", "embedding", "label")


@query(_LOO + " SELECT vec_id, label, own_sim, other_label, other_sim FROM l")
def leave_one_out_centroids(spark, sf):
    """Each row against its own centroid made without it, and the nearest other one."""
    return _loo(spark, sf)


@query(_LOO + ", g AS (SELECT round(abs(own_sim - other_sim), 2) AS m, count(*) AS n, count(*) FILTER (WHERE own_sim > other_sim) AS ok FROM l WHERE own_sim IS NOT NULL AND other_sim IS NOT NULL GROUP BY 1), r AS (SELECT m, sum(ok) OVER (ORDER BY m DESC)::DOUBLE / sum(n) OVER (ORDER BY m DESC) AS p, sum(n) OVER (ORDER BY m DESC) AS upto FROM g), t AS (SELECT sum(n) AS n, sum(ok) AS ok FROM g) SELECT round(max(t.ok::DOUBLE / t.n), 6) AS accuracy, min(CASE WHEN p >= 0.5 THEN m END) AS margin, round(max(CASE WHEN p >= 0.5 THEN upto::DOUBLE / t.n END), 6) AS covered FROM r, t")
def margin_calibration(spark, sf):
    """The smallest lead over the next centroid from which on half of the rows are nearest to their own."""
    return evaluation.calibrated_margin(_loo(spark, sf), F.abs(F.col("own_sim") - F.col("other_sim")), F.col("own_sim") > F.col("other_sim"), 0.5)


@query(
    f"""WITH h AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1|' || vec_id::VARCHAR), vec_id) AS r FROM embeddings WHERE label IS NOT NULL), b AS (SELECT label, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings WHERE label IS NOT NULL), e AS (SELECT h.vec_id, b.label AS dealt FROM h JOIN b USING (r)), u AS ({_UNIT}),
x AS (SELECT vec_id, 'own' AS kind, label AS l, v FROM u UNION ALL SELECT vec_id, 'dealt', dealt, v FROM u JOIN e USING (vec_id)), p AS (SELECT kind, l, i, avg(y) AS m FROM (SELECT kind, l, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM x) GROUP BY 1, 2, 3), c AS (SELECT kind, l, list(m ORDER BY i) AS c FROM p GROUP BY 1, 2),
s AS (SELECT kind, avg(round(list_cosine_similarity(v, c), 6)) AS s FROM x JOIN c USING (kind, l) GROUP BY 1), t AS (SELECT max(CASE WHEN kind = 'own' THEN s END) AS own, max(CASE WHEN kind = 'dealt' THEN s END) AS dealt FROM s) SELECT round(own, 5) AS cohesion, round(dealt, 5) AS baseline, round((own - dealt) / (1 - dealt), 4) AS lift FROM t"""
)
def random_label_baseline(spark, sf):
    """Cohesion of the labels against labels dealt at random with the same sizes, and the lift over them."""
    e = _emb(spark, sf).where("embedding is not null and label is not null").select("vec_id", "label", "embedding")
    dealt = evaluation.permuted_labels(e, "vec_id", "label", "1").join(e.select("vec_id", "embedding"), "vec_id")
    mean = lambda d: similarity.to_centroids(d, "vec_id", "embedding", "label")[1].where("label = centroid_label").agg(F.avg("sim").alias("s"))
    both = mean(e).select(F.col("s").alias("own")).crossJoin(mean(dealt).select(F.col("s").alias("dealt")))
    return both.select(F.round("own", 5).alias("cohesion"), F.round("dealt", 5).alias("baseline"), F.round((F.col("own") - F.col("dealt")) / (1 - F.col("dealt")), 4).alias("lift"))


@query(
    _CENT
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, centroid_label) AS r FROM s), w AS (SELECT vec_id, string_agg(centroid_label, ';' ORDER BY r) AS candidates, max(CASE WHEN r = 1 THEN sim END) AS top, round(max(CASE WHEN r = 1 THEN sim END) - max(CASE WHEN r = 2 THEN sim END), 6) AS margin FROM r WHERE r <= 5 GROUP BY 1),
q AS (SELECT quantile_cont(margin, 0.1) AS pm, quantile_cont(top, 0.05) AS pt FROM w) SELECT vec_id, candidates, top, margin, concat_ws(';', CASE WHEN margin < pm THEN 'low_margin' END, CASE WHEN top < pt THEN 'low_similarity' END) AS queue FROM w, q"""
)
def assignment_queue(spark, sf):
    """The five nearest centroids of each row, and why a reader should look at it."""
    sims = similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1]
    w = Window.partitionBy("vec_id").orderBy(F.desc("sim"), "centroid_label")
    top = sims.withColumn("r", F.row_number().over(w)).where("r <= 5").groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "centroid_label", "sim"))), lambda x: F.struct(x["centroid_label"].alias("l"), x["sim"].alias("s"))).alias("t"))
    d = top.select("vec_id", F.array_join(F.transform("t", lambda x: x["l"].cast("string")), ";").alias("candidates"), F.col("t")[0]["s"].alias("top"), F.round(F.col("t")[0]["s"] - F.get("t", F.lit(1))["s"], 6).alias("margin"))
    q = d.agg(F.percentile("margin", F.lit(0.1)).alias("pm"), F.percentile("top", F.lit(0.05)).alias("pt"))
    return d.crossJoin(F.broadcast(q)).select("vec_id", "candidates", "top", "margin", S.flags(low_margin=F.col("margin") < F.col("pm"), low_similarity=F.col("top") < F.col("pt")).alias("queue"))


@query(_CENT + " SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.c, b.c), 6) AS similarity FROM c a JOIN c b ON a.label < b.label")
def centroid_overlaps(spark, sf):
    """Each two labels with the similarity of their centroids; as long as the square of the number of labels."""
    c = mean_vectors(_emb(spark, sf), ["label"], "embedding").select("label", "centroid")
    a, b = c.toDF("a", "ca"), c.toDF("b", "cb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(dot(F.col("ca"), F.col("cb")), 6).alias("similarity"))


_NEAREST = "n{k} AS (SELECT vec_id, arg_min(label, (-round(list_cosine_similarity(v, c), 6), label)) AS l FROM (SELECT u.vec_id, u.v, c{k}.label, c{k}.c FROM u, c{k}) GROUP BY vec_id)"


@query(
    f"""WITH u AS ({_UNIT}), p0 AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY 1, 2), c0 AS (SELECT label, list(m ORDER BY i) AS c FROM p0 GROUP BY 1), k AS (SELECT * FROM u WHERE substr(md5('7|' || vec_id::VARCHAR), 1, 2) < 'cd'),
p1 AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k) GROUP BY 1, 2), c1 AS (SELECT label, list(m ORDER BY i) AS c FROM p1 GROUP BY 1), """
    + _NEAREST.format(k=0)
    + ", "
    + _NEAREST.format(k=1)
    + " SELECT count(*)::BIGINT AS n, round(avg((n0.l <> n1.l)::INT), 6) AS changed FROM n0 JOIN n1 USING (vec_id)"
)
def prototype_noise_floor(spark, sf):
    """The share of rows whose nearest centroid changes when centroids are made of four fifths of the rows."""
    e = _emb(spark, sf).where("embedding is not null and label is not null")
    part = e.where(F.substring(F.md5(F.concat(F.lit("7|"), F.col("vec_id").cast("string"))), 1, 2) < "cd")

    def nearest(members, name):
        cents = mean_vectors(members, ["label"], "embedding").select(F.col("label").alias("centroid_label"), "centroid")
        met = e.select("vec_id", l2(F.col("embedding")).alias("v")).crossJoin(F.broadcast(cents)).select("vec_id", "centroid_label", F.round(dot(F.col("v"), F.col("centroid")), 6).alias("sim"))
        return met.groupBy("vec_id").agg(F.max_by("centroid_label", F.struct("sim", F.negate("centroid_label"))).alias(name))

    both = nearest(e, "l0").join(nearest(part, "l1"), "vec_id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("l0") != F.col("l1")).cast("int")), 6).alias("changed"))


@query(
    _CENT
    + """, o AS (SELECT vec_id, label, sim FROM s WHERE label = centroid_label), z AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label) AS big, row_number() OVER (ORDER BY count(*), label) AS small FROM o GROUP BY 1), r AS (SELECT o.*, row_number() OVER (PARTITION BY label ORDER BY sim, vec_id) AS r FROM o)
SELECT label, vec_id, sim, CASE WHEN big <= 2 THEN 'largest' ELSE 'smallest' END AS kind FROM r JOIN z USING (label) WHERE r <= 3 AND (big <= 2 OR small <= 2)"""
)
def label_case_sample(spark, sf):
    """The three least typical rows of the two largest and two smallest labels."""
    own = similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1].where("label = centroid_label").select("vec_id", "label", "sim")
    n = own.groupBy("label").agg(F.count("*").alias("n"))
    z = n.select("label", F.row_number().over(Window.orderBy(F.desc("n"), "label")).alias("big"), F.row_number().over(Window.orderBy("n", "label")).alias("small"))
    r = own.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("sim", "vec_id"))).where("r <= 3")
    return r.join(z, "label").where("big <= 2 or small <= 2").select("label", "vec_id", "sim", F.when(F.col("big") <= 2, "largest").otherwise("smallest").alias("kind"))


@query()
def novelty_groups(spark, sf):
    """Rows far from every centroid that stand near each other: connected groups of two and more."""
    ws = Workspace(spark, "novelty")
    sims = similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1].groupBy("vec_id").agg(F.max("sim").alias("top"))
    low = sims.agg(F.percentile("top", F.lit(0.25)).alias("p"))
    novel = ws.cut(sims.crossJoin(F.broadcast(low)).where("top <= p").select("vec_id"), "novel")
    d = _emb(spark, sf).join(novel, "vec_id", "left_semi")
    edges = similarity.edges_of(neighbours.nearest(d, "vec_id", "embedding", 5), "q", "r", 0.3)
    g = connected_components(ws.cut(edges.select("a", "b"), "edges"), ws=ws)
    size = g.groupBy("component").agg(F.count("*").alias("support"))
    return g.join(size, "component").where("support >= 2").select(F.col("node").alias("vec_id"), F.col("component").alias("novelty_group"), "support")


# -- texts against lists ------------------------------------------------------------------------------------------


def _aligned(spark, sf, k):
    """Distinct statements with their ``k`` nearest entries of the task list; the work grows with the statements."""
    s = table(spark, sf, "task_statements").where("atomic_task is not null").groupBy(F.lower(F.trim("atomic_task")).alias("t")).agg(F.min("task_statement_id").alias("statement"), F.count("*").alias("n"))
    left = s.select("statement", hashed_vector("t").alias("v"))
    right = table(spark, sf, "onet_task_statements").select("task_id", hashed_vector("task").alias("v"))
    return similarity.top_k(left, right, "statement", "task_id", "v", k, keep_self=True)


@query()
def task_alignment(spark, sf):
    """Best entry, lead over the next and decision of each distinct statement."""
    top = Workspace(spark, "alignment").cut(_aligned(spark, sf, 2), "top")
    best = top.where("rank = 1").select("statement", "task_id")
    return similarity.margins(top, "statement").join(best, "statement").select("statement", "task_id", "top1", "margin", S.decision(F.col("top1"), F.col("margin"), 0.7, 0.45, 0.05).alias("decision"))


@query()
def alignment_coverage(spark, sf):
    """How well statements cover each entry of the task list: counts above the noise of eleventh neighbours, and classes."""
    top = Workspace(spark, "coverage").cut(_aligned(spark, sf, 11), "top")
    noise = top.where("rank = 11").agg(F.percentile("sim", F.lit(0.99)).alias("tau"))
    tasks = table(spark, sf, "onet_task_statements").select("task_id", "title").distinct()
    hit = top.where("rank = 1").crossJoin(F.broadcast(noise)).where("sim > tau").groupBy("task_id").agg(F.count("*").alias("statements"), F.round(F.avg("sim"), 6).alias("mean_sim"))
    d = tasks.join(hit, "task_id", "left").withColumn("statements", F.coalesce("statements", F.lit(0)))
    q = d.agg(F.percentile("statements", F.lit(0.25)).alias("p25"))
    kind = F.when(F.col("statements") == 0, "possible_gap").when(F.col("statements") <= F.col("p25"), "partial").otherwise("well_covered")
    return d.crossJoin(F.broadcast(q)).select("task_id", "title", "statements", "mean_sim", kind.alias("coverage"))


@query()
def threshold_calibration(spark, sf):
    """Share of statements whose best entry reaches each threshold, and of a background of fifth neighbours."""
    top = Workspace(spark, "calibration").cut(_aligned(spark, sf, 5), "top").where("rank in (1, 5)")
    at = top.withColumn("threshold", F.explode(F.array(*[F.lit(x / 20) for x in range(6, 20)])))
    return at.groupBy("threshold").agg(F.round(F.avg(F.when(F.col("rank") == 1, (F.col("sim") >= F.col("threshold")).cast("int"))), 6).alias("best"), F.round(F.avg(F.when(F.col("rank") == 5, (F.col("sim") >= F.col("threshold")).cast("int"))), 6).alias("background"))


@query()
def initiative_retrieval(spark, sf):
    """Statements for each text asked (documents of an id divisible by 50): the 60 nearest, copies merged, by relevance.

    Of near copies among a text's hits (a cosine of 0.9 or more) the most relevant stays; relevance is 0.7 similarity
    and 0.3 consensus.
    """
    s = table(spark, sf, "task_statements").where("atomic_task is not null").groupBy(F.lower(F.trim("atomic_task")).alias("t")).agg(F.min("task_statement_id").alias("statement"), F.max("consensus_score").alias("consensus"))
    s = Workspace(spark, "retrieval").cut(s.withColumn("v", hashed_vector("t")), "statements")
    q = table(spark, sf, "documents").where("doc_id % 50 = 0").select("doc_id", hashed_vector("text").alias("v"))
    hits = similarity.top_k(q, s, "doc_id", "statement", "v", 60).join(s.select("statement", "v", "consensus"), "statement").withColumn("relevance", F.round(0.7 * F.col("sim") + 0.3 * F.coalesce("consensus", F.lit(0.0)), 6))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:  # at most 60 rows
        pdf = pdf.sort_values(["relevance", "statement"], ascending=[False, True], ignore_index=True)
        x = np.stack(pdf["v"].to_numpy())
        keep: list[int] = []
        for i in range(len(pdf)):
            if not keep or (x[keep] @ x[i]).max() < 0.9:
                keep.append(i)
        out = pdf.loc[keep, ["doc_id", "statement", "sim", "relevance"]]
        out["place"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    return hits.groupBy("doc_id").applyInPandas(merge, "doc_id long, statement string, sim double, relevance double, place int")


@query()
def keyword_topics(spark, sf):
    """Topics of texts: density clusters of hashed vectors, then merged by the likeness of their keywords to eight."""
    ws = Workspace(spark, "keyword-topics")
    d = ws.cut(table(spark, sf, "documents").where("text is not null").select("doc_id", "text", hashed_vector("text", 128).alias("v")).where("v is not null"), "texts")
    fit = lambda x, mult: pd.DataFrame({"natural": cluster.hdbscan(x, 8, 4, mult=mult)[0].astype("int32")})
    lab = ws.cut(cluster.on_points(d, "doc_id", "v", fit, "natural int", 2000), "natural")
    words = keywords.ctfidf(d.join(lab.where("natural >= 0"), "doc_id"), "natural", "text", 50, list(STOPWORDS))

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:  # 50 rows a topic
        m = pdf.pivot_table(index="natural", columns="term", values="score", fill_value=0.0)
        x = m.to_numpy()
        got = cluster.linkage(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), np.ones(len(x)), min(8, len(x)), "average")
        return pd.DataFrame({"natural": m.index.astype("int32"), "topic": got.astype("int32")})

    merged = words.groupBy().applyInPandas(reduce, "natural int, topic int")
    return lab.join(merged, "natural", "left").select("doc_id", "natural", F.coalesce("topic", F.lit(-1)).alias("topic"))


# -- hierarchies ----------------------------------------------------------------------------------------------------


def _leaves(spark, sf):
    _, cents = cluster.prototypes(_emb(spark, sf), "vec_id", "embedding", 40)
    return cents


def _silhouette(x, lab):
    return float(cluster.silhouettes(x, lab).mean()) if 1 < len(set(lab.tolist())) < len(x) else 0.0


def _search(x: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    rows = []
    for method in ("ward", "average"):
        for k2 in (12, 16, 20):
            mid = cluster.linkage(x, n, k2, method)
            y = np.stack([(x[mid == j] * n[mid == j, None]).sum(0) for j in range(mid.max() + 1)])
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
            w = np.bincount(mid, n)
            for k1 in (4, 6, 8):
                top = cluster.linkage(y, w, k1, method)
                share = np.bincount(top, w).max() / w.sum()
                rows.append((method, k2, k1, round(_silhouette(x, mid), 6), round(_silhouette(y, top), 6), round(float(share), 6), int((np.bincount(mid) == 1).sum())))
    return pd.DataFrame(rows, columns=["method", "level2", "level1", "silhouette2", "silhouette1", "largest_share", "single_leaves"])


@query()
def hierarchy_search(spark, sf):
    """Hierarchies of both linkages and nine pairs of level sizes, scored, gated and ranked."""
    run = lambda pdf: _search(np.stack(pdf.sort_values("cluster")["centroid"].to_numpy()), pdf.sort_values("cluster")["n"].to_numpy(float))
    d = _leaves(spark, sf).groupBy().applyInPandas(run, "method string, level2 int, level1 int, silhouette2 double, silhouette1 double, largest_share double, single_leaves int")
    score = (similarity.min_max(F.col("silhouette2")) + similarity.min_max(F.col("silhouette1")) + similarity.min_max(F.col("largest_share"), invert=True)) / 3
    d = d.withColumn("score", F.round(score, 6)).withColumn("gate", S.flags(dominant=F.col("largest_share") > 0.5, many_single=F.col("single_leaves") > F.col("level2") / 2))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.col("gate") != "", F.desc("score"), "method", "level2", "level1")))


@query()
def parent_diagnostics(spark, sf):
    """Each parent of the leaves: size, cohesion, least similar leaf and nearest other parent."""

    def run(pdf):
        pdf = pdf.sort_values("cluster", ignore_index=True)
        x, n = np.stack(pdf["centroid"].to_numpy()), pdf["n"].to_numpy(float)
        lab = cluster.linkage(x, n, 12, "ward")
        c = np.stack([(x[lab == j] * n[lab == j, None]).sum(0) for j in range(lab.max() + 1)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        s, own = c @ c.T, np.einsum("ij,ij->i", x, c[lab])
        np.fill_diagonal(s, -2)
        rows = [(j, int((lab == j).sum()), int(n[lab == j].sum()), round(float(np.average(own[lab == j], weights=n[lab == j])), 6), round(float(own[lab == j].min()), 6), int(s[j].argmax()), round(float(s[j].max()), 6)) for j in range(len(c))]
        return pd.DataFrame(rows, columns=["parent", "leaves", "rows", "cohesion", "least_leaf", "nearest_parent", "nearest_similarity"])

    return _leaves(spark, sf).groupBy().applyInPandas(run, "parent int, leaves int, rows long, cohesion double, least_leaf double, nearest_parent int, nearest_similarity double")


@query()
def hierarchy_stability(spark, sf):
    """How parents hold when leaves are made of four fifths of their rows: matched Jaccard of each parent, and the Rand
    index over leaves, for five draws."""
    e = _emb(spark, sf)
    ws = Workspace(spark, "hierarchy")
    lab = ws.cut(cluster.prototypes(e, "vec_id", "embedding", 40)[0], "leaves")
    d = e.join(lab, "vec_id").withColumn("draw", F.explode(F.array(*[F.lit(i) for i in range(6)]))).where("draw = 0 or pmod(xxhash64(draw, vec_id), 100) < 80")
    cents = mean_vectors(d, ["draw", "cluster"], "embedding")

    def run(pdf):  # 40 leaves a draw
        fits = {}
        for k, p in pdf.groupby("draw"):
            p = p.sort_values("cluster")
            fits[k] = (p["cluster"].to_numpy(), cluster.linkage(np.stack(p["centroid"].to_numpy()), p["n"].to_numpy(float), 12, "ward"))
        leaf, base = fits[0]
        rows = []
        for k, (other, got) in fits.items():
            if not k:
                continue
            of = dict(zip(other.tolist(), got.tolist()))
            both = np.array([of.get(c, -1) for c in leaf.tolist()])
            j = np.array([[((base == a) & (both == b)).sum() / max(1, ((base == a) | (both == b)).sum()) for b in range(got.max() + 1)] for a in range(base.max() + 1)])
            pair = {a: float(j[a, b]) for a, b in cluster.assignment(j)}
            same, also = base[:, None] == base, both[:, None] == both
            off = ~np.eye(len(base), dtype=bool)
            rand = float((same == also)[off].mean())
            rows += [(int(a), int(k), round(pair.get(a, 0.0), 6), round(rand, 6)) for a in range(base.max() + 1)]
        return pd.DataFrame(rows, columns=["parent", "draw", "jaccard", "rand_index"])

    got = cents.groupBy().applyInPandas(run, "parent int, draw int, jaccard double, rand_index double")
    return got.groupBy("parent").agg(F.round(F.percentile("jaccard", F.lit(0.5)), 6).alias("persistence"), F.round(F.avg("rand_index"), 6).alias("rand_index"), F.count("*").alias("draws"))
