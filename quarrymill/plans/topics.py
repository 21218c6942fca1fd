"""Topic queries: similarity, graphs, partitions, metrics, keywords, selection, hierarchies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions.text import STOPWORDS
from quarrymill.functions.vectors import mean_vectors
from quarrymill.operators import cluster, keywords, ledger, neighbours, similarity
from quarrymill.plans.registry import query
from quarrymill.runtime import Workspace, table

COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
TOP = f"WITH t AS (SELECT a.vec_id AS q, b.vec_id AS r, round({COS}, 9) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), k AS (SELECT q, r, round(sim, 6) AS sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r)::INT AS rank FROM t)"


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


def _top(spark, sf, k):
    e = _emb(spark, sf)
    return similarity.top_k(e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "q"), e.withColumnRenamed("vec_id", "r"), "q", "r", "embedding", k)


@query(TOP + " SELECT q, r, sim, rank FROM k WHERE rank <= 10")
def cosine_topk(spark, sf):
    return _top(spark, sf, 10)


@query(TOP + ", m AS (SELECT q, max(CASE WHEN rank=1 THEN sim END) AS top1, max(CASE WHEN rank=2 THEN sim END) AS top2 FROM k WHERE rank <= 2 GROUP BY q) SELECT q, top1, round(top1 - top2, 6) AS margin, CASE WHEN top1 >= 0.8 AND round(top1 - top2, 6) >= 0.01 THEN 'accepted' WHEN top1 >= 0.6 THEN 'review' ELSE 'unmatched' END AS decision FROM m")
def topk_margin_decision(spark, sf):
    m = similarity.margins(_top(spark, sf, 2), "q")
    return m.select("q", "top1", "margin", S.decision(F.col("top1"), F.col("margin"), 0.8, 0.6, 0.01).alias("decision"))


ALL = TOP.replace("a.vec_id % 50 = 0 AND ", "")
_EDGES = " SELECT least(q,r) AS a, greatest(q,r) AS b, max(sim) AS w FROM k WHERE rank <= 10 AND sim > 0 GROUP BY 1, 2"


@query(ALL + _EDGES)
def knn_edges(spark, sf):
    """The graph of the ten nearest neighbours of every row."""
    return similarity.edges_of(neighbours.nearest(_emb(spark, sf), "vec_id", "embedding", 10), "q", "r")


_GRAPH = ALL + f", e AS ({_EDGES}), x AS (SELECT e.*, la.label AS la, lb.label AS lb FROM e JOIN embeddings la ON la.vec_id = a JOIN embeddings lb ON lb.vec_id = b)"


def _edges(spark, sf):
    return Workspace(spark, "graph").cut(knn_edges(spark, sf), "edges")


@query(_GRAPH + ", d AS (SELECT l, sum(w) AS d FROM (SELECT la AS l, w FROM x UNION ALL SELECT lb, w FROM x) GROUP BY l), m AS (SELECT sum(w) AS m, sum(CASE WHEN la = lb THEN w ELSE 0 END) AS inner_ FROM x) SELECT round(inner_/m - (SELECT sum(d*d) FROM d)/(4*m*m), 6) AS modularity, round(inner_/m, 6) AS inside_share, round(m, 6) AS weight FROM m")
def graph_modularity(spark, sf):
    return similarity.modularity(_edges(spark, sf), _emb(spark, sf), "vec_id", "label")


@query(_GRAPH + " SELECT vec_id, own_share, own_share < 0.5 AS boundary FROM (SELECT vec_id, round(sum(CASE WHEN own THEN w ELSE 0 END)/sum(w), 6) AS own_share FROM (SELECT a AS vec_id, w, la = lb AS own FROM x UNION ALL SELECT b, w, la = lb FROM x) GROUP BY 1)")
def graph_edge_shares(spark, sf):
    return similarity.edge_shares(_edges(spark, sf), _emb(spark, sf), "vec_id", "label")


@query(TOP + ", v AS (SELECT q, label, sum(sim) AS s FROM k JOIN embeddings ON vec_id = r WHERE rank <= 10 GROUP BY 1, 2) SELECT q, label AS vote, round(s / t, 6) AS confidence FROM (SELECT *, sum(s) OVER (PARTITION BY q) AS t, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, label) AS r FROM v) WHERE r = 1")
def neighbour_votes(spark, sf):
    return similarity.label_votes(_top(spark, sf, 10), _emb(spark, sf).select("vec_id", "label"), "q", "r", "label")


@query(TOP + " SELECT q, max(CASE WHEN a.label = b.label THEN sim END) AS same, max(CASE WHEN a.label <> b.label THEN sim END) AS other FROM (SELECT q, r, round(sim, 6) AS sim FROM t) JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = r GROUP BY q")
def nearest_same_vs_other(spark, sf):
    e = _emb(spark, sf)
    d = similarity.label_contrast(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label")
    return d.select(F.col("vec_id").alias("q"), F.round("same", 6).alias("same"), F.round("other", 6).alias("other"))


@query(TOP + ", f AS (SELECT q, min(rank) AS first FROM (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY sim DESC, r) AS rank FROM t) k2 JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = r WHERE a.label = b.label GROUP BY q) SELECT round(avg((first <= 1)::INT), 6) AS recall_at_1, round(avg((first <= 5)::INT), 6) AS recall_at_5, round(avg((first <= 10)::INT), 6) AS recall_at_10, round(avg(1.0 / first), 6) AS mrr FROM f")
def retrieval_recall_mrr(spark, sf):
    """How far up the first row of the same label comes for each query."""
    e = _emb(spark, sf)
    q = e.where("vec_id % 50 = 0")
    first = Workspace(spark, "retrieval").cut(similarity.label_contrast(q, e, "vec_id", "embedding", "label").select("vec_id", "same", "same_id"), "first")
    f = similarity.target_ranks(q.join(first, "vec_id"), e, "vec_id", "embedding", "same_id", "same").withColumnRenamed("rank", "first")
    at = lambda k: F.round(F.avg((F.col("first") <= k).cast("int")), 6).alias(f"recall_at_{k}")
    return f.agg(at(1), at(5), at(10), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"))


_CENT = """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
p AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY 1),
s AS (SELECT vec_id, u.label, c.label AS centroid_label, round(list_cosine_similarity(v, c), 6) AS sim FROM u, c)"""


@query(_CENT + " SELECT label, count(*)::BIGINT AS size, round(avg(sim), 5) AS mean_sim, round(quantile_cont(sim, 0.5), 5) AS median_sim, round(min(sim), 5) AS least_sim FROM s WHERE label = centroid_label GROUP BY label")
def centroid_cohesion(spark, sf):
    return similarity.cohesion(similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1], "vec_id")


@query(_CENT + ", o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS near, row_number() OVER (PARTITION BY label ORDER BY sim, vec_id DESC) AS far FROM s WHERE label = centroid_label) SELECT label, vec_id, CASE WHEN near <= 5 THEN 'core' ELSE 'boundary' END AS kind, sim FROM o WHERE near <= 5 OR far <= 5")
def core_boundary_members(spark, sf):
    return similarity.core_and_boundary(similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1], "vec_id", 5)


@query(_CENT + """, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, centroid_label) AS r FROM s), w AS (SELECT vec_id, label, max(CASE WHEN r=1 THEN centroid_label END) AS p, max(CASE WHEN r=2 THEN centroid_label END) AS q, max(CASE WHEN r=2 THEN sim END) AS s2, round(max(CASE WHEN r=1 THEN sim END) - max(CASE WHEN r=2 THEN sim END), 6) AS gap FROM r WHERE r <= 2 GROUP BY 1, 2)
SELECT vec_id, label, p AS primary_label, CASE WHEN s2 >= (SELECT quantile_cont(sim, 0.25) FROM s WHERE label = centroid_label) AND gap <= (SELECT quantile_cont(gap, 0.10) FROM w) THEN q END AS secondary_label, gap FROM w""")
def secondary_membership(spark, sf):
    return similarity.memberships(similarity.to_centroids(_emb(spark, sf), "vec_id", "embedding", "label")[1], "vec_id")


_AB = "WITH d AS (SELECT source AS a, doc_type AS b FROM documents WHERE source IS NOT NULL AND doc_type IS NOT NULL), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS tot FROM c)"


@query(_AB + """, z AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) AS ij, (SELECT sum(na*(na-1)/2) FROM ra) AS pa, (SELECT sum(nb*(nb-1)/2) FROM rb) AS pb, tot, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb,
(SELECT -sum(na/t.tot*ln(na/t.tot)) FROM ra, t) AS ha, (SELECT -sum(nb/t.tot*ln(nb/t.tot)) FROM rb, t) AS hb, (SELECT sum(n/t.tot*ln(n*t.tot/(na*nb))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT sum(n*n/(na*nb)) FROM c JOIN ra USING (a) JOIN rb USING (b)) AS phi FROM t)
SELECT round((ij - pa*pb/(tot*(tot-1)/2)) / ((pa+pb)/2 - pa*pb/(tot*(tot-1)/2)), 6) AS ari, round(mi/((ha+hb)/2), 6) AS nmi, round(sqrt((phi-1)/(least(ka,kb)-1)), 6) AS cramers_v, tot::BIGINT AS n FROM z""")
def labelling_agreement(spark, sf):
    return similarity.agreement(table(spark, sf, "documents"), "source", "doc_type")


@query(_AB + " SELECT a AS source, b AS doc_type, jaccard, na::BIGINT AS size FROM (SELECT a, b, na, round(n/(na+nb-n), 6) AS jaccard, row_number() OVER (PARTITION BY a ORDER BY round(n/(na+nb-n), 6) DESC, b) AS r FROM c JOIN ra USING (a) JOIN rb USING (b)) WHERE r = 1")
def best_overlap_jaccard(spark, sf):
    return similarity.best_overlap(table(spark, sf, "documents"), "source", "doc_type")


_STOP_SQL = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"


@query(
    rf"""WITH d AS (SELECT source AS g, list_filter(regexp_extract_all(lower(text), '[a-z][a-z\-]+'), lambda w: NOT list_contains({_STOP_SQL}, w)) AS ws FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
c AS (SELECT g, term, count(*)::BIGINT AS n FROM (SELECT g, unnest(ws) AS term FROM d UNION ALL SELECT g, ws[i] || ' ' || ws[i+1] FROM (SELECT g, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) > 1)) GROUP BY 1, 2),
s AS (SELECT g, sum(n) AS words FROM c GROUP BY 1), f AS (SELECT term, sum(n) AS f FROM c GROUP BY 1), m AS (SELECT sum(words)::DOUBLE / count(*) AS A FROM s),
x AS (SELECT g, term, round(n::DOUBLE / words * ln(1 + A / f), 9) AS score FROM c JOIN s USING (g) JOIN f USING (term), m)
SELECT g AS source, term, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, term)::INT AS rank FROM x) WHERE rank <= 10"""
)
def ctfidf_keywords(spark, sf):
    return keywords.ctfidf(table(spark, sf, "documents"), "source", "text", 10, list(STOPWORDS))


@query(
    """WITH v AS (SELECT round(consensus_score, 3) AS v, count(*)::DOUBLE AS n FROM task_statements WHERE consensus_score IS NOT NULL GROUP BY 1), t AS (SELECT sum(n) AS N, sum(n*v) AS S FROM v),
c AS (SELECT v, lag(v) OVER (ORDER BY v) AS prev, sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nl, sum(n*v) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sl FROM v)
SELECT round((v + prev) / 2, 6) AS threshold FROM c, t WHERE nl >= 2 AND N - nl >= 2 ORDER BY round(nl * (N - nl) * power(sl/nl - (S - sl)/(N - nl), 2), 6) DESC, v LIMIT 1"""
)
def otsu_threshold(spark, sf):
    return similarity.otsu(table(spark, sf, "task_statements").select(F.round("consensus_score", 3).alias("v")), "v")


_RUNS = "SELECT DISTINCT partition_id, family, n_clusters, coverage, silhouette, stability_ari, noise_share, median_size, max_size, assigned, min_size FROM final_method_comparison"


def _runs(spark, sf):
    return table(spark, sf, "final_method_comparison").select("partition_id", "family", "n_clusters", "coverage", "silhouette", "stability_ari", "noise_share", "median_size", "max_size", "assigned", "min_size").distinct()


@query(
    f"""WITH r AS ({_RUNS}) SELECT partition_id, n_clusters, median_size, round(CASE WHEN n_clusters IS NULL OR n_clusters < 20 OR median_size IS NULL THEN 0.0 WHEN median_size BETWEEN 15 AND 60 THEN 1.0 ELSE greatest(0.0, 1 - abs(ln(median_size / CASE WHEN median_size < 15 THEN 15.0 ELSE 60.0 END)) / ln(2.0)) END, 6) AS granularity,
concat_ws(';', CASE WHEN n_clusters < 20 THEN 'too_few_clusters' END, CASE WHEN coalesce(stability_ari, 0) < 0.4 THEN 'unstable' END, CASE WHEN coalesce(max_size::DOUBLE / assigned, 1) > 0.15 THEN 'dominant_cluster' END, CASE WHEN coalesce(noise_share, 0) > 0.3 THEN 'excessive_noise' END) AS flags FROM r"""
)
def partition_gates(spark, sf):
    r = _runs(spark, sf)
    why = S.flags(too_few_clusters=F.col("n_clusters") < 20, unstable=F.coalesce("stability_ari", F.lit(0.0)) < 0.4, dominant_cluster=F.coalesce(F.try_divide(F.col("max_size").cast("double"), F.col("assigned").cast("double")), F.lit(1.0)) > 0.15, excessive_noise=F.coalesce("noise_share", F.lit(0.0)) > 0.3)
    return r.select("partition_id", "n_clusters", "median_size", F.round(S.granularity(F.col("n_clusters"), F.col("median_size"), 15.0, 60.0, 20), 6).alias("granularity"), why.alias("flags"))


@query(
    f"""WITH r AS ({_RUNS}), a AS (SELECT *, max(coalesce(coverage, '-inf'::DOUBLE)) OVER () AS b FROM r), p AS (SELECT * FROM a WHERE coalesce(coverage, '-inf'::DOUBLE) >= b - 0.05), c AS (SELECT * EXCLUDE b, max(coalesce(stability_ari, '-inf'::DOUBLE)) OVER () AS b FROM p), q AS (SELECT * FROM c WHERE coalesce(stability_ari, '-inf'::DOUBLE) >= b - 0.05)
SELECT partition_id, family, n_clusters FROM q ORDER BY silhouette DESC NULLS LAST, partition_id, family, n_clusters LIMIT 1"""
)
def lexicographic_selection(spark, sf):
    ties = [F.desc_nulls_last("silhouette"), F.col("partition_id"), F.col("family"), F.asc_nulls_last("n_clusters")]
    return similarity.select_in_order(_runs(spark, sf), [("coverage", 0.05), ("stability_ari", 0.05)], ties).select("partition_id", "family", "n_clusters")


@query(f"WITH r AS ({_RUNS}) SELECT partition_id, family, n_clusters, round(CASE WHEN max(silhouette) OVER w > min(silhouette) OVER w THEN (silhouette - min(silhouette) OVER w) / (max(silhouette) OVER w - min(silhouette) OVER w) ELSE 0.5 END, 6) AS silhouette_scaled FROM r WINDOW w AS (PARTITION BY family)")
def min_max_scores(spark, sf):
    return _runs(spark, sf).select("partition_id", "family", "n_clusters", F.round(similarity.min_max(F.col("silhouette"), Window.partitionBy("family")), 6).alias("silhouette_scaled"))


@query(
    """WITH s AS (SELECT DISTINCT partition_id, n_clusters, x::BIGINT AS size FROM (SELECT partition_id, n_clusters, size_distribution, unnest(string_split(size_distribution, ';')) AS x, generate_subscripts(string_split(size_distribution, ';'), 1) AS i FROM final_method_comparison WHERE size_distribution IS NOT NULL) WHERE trim(x) <> '')
SELECT partition_id, n_clusters, min(size) AS least, max(size) AS most, round(quantile_cont(size, 0.9), 4) AS p90, count(*)::BIGINT AS distinct_sizes FROM s GROUP BY 1, 2"""
)
def cluster_size_stats(spark, sf):
    s = table(spark, sf, "final_method_comparison").where("size_distribution is not null").select("partition_id", "n_clusters", F.explode(F.split("size_distribution", ";")).alias("x")).where("trim(x) <> ''").select("partition_id", "n_clusters", F.trim("x").cast("long").alias("size")).distinct()
    return s.groupBy("partition_id", "n_clusters").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.round(F.percentile("size", F.lit(0.9)), 4).alias("p90"), F.count("*").alias("distinct_sizes"))


@query("WITH q AS (SELECT quantile_cont(support_overlap, 0.25) AS p25, quantile_cont(consensus_score, 0.5) AS p50 FROM task_statements) SELECT CASE WHEN support_overlap <= p25 AND consensus_score <= p50 THEN 'possible_gap' WHEN consensus_score > p50 THEN 'well_covered' ELSE 'partial' END AS coverage, count(*)::BIGINT AS n FROM task_statements, q GROUP BY 1")
def quantile_classes(spark, sf):
    t = table(spark, sf, "task_statements").select("support_overlap", "consensus_score")
    q = t.agg(F.percentile("support_overlap", F.lit(0.25)).alias("p25"), F.percentile("consensus_score", F.lit(0.5)).alias("p50"))
    cls = F.when((F.col("support_overlap") <= F.col("p25")) & (F.col("consensus_score") <= F.col("p50")), "possible_gap").when(F.col("consensus_score") > F.col("p50"), "well_covered").otherwise("partial")
    return t.crossJoin(F.broadcast(q)).groupBy(cls.alias("coverage")).agg(F.count("*").alias("n"))


@query(
    """WITH RECURSIVE m AS (SELECT task_statement_id AS node, min(source_statement_id) AS parent FROM task_statements WHERE source_statement_id IS NOT NULL AND source_statement_id <> task_statement_id GROUP BY 1),
e AS (SELECT node FROM m UNION SELECT parent FROM m), c AS (SELECT node, node AS place, 0 AS d FROM e UNION ALL SELECT c.node, m.parent, d + 1 FROM c JOIN m ON m.node = c.place WHERE d < 50)
SELECT node, arg_max(place, d) AS survivor FROM c GROUP BY node"""
)
def merge_chains(spark, sf):
    m = table(spark, sf, "task_statements").where("source_statement_id is not null and source_statement_id <> task_statement_id").select("task_statement_id", "source_statement_id")
    return ledger.survivors(m, "task_statement_id", "source_statement_id").select("node", "survivor")


@query()
def kmeans_topics(spark, sf):
    return cluster.kmeans(_emb(spark, sf), "vec_id", "embedding", 10)


@query()
def pca_projection(spark, sf):
    return cluster.pca(_emb(spark, sf), "vec_id", "embedding", 8)


@query()
def gmm_topics(spark, sf):
    def fit(x, mult):
        g = cluster.gmm_diagonal(x, 10, mult=mult)
        return pd.DataFrame({"cluster": g["label"].astype("int32"), "confidence": g["posterior"].max(1).round(6), "bic": round(g["bic"], 3)})

    return cluster.on_points(_emb(spark, sf), "vec_id", "embedding", fit, "cluster int, confidence double, bic double")


@query()
def density_topics(spark, sf):
    def fit(x, mult):
        lab, prob = cluster.hdbscan(x, 10, 5, mult=mult)
        return pd.DataFrame({"cluster": lab.astype("int32"), "probability": prob.round(6)})

    return cluster.on_points(_emb(spark, sf), "vec_id", "embedding", fit, "cluster int, probability double")


@query()
def community_topics(spark, sf):
    """Communities of the 10-nearest-neighbour graph nearest to 10, with their resolution."""

    def fit(x, mult):
        s = x @ x.T
        np.fill_diagonal(s, -2)
        nb = np.argsort(-s, axis=1, kind="stable")[:, :10]
        a, b = np.repeat(np.arange(len(x)), nb.shape[1]), nb.ravel()
        keep = s[a, b] > 0
        lo, hi = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
        _, first = np.unique(lo * len(x) + hi, return_index=True)
        lo, hi = lo[first], hi[first]
        lab, res = cluster.to_target(len(x), lo, hi, s[lo, hi] * np.sqrt(mult[lo] * mult[hi]), 10)
        return pd.DataFrame({"cluster": lab.astype("int32"), "resolution": round(res, 6)})

    return cluster.on_points(_emb(spark, sf), "vec_id", "embedding", fit, "cluster int, resolution double")


@query()
def partition_metrics(spark, sf):
    """Silhouette, Davies-Bouldin and Calinski-Harabasz of the given labels, over the rows or, of a larger table, over
    the prototypes of each label."""
    d = _emb(spark, sf).where("label is not null and embedding is not null").select("vec_id", "label", "embedding")
    points = d.select("label", F.lit(1).cast("long").alias("n"), F.col("embedding").cast("array<double>").alias("v"))
    if d.count() > cluster.MOST_POINTS:
        labels = max(1, d.select("label").distinct().count())
        lab, _ = cluster.prototypes(d, "vec_id", "embedding", max(2, cluster.MOST_POINTS // labels))
        points = mean_vectors(d.join(lab, "vec_id"), ["label", "cluster"], "embedding").select("label", "n", F.col("centroid").alias("v"))

    def run(pdf):
        x = np.stack(pdf["v"].to_numpy())
        m = cluster.internal_metrics(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), pdf["label"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame([{k: None if v is None else round(v, 6) for k, v in m.items()}])

    return points.groupBy().applyInPandas(run, "silhouette double, davies_bouldin double, calinski_harabasz double")


@query()
def topic_hierarchy(spark, sf):
    """Leaves (k-means prototypes) under Ward parents and average-linkage grandparents."""
    lab, cents = cluster.prototypes(_emb(spark, sf), "vec_id", "embedding", 40)

    def run(pdf):
        pdf = pdf.sort_values("cluster", ignore_index=True)
        x, n = np.stack(pdf["centroid"].to_numpy()), pdf["n"].to_numpy(float)
        mid = cluster.linkage(x, n, 12, "ward")
        top = cluster.linkage(x, n, 4, "average")
        return pd.DataFrame({"leaf": pdf["cluster"].astype("int32"), "size": pdf["n"], "level2": mid.astype("int32"), "level1": top.astype("int32")})

    return cents.groupBy().applyInPandas(run, "leaf int, size long, level2 int, level1 int")


@query()
def hungarian_match(spark, sf):
    """Clusters paired one-to-one with labels for the highest total Jaccard similarity."""
    e = _emb(spark, sf)
    c = similarity.contingency(cluster.kmeans(e, "vec_id", "embedding", 10, seeds=(1,)).join(e.select("vec_id", "label"), "vec_id"), "cluster", "label")
    na, nb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    j = c.join(na, "a").join(nb, "b").select("a", "b", (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("j"))

    def run(pdf):
        m = pdf.pivot(index="a", columns="b", values="j").fillna(0.0)
        return pd.DataFrame([(int(m.index[i]), int(m.columns[k]), round(float(m.iloc[i, k]), 6)) for i, k in cluster.assignment(m.to_numpy())], columns=["cluster", "label", "jaccard"])

    return j.groupBy().applyInPandas(run, "cluster int, label int, jaccard double")


@query()
def cluster_stability(spark, sf):
    """Agreement of fits on hash-drawn 80 % samples with the fit on all rows, and each cluster's best overlap."""
    ws = Workspace(spark, "stability")
    e = _emb(spark, sf)
    full = ws.cut(cluster.kmeans(e, "vec_id", "embedding", 10, seeds=(1,)).select("vec_id", "cluster"), "full")
    out = None
    for s in range(3):
        part = e.where(F.pmod(F.xxhash64(F.lit(s), "vec_id"), F.lit(100)) < 80)
        got = cluster.kmeans(part, "vec_id", "embedding", 10, seeds=(s + 2,)).select("vec_id", F.col("cluster").alias("other"))
        both = ws.cut(full.join(got, "vec_id"), "both")
        ari = similarity.agreement(both, "cluster", "other").select("ari")
        best = similarity.best_overlap(both, "cluster", "other").select("cluster", "jaccard").crossJoin(ari).withColumn("run", F.lit(s))
        out = best if out is None else out.union(best)
    return out.groupBy("cluster").agg(F.round(F.percentile("jaccard", F.lit(0.5)), 6).alias("persistence"), F.round(F.avg("ari"), 6).alias("mean_ari"), F.count("*").alias("runs"))


@query()
def co_association(spark, sf):
    """How often each row's cluster mates stay its mates over several fits: core, boundary or outside."""
    ws = Workspace(spark, "co-association")
    e = _emb(spark, sf)
    runs = None
    for s in (1, 2, 3):
        r = cluster.kmeans(e, "vec_id", "embedding", 10, seeds=(s,)).select("vec_id", "cluster", F.lit(s).alias("run"))
        runs = r if runs is None else runs.union(r)
    wide = ws.cut(runs.groupBy("vec_id").pivot("run", [1, 2, 3]).agg(F.first("cluster")).toDF("vec_id", "r1", "r2", "r3"), "wide")
    # mates are counted by joint labels: a table of labels, never of pairs of rows
    joint = wide.groupBy("r1", "r2", "r3").agg(F.count("*").alias("n"))
    a, b = joint.toDF("a1", "a2", "a3", "na"), joint.toDF("r1", "b2", "b3", "nb")
    mates = a.join(b, F.col("a1") == F.col("r1")).withColumn("share", (1 + (F.col("a2") == F.col("b2")).cast("int") + (F.col("a3") == F.col("b3")).cast("int")) / 3)
    mean = mates.groupBy("a1", "a2", "a3").agg((F.sum(F.col("share") * F.col("nb")) / F.sum("nb")).alias("share"))
    got = wide.join(mean, (F.col("r1") == F.col("a1")) & (F.col("r2") == F.col("a2")) & (F.col("r3") == F.col("a3")))
    return got.select("vec_id", F.round("share", 6).alias("share"), F.when(F.col("share") >= 2 / 3, "core").when(F.col("share") >= 1 / 3, "boundary").otherwise("outside").alias("kind"))


@query()
def farthest_point_prototypes(spark, sf):
    def fit(x, mult):
        at, radius = cluster.farthest_points(x, 60)
        k = cluster.knee(radius)
        near = cluster.balanced(x @ x[at].T, -(-int(mult.sum()) // len(at)), mult)
        return pd.DataFrame({"region": near.astype("int32"), "is_prototype": np.isin(np.arange(len(x)), at), "knee": np.full(len(x), k, "int32")})

    return cluster.on_points(_emb(spark, sf), "vec_id", "embedding", fit, "region int, is_prototype boolean, knee int")
