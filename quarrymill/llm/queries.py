"""The pN_ queries: each runs its operator with production parameters over the whole of its tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.llm import boilerplate, canonical, clusters, formatting, languages, linkage, markup, mixing, neighbours, packing, spans
from quarrymill.runtime import table

MODEL = "workvec-base-v2"
FIELDS = ["job_title", "company_name", "description"]

QUERIES: dict = {}
ORACLE: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.found(table(spark, sf_dir, "emb"), MODEL)


@query
def p1_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.Clusters(table(spark, sf_dir, "emb"), MODEL).described()


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "emb"), MODEL)


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_spans(table(spark, sf_dir, "documents"))


@query
def p10_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spans.shared_share(docs, spans.shared_spans(docs))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = formatting.copies(table(spark, sf_dir, "job_postings"), "posting_id", FIELDS, "description")
    return got.select(got["leader"].alias("posting_id_a"), got["id"].alias("posting_id_b"))


@query
def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapsed(table(spark, sf_dir, "job_postings"), "posting_id", FIELDS, "description")


def _ingested(history: linkage.History, postings: DataFrame) -> DataFrame:
    return history.ingest(postings, "posting_id", "retrieval_id", "description", "job_title", "company_name")


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot checked against the persisted history of all earlier ones."""
    return _ingested(linkage.History(spark), table(spark, sf_dir, "job_postings")).where("seen").select("retrieval_id", "posting_id")


@query
def p5_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot, checked against a history that holds all others already, with its link scores."""
    postings = table(spark, sf_dir, "job_postings")
    newest = postings.agg(F.max("retrieval_id")).first()[0]
    history = linkage.History(spark)
    _ingested(history, postings.where(F.col("retrieval_id") < newest))
    return _ingested(history, postings.where(F.col("retrieval_id") == newest))


@query
def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = linkage.History(spark)
    _ingested(history, table(spark, sf_dir, "job_postings"))
    return history.clusters().withColumnRenamed("id", "posting_id")


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.residue(table(spark, sf_dir, "job_postings"), "posting_id", ["description", "job_title"])


@query
def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(table(spark, sf_dir, "job_postings"), ["posting_id", "retrieval_id"], ["job_title", "description"])


def _language_model(postings: DataFrame) -> languages.CentroidModel:
    return languages.train(postings, "posting_text", "language", "job_title")


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = table(spark, sf_dir, "job_postings").where("description is not null")
    return languages.mislabelled(postings, "posting_id", "posting_text", "language", "job_title", _language_model(postings))


@query
def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings = table(spark, sf_dir, "job_postings")
    got = languages.languages(postings, "posting_id", "posting_text", "language", "job_title", _language_model(postings))
    return got.selectExpr("posting_id", "label", "lang", "confidence", "array_join(langs, ';') as langs", "size(segments) as n_segments")


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    occupations = canonical.LabelMatcher(canonical.entries_of(table(spark, sf_dir, "esco_occupations"), "concept_uri", "preferred_label", "alt_labels"))
    tasks = canonical.TaskMatcher(canonical.entries_of(table(spark, sf_dir, "onet_task_statements").selectExpr("cast(task_id as string) task_id", "task"), "task_id", "task"))
    titles = table(spark, sf_dir, "job_postings").where("job_title is not null").selectExpr("posting_id", "coalesce(normalized_job_title, job_title) as title")
    a = canonical.mapped(titles, "posting_id", "title", occupations, "job_title")
    b = canonical.mapped(table(spark, sf_dir, "task_statements"), "task_statement_id", "atomic_task", tasks, "atomic_task")
    return a.union(b)


@query
def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct job title with the nearest label within two edits, over a list in shards."""
    labels = table(spark, sf_dir, "esco_occupations").select(F.explode(F.split(F.concat_ws("\n", "preferred_label", "alt_labels"), "\n")).alias("label")).select(F.lower(F.trim("label")).alias("label")).where("label <> ''")
    titles = table(spark, sf_dir, "job_postings").select(F.lower(F.trim(F.coalesce("normalized_job_title", "job_title"))).alias("title"))
    return canonical.match_values(titles, "title", labels, "label", 2, shard_entries=1000)


@query
def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = table(spark, sf_dir, "container_specs")
    return packing.fill_report(packing.pack(table(spark, sf_dir, "documents"), specs), specs)


@query
def p9_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


@query
def p6_unique_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is one delivered version of a posting: a distinct (posting_id, company_name, description)."""
    d = table(spark, sf_dir, "job_postings").where("description is not null").select("posting_id", "company_name", "description").distinct()
    # nulls are left out of the JSON, so a missing name is not an empty one
    d = d.withColumn("page", F.sha2(F.to_json(F.struct("posting_id", "company_name", "description")), 256))
    got = boilerplate.unique_runs(d.withColumn("page", F.struct("posting_id", "page")), "company_name", "page", "description")
    return got.select("page.posting_id", "page.page", "n_tokens", "boilerplate_tokens", "unique_text")


def _sql(name: str, text: str) -> None:
    ORACLE[name] = text


_USABLE = f"WITH u AS (SELECT k, v::DOUBLE[] AS v FROM emb WHERE model = '{MODEL}' AND len(v) = dims AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0)))"

_sql(
    "p3_found",
    _USABLE
    + """, s AS (SELECT a.k AS a, b.k AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= 0.70),
r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s) SELECT DISTINCT least(a, b) AS k_a, greatest(a, b) AS k_b FROM r WHERE r <= 5""",
)

_sql(
    "p1_found",
    _USABLE.replace("WITH", "WITH RECURSIVE")
    + """, e AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.k <> b.k WHERE list_cosine_similarity(a.v, b.v) >= 0.70),
c AS (SELECT a AS k, a AS r FROM e UNION SELECT c.k, e.b FROM c JOIN e ON e.a = c.r) SELECT k, min(r) AS cluster_key FROM c GROUP BY k""",
)

_sql(
    "p10_found",
    """WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) >= 200), w AS (SELECT doc_id, i, hash(substr(text, i + 1, 200)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 199)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), p AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM s)),
g AS (SELECT doc_id, i, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS n FROM p))
SELECT doc_id, min(i)::INT AS span_start, (max(i) + 200)::INT AS span_end FROM g GROUP BY doc_id, run""",
)

_KEY = "list_aggregate(list_sort([regexp_replace(lower(nfc_normalize(coalesce(job_title,''))), '[^\\p{L}\\p{N}]+', '', 'g'), regexp_replace(lower(nfc_normalize(coalesce(company_name,''))), '[^\\p{L}\\p{N}]+', '', 'g'), regexp_replace(lower(nfc_normalize(coalesce(description,''))), '[^\\p{L}\\p{N}]+', '', 'g')]), 'string_agg', '|')"

_sql(
    "p4_found",
    f"""WITH RECURSIVE k AS (SELECT DISTINCT posting_id, {_KEY} AS key FROM job_postings WHERE description IS NOT NULL), e AS (SELECT DISTINCT x.posting_id AS a, y.posting_id AS b FROM k x JOIN k y ON x.key = y.key AND x.posting_id <> y.posting_id),
c AS (SELECT a AS k, a AS r FROM e UNION SELECT c.k, e.b FROM c JOIN e ON e.a = c.r), m AS (SELECT k, min(r) AS lead FROM c GROUP BY k) SELECT lead AS posting_id_a, k AS posting_id_b FROM m WHERE k <> lead""",
)

_sql(
    "p5_found",
    """WITH t AS (SELECT posting_id, retrieval_id, description, regexp_extract_all(lower(nfc_normalize(description)), '[\\p{L}\\p{N}]+') AS w FROM job_postings),
x AS (SELECT DISTINCT description, w FROM t WHERE len(w) >= 3), i AS (SELECT row_number() OVER () AS id, description, w FROM x),
sh AS (SELECT DISTINCT id, w[j] || ' ' || w[j+1] || ' ' || w[j+2] AS s FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS j FROM i)), n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, count(*) AS o FROM sh a JOIN sh b USING (s) GROUP BY 1, 2), near AS (SELECT a, b FROM o JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE o >= 0.6 * (na.n + nb.n - o) - 1e-9),
f AS (SELECT i.id, min(t.retrieval_id) AS first FROM t JOIN i ON t.description = i.description GROUP BY 1), e AS (SELECT a, min(first) AS first FROM near JOIN f ON f.id = b GROUP BY a),
p AS (SELECT posting_id, min(retrieval_id) AS first FROM t GROUP BY 1)
SELECT DISTINCT t.retrieval_id, t.posting_id FROM t LEFT JOIN i ON t.description = i.description LEFT JOIN e ON e.a = i.id JOIN p ON p.posting_id = t.posting_id WHERE t.retrieval_id > p.first OR t.retrieval_id > e.first""",
)
