"""Corpus queries: canonical postings, duplicates, profiles, samples, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import text as T
from quarrymill.operators import dedup, profile, sampling, sections
from quarrymill.plans.registry import query
from quarrymill.runtime import table

KEY_SQL = "concat_ws('|', coalesce(regexp_replace(lower(job_title),'[^a-z0-9]+','','g'),''), coalesce(regexp_replace(lower(company_name),'[^a-z0-9]+','','g'),''), coalesce(regexp_replace(lower(description),'[^a-z0-9]+','','g'),''))"
STATS = "count({c})::BIGINT AS {p}_n, round(avg({c}),4) AS {p}_mean, round(quantile_cont({c},0.5),4) AS {p}_median, round(stddev_samp({c}),4) AS {p}_std, min({c})::DOUBLE AS {p}_min, round(quantile_cont({c},0.05),4) AS {p}_p05, round(quantile_cont({c},0.25),4) AS {p}_p25, round(quantile_cont({c},0.75),4) AS {p}_p75, round(quantile_cont({c},0.95),4) AS {p}_p95, max({c})::DOUBLE AS {p}_max"


@query(
    f"""SELECT CASE WHEN grouping(s)=1 THEN 'ALL' ELSE s END AS source, count(*)::BIGINT AS postings, count(DISTINCT posting_id)::BIGINT AS ids,
count(DISTINCT job_title)::BIGINT AS titles, count(*) FILTER (WHERE description IS NULL OR description_char_count < 200)::BIGINT AS short_or_none,
sum(CASE WHEN remote_flag THEN 1 ELSE 0 END)::BIGINT AS remote, {STATS.format(c='description_char_count', p='chars')}
FROM (SELECT *, coalesce(source,'(null)') AS s FROM job_postings) GROUP BY ROLLUP(s)"""
)
def corpus_profile(spark, sf):
    d = table(spark, sf, "job_postings")
    aggs = [F.count("*").alias("postings"), F.count_distinct("posting_id").alias("ids"), F.count_distinct("job_title").alias("titles"), F.count_if(F.col("description").isNull() | (F.col("description_char_count") < 200)).alias("short_or_none"), F.count_if(F.col("remote_flag")).alias("remote")]
    return profile.profile(d, "source", aggs + profile.describe(F.col("description_char_count"), "chars"))


@query("SELECT posting_id, max(retrieval_id) AS retrieval_id, count(*)::BIGINT AS deliveries, count(DISTINCT description)::BIGINT AS versions FROM job_postings GROUP BY posting_id")
def canonical_latest(spark, sf):
    d = table(spark, sf, "job_postings")
    n = d.groupBy("posting_id").agg(F.count("*").alias("deliveries"), F.count_distinct("description").alias("versions"))
    last = dedup.keep_first(d.select("posting_id", "retrieval_id", "description"), ["posting_id"], [F.desc("retrieval_id"), F.asc_nulls_last("description")])
    return last.select("posting_id", "retrieval_id").join(n, "posting_id")


@query(
    f"""WITH k AS (SELECT DISTINCT source, posting_id, {KEY_SQL} AS key, date_posted FROM job_postings),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source ASC NULLS LAST, date_posted ASC NULLS LAST, posting_id) AS r,
first_value(posting_id) OVER (PARTITION BY key ORDER BY source ASC NULLS LAST, date_posted ASC NULLS LAST, posting_id) AS lead FROM k)
SELECT source, count(*)::BIGINT AS n, sum(CASE WHEN r > 1 AND key <> '||' THEN 1 ELSE 0 END)::BIGINT AS duplicates, count(DISTINCT CASE WHEN key <> '||' THEN lead END)::BIGINT AS leaders FROM o GROUP BY source"""
)
def duplicate_flags(spark, sf):
    d = table(spark, sf, "job_postings").select("source", "posting_id", "date_posted", F.nullif(T.ascii_key(F.col("job_title"), F.col("company_name"), F.col("description")), F.lit("||")).alias("k")).distinct()
    f = dedup.flag_duplicates(d, F.col("k"), [F.col("source"), F.col("date_posted")], "posting_id", "normalized")
    return f.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("is_normalized_duplicate").cast("int")).alias("duplicates"), F.count_distinct("normalized_group").alias("leaders"))


@query(
    """SELECT source, count(*)::BIGINT AS n, count(DISTINCT exact_dup_key)::BIGINT AS keys, round(1 - count(DISTINCT exact_dup_key)::DOUBLE / count(*), 6) AS duplicate_rate,
sum(CASE WHEN is_source_id_repeat THEN 1 ELSE 0 END)::BIGINT AS id_repeats, round(avg(CASE WHEN salary_min IS NULL THEN 0.0 ELSE 1.0 END), 6) AS salary_rate FROM job_postings GROUP BY ALL"""
)
def duplicate_rate_by_source(spark, sf):
    return table(spark, sf, "job_postings").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("exact_dup_key").alias("keys"), F.round(1 - F.count_distinct("exact_dup_key") / F.count("*"), 6).alias("duplicate_rate"), F.count_if(F.col("is_source_id_repeat")).alias("id_repeats"), F.round(F.avg(F.col("salary_min").isNotNull().cast("double")), 6).alias("salary_rate"))


_FIELDS = ["job_title", "company_name", "description", "date_posted", "language", "salary_min", "city", "seniority", "responsibilities", "requirements"]


@query(" UNION ALL ".join(f"SELECT source, '{f}' AS field, round(avg(({f} IS NULL)::INT), 6) AS rate FROM job_postings GROUP BY source" for f in _FIELDS))
def null_rate_matrix(spark, sf):
    return profile.null_rates(table(spark, sf, "job_postings"), "source", _FIELDS)


@query("SELECT lang, doc_type, count(*)::BIGINT AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_type), 6) AS share FROM documents GROUP BY lang, doc_type")
def language_mix(spark, sf):
    return profile.shares(table(spark, sf, "documents"), ["lang", "doc_type"], ["doc_type"])


@query("SELECT source, company_name, n, rank FROM (SELECT source, company_name, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, company_name)::INT AS rank FROM documents WHERE company_name IS NOT NULL GROUP BY source, company_name) WHERE rank <= 8")
def top_companies_by_source(spark, sf):
    return profile.top_n(table(spark, sf, "documents"), "source", "company_name", 8)


@query("SELECT job_title, count(*)::BIGINT AS n FROM job_postings WHERE job_title IS NOT NULL GROUP BY 1 ORDER BY n DESC, job_title LIMIT 25")
def top_titles(spark, sf):
    return table(spark, sf, "job_postings").where("job_title is not null").groupBy("job_title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "job_title").limit(25)


@query("SELECT posting_id, count(DISTINCT description)::BIGINT AS versions, count(DISTINCT retrieval_id)::BIGINT AS snapshots FROM job_postings GROUP BY posting_id HAVING count(DISTINCT description) > 1")
def edited_postings(spark, sf):
    return table(spark, sf, "job_postings").groupBy("posting_id").agg(F.count_distinct("description").alias("versions"), F.count_distinct("retrieval_id").alias("snapshots")).where("versions > 1")


@query("SELECT source, string_agg(DISTINCT language, ';' ORDER BY language) AS languages, any_value(contract_version) AS contract_version, min(date_collected) AS first_collected FROM job_postings GROUP BY source")
def languages_per_source(spark, sf):
    table(spark, sf, "job_postings").createOrReplaceTempView("_postings")
    return spark.sql("SELECT source, listagg(DISTINCT language, ';') WITHIN GROUP (ORDER BY language) AS languages, any_value(contract_version) AS contract_version, min(date_collected) AS first_collected FROM _postings GROUP BY source")


@query("SELECT strftime(date_trunc('month', date_posted), '%Y-%m') AS month, count(*)::BIGINT AS n, count(DISTINCT company_name)::BIGINT AS companies FROM job_postings WHERE date_posted IS NOT NULL GROUP BY 1")
def monthly_postings(spark, sf):
    return table(spark, sf, "job_postings").where("date_posted is not null").groupBy(F.date_format(F.trunc("date_posted", "month"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("company_name").alias("companies"))


@query(
    "SELECT source, min(date_posted) AS first, max(date_posted) AS last, (DATE '1970-01-01' + floor(quantile_cont(date_posted - DATE '1970-01-01', 0.5))::INT)::DATE AS middle, count(*) FILTER (WHERE date_posted IS NULL)::BIGINT AS missing FROM job_postings GROUP BY source"
)
def date_coverage(spark, sf):
    return profile.date_span(table(spark, sf, "job_postings"), "source", "date_posted")


_LEVELS = ["entry", "experienced", "senior", "manager", "executive", "intern_student"]


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE seniority = '{v}')::BIGINT AS {v}" for v in _LEVELS) + ", count(*)::BIGINT AS total FROM job_postings GROUP BY source")
def seniority_crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "job_postings"), "source", "seniority", _LEVELS)


@query(
    """WITH r AS (SELECT DISTINCT source, posting_id, description_word_count FROM job_postings WHERE description_word_count IS NOT NULL AND retrieval_id = (SELECT max(retrieval_id) FROM job_postings)),
q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY description_word_count, posting_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM r)
SELECT source, tercile, count(*)::BIGINT AS n, min(description_word_count)::INT AS least, max(description_word_count)::INT AS most FROM (SELECT *, CASE WHEN 3*(r-1) < n-1 THEN 'short' WHEN 3*(r-1) < 2*(n-1) THEN 'medium' ELSE 'long' END AS tercile FROM q) GROUP BY source, tercile"""
)
def length_terciles(spark, sf):
    from quarrymill.sources.files import newest

    d = newest(table(spark, sf, "job_postings"), "retrieval_id").select("source", "posting_id", "description_word_count").distinct()
    return sampling.tercile(d, "source", "description_word_count", "posting_id").groupBy("source", "tercile").agg(F.count("*").alias("n"), F.min("description_word_count").alias("least"), F.max("description_word_count").alias("most"))


@query("SELECT doc_id, source, sha256('seed-1|' || doc_id::VARCHAR) AS hash_order FROM documents ORDER BY hash_order, doc_id LIMIT 200")
def hash_ordered_sample(spark, sf):
    return sampling.hash_sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 200, "seed-1")


@query(
    """WITH d AS (SELECT doc_id, source, doc_type, sha256('seed-2|' || doc_id::VARCHAR) AS h FROM documents WHERE doc_type IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_type ORDER BY h, doc_id) = 1 AS is_first FROM d)
SELECT source, doc_id, doc_type, pick FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY is_first DESC, h, doc_id)::INT AS pick FROM f) WHERE pick <= 12"""
)
def coverage_first_sample(spark, sf):
    d = table(spark, sf, "documents").where("doc_type is not null").select("source", "doc_id", "doc_type")
    return sampling.coverage_first(d, "source", "doc_type", "doc_id", 12, "seed-2").select("source", "doc_id", "doc_type", "pick")


@query()
def stratified_round_robin(spark, sf):
    d = sampling.tercile(table(spark, sf, "job_postings").where("language = 'en'").select("source", "posting_id", "normalized_job_title", "seniority", "description_word_count").distinct(), "source", "description_word_count", "posting_id", "length")
    return sampling.round_robin(d, "source", ["seniority", "length"], "normalized_job_title", "posting_id", 50, "seed-3").select("source", "sample_rank", "posting_id", "stratum")


@query(
    """WITH c AS (SELECT *, CASE WHEN job_title IS NULL THEN 'no_title' WHEN description IS NULL THEN 'no_description' WHEN date_posted > date_collected THEN 'future_date' WHEN language IS NULL THEN 'no_language' END AS category FROM (SELECT DISTINCT posting_id, job_title, description, date_posted, date_collected, language FROM job_postings)),
g AS (SELECT category, posting_id, min(sha256('seed-4|' || posting_id)) AS h FROM c WHERE category IS NOT NULL GROUP BY category, posting_id)
SELECT category, posting_id FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY h, posting_id) AS pick FROM g) WHERE pick <= CASE category WHEN 'no_title' THEN 10 WHEN 'no_description' THEN 20 WHEN 'future_date' THEN 30 ELSE 5 END"""
)
def review_quota_sample(spark, sf):
    d = table(spark, sf, "job_postings").select("posting_id", "job_title", "description", "date_posted", "date_collected", "language").distinct()
    rules = [("no_title", F.col("job_title").isNull(), 10), ("no_description", F.col("description").isNull(), 20), ("future_date", F.col("date_posted") > F.col("date_collected"), 30), ("no_language", F.col("language").isNull(), 5)]
    name = F
    for n, c, _ in rules:
        name = name.when(c, F.lit(n))
    one = d.withColumn("c", name.otherwise(None)).where("c is not null").select("c", "posting_id").distinct()
    return sampling.quota_sample(one, [(n, F.col("c") == n, q) for n, _, q in rules], "posting_id", "seed-4").select("category", "posting_id")


@query()
def canonical_text(spark, sf):
    """HTML, entities and blanks cleaned; normal title, key, hash id, level with its basis."""
    d = table(spark, sf, "job_postings")
    derived = T.level_of_title(F.col("job_title"))
    return d.select("posting_id", "retrieval_id", T.clean(F.col("description")).alias("description"), T.normal_title(F.col("job_title")).alias("title"), T.hash_id(T.dup_key(F.col("job_title"), F.col("company_name"))).alias("key_hash"), T.level_and_basis(F.col("seniority_source"), derived).alias("s")).select("posting_id", "retrieval_id", F.length("description").alias("chars"), T.word_count(F.col("description")).alias("words"), "title", "key_hash", "s.level", "s.basis")


@query("SELECT source, source_job_id, posting_id, substr(sha256(source || '|' || source_job_id), 1, 20) AS derived_id FROM (SELECT DISTINCT source, source_job_id, posting_id FROM job_postings WHERE source_job_id IS NOT NULL)")
def hash_ids(spark, sf):
    return table(spark, sf, "job_postings").where("source_job_id is not null and source is not null").select("source", "source_job_id", "posting_id").distinct().withColumn("derived_id", T.hash_id(F.col("source"), F.col("source_job_id")))


@query(
    r"""SELECT CASE WHEN regexp_matches(lower(job_title), '\b(intern|internship|praktikum|praktikant\w*|werkstudent\w*|working student|student)\b') THEN 'intern_student'
WHEN regexp_matches(lower(job_title), '\b(chief|vp|vice president|cxo|ceo|cto|cfo|coo|commissioner|executive director|geschäftsführ\w*)\b') THEN 'executive'
WHEN regexp_matches(lower(job_title), '\b(director|head of|leiter\w*|leitung)\b') THEN 'manager' WHEN regexp_matches(lower(job_title), '\b(manager|supervisor|team lead|teamleiter\w*)\b') THEN 'manager'
WHEN regexp_matches(lower(job_title), '\b(senior|sr\.?|principal|staff|lead|expert)\b') THEN 'senior' WHEN regexp_matches(lower(job_title), '\b(junior|jr\.?|entry[- ]level|graduate|trainee|associate|assistant|einsteiger\w*)\b') THEN 'entry' END AS level, count(*)::BIGINT AS n FROM job_postings GROUP BY 1"""
)
def level_of_titles(spark, sf):
    return table(spark, sf, "job_postings").groupBy(T.level_of_title(F.col("job_title")).alias("level")).agg(F.count("*").alias("n"))


@query()
def section_spans(spark, sf):
    return sections.detect(table(spark, sf, "job_postings"), ["posting_id", "retrieval_id"], "description", {"requirements": "requirements", "preferred_skills": "preferred_qualifications"})


@query()
def reading_inputs(spark, sf):
    """Sections by priority for a reader of 2,000 characters."""
    d = table(spark, sf, "job_postings").where("description is not null")
    cut = F.transform(sections.section_spans(F.col("description")), lambda s: F.struct(s["section"].alias("section"), F.trim(F.substr("description", s["start"] + 1, s["end"] - s["start"])).alias("text")))
    return d.select("posting_id", "retrieval_id", sections.reading_input(cut, 2000).alias("input")).withColumn("estimate", T.token_estimate(F.col("input")))


@query("SELECT coalesce(a.posting_id, b.posting_id) AS posting_id, CASE WHEN a.posting_id IS NULL THEN 'added' WHEN b.posting_id IS NULL THEN 'removed' WHEN a.t IS NOT DISTINCT FROM b.t AND a.d IS NOT DISTINCT FROM b.d THEN 'same' ELSE 'changed' END AS status FROM (SELECT posting_id, max(job_title) AS t, max(description) AS d FROM job_postings WHERE retrieval_id = (SELECT min(retrieval_id) FROM job_postings) GROUP BY 1) a FULL JOIN (SELECT posting_id, max(job_title) AS t, max(description) AS d FROM job_postings WHERE retrieval_id = (SELECT max(retrieval_id) FROM job_postings) GROUP BY 1) b ON a.posting_id = b.posting_id")
def snapshot_changes(spark, sf):
    d = table(spark, sf, "job_postings")
    ends = d.agg(F.min("retrieval_id").alias("a"), F.max("retrieval_id").alias("b")).first()
    side = lambda r: d.where(F.col("retrieval_id") == F.lit(r)).groupBy("posting_id").agg(F.max("job_title").alias("t"), F.max("description").alias("d"))
    return dedup.changed(side(ends["a"]), side(ends["b"]), "posting_id", ["t", "d"])


@query("SELECT concept_uri, preferred_label, trim(alt) AS alt_label FROM (SELECT concept_uri, preferred_label, unnest(string_split(alt_labels, chr(10))) AS alt FROM esco_occupations) WHERE trim(alt) <> ''")
def alternative_labels(spark, sf):
    d = table(spark, sf, "esco_occupations").select("concept_uri", "preferred_label", F.explode(F.split("alt_labels", "\n")).alias("alt"))
    return d.select("concept_uri", "preferred_label", F.trim("alt").alias("alt_label")).where("alt_label <> ''")


@query()
def keyed_contract(spark, sf):
    """Schema inventory of the input tables."""
    from quarrymill.sources.files import schema_inventory

    return schema_inventory({t: table(spark, sf, t) for t in ("job_postings", "task_statements", "documents", "emb", "esco_occupations", "onet_task_statements")})


@query("SELECT source, round(percentile_disc, 0) AS middle_salary, n FROM (SELECT source, quantile_cont((salary_min + salary_max) / 2, 0.5) AS percentile_disc, count(*)::BIGINT AS n FROM job_postings WHERE salary_min IS NOT NULL AND salary_max IS NOT NULL GROUP BY source)")
def salary_middle(spark, sf):
    mid = (F.col("salary_min") + F.col("salary_max")) / 2
    return table(spark, sf, "job_postings").where("salary_min is not null and salary_max is not null").groupBy("source").agg(F.round(F.percentile(mid, F.lit(0.5)), 0).alias("middle_salary"), F.count("*").alias("n"))
