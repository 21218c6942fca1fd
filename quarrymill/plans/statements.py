"""Statement queries: lineage, evidence, gates, consensus, matching, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions import text as T
from quarrymill.operators import matching, sampling
from quarrymill.plans.registry import query
from quarrymill.runtime import Workspace, table


@query(
    """SELECT s.provider, s.experiment_arm, count(*)::BIGINT AS n, count(p.posting_id)::BIGINT AS with_posting, min(f.first_seen) AS first_seen FROM task_statements s
LEFT JOIN (SELECT posting_id, provider, atomic_task, min(extraction_timestamp) AS first_seen FROM task_statements GROUP BY 1,2,3) f ON s.posting_id = f.posting_id AND s.provider = f.provider AND s.atomic_task = f.atomic_task
LEFT JOIN (SELECT DISTINCT posting_id FROM job_postings) p ON s.posting_id = p.posting_id GROUP BY 1, 2"""
)
def statement_lineage(spark, sf):
    s = table(spark, sf, "task_statements").select("posting_id", "provider", "atomic_task", "experiment_arm", "extraction_timestamp")
    f = s.groupBy("posting_id", "provider", "atomic_task").agg(F.min("extraction_timestamp").alias("first_seen"))
    p = table(spark, sf, "job_postings").select("posting_id").distinct().withColumn("has", F.lit(1))
    return s.join(f, ["posting_id", "provider", "atomic_task"], "left").join(p, "posting_id", "left").groupBy("provider", "experiment_arm").agg(F.count("*").alias("n"), F.count("has").alias("with_posting"), F.min("first_seen").alias("first_seen"))


@query(
    """WITH v AS (SELECT DISTINCT posting_id, posting_text FROM job_postings WHERE posting_text IS NOT NULL),
s AS (SELECT DISTINCT task_statement_id, posting_id, evidence_span, evidence_start, evidence_end FROM task_statements WHERE evidence_span IS NOT NULL)
SELECT s.task_statement_id, max(CASE WHEN substr(v.posting_text, s.evidence_start + 1, s.evidence_end - s.evidence_start) = s.evidence_span THEN 1 ELSE 0 END)::INT AS at_offsets,
max(CASE WHEN contains(v.posting_text, s.evidence_span) THEN 1 ELSE 0 END)::INT AS anywhere, count(*)::BIGINT AS versions FROM s JOIN v USING (posting_id) GROUP BY 1"""
)
def evidence_at_offsets(spark, sf):
    v = table(spark, sf, "job_postings").where("posting_text is not null").select("posting_id", "posting_text").distinct()
    s = table(spark, sf, "task_statements").where("evidence_span is not null").select("task_statement_id", "posting_id", "evidence_span", "evidence_start", "evidence_end").distinct()
    at = F.substr("posting_text", F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start")) == F.col("evidence_span")
    return s.join(v, "posting_id").groupBy("task_statement_id").agg(F.max(F.when(at, 1).otherwise(0)).alias("at_offsets"), F.max(F.contains("posting_text", "evidence_span").cast("int")).alias("anywhere"), F.count("*").alias("versions"))


@query()
def evidence_located(spark, sf):
    """Exact, normalized or fuzzy places of all evidence, the best over the delivered versions of its posting."""
    v = table(spark, sf, "job_postings").where("posting_text is not null").select("posting_id", "posting_text").distinct()
    s = table(spark, sf, "task_statements").where("evidence_span is not null").select("task_statement_id", "posting_id", "evidence_span").distinct()
    d = s.join(v, "posting_id")
    # what the JVM finds exactly never goes to Python
    exact = F.expr("instr(posting_text, trim(evidence_span))")
    hit = d.withColumn("at", exact)
    a = hit.where("at > 0").select("task_statement_id", F.struct(F.lit(3).alias("o"), F.lit("exact").alias("match_type"), (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length(F.trim("evidence_span"))).alias("end")).alias("b"))
    b = hit.where("at = 0").select("task_statement_id", T.located("posting_text", "evidence_span").alias("l")).select("task_statement_id", F.struct(F.when(F.col("l.match_type") == "normalized", 2).when(F.col("l.match_type") == "fuzzy", 1).otherwise(0).alias("o"), F.col("l.match_type").alias("match_type"), F.col("l.start").alias("start"), F.col("l.end").alias("end")).alias("b"))
    return a.union(b).groupBy("task_statement_id").agg(F.max("b").alias("b")).select("task_statement_id", "b.match_type", F.col("b.start").alias("evidence_start"), F.col("b.end").alias("evidence_end"))


@query(
    """SELECT gate, count(*)::BIGINT AS n FROM (SELECT CASE WHEN evidence_match_type = 'none' THEN 'rejected_evidence_not_found' WHEN support_overlap < 0.34 THEN 'rejected_unsupported_statement' WHEN r > 1 THEN 'rejected_duplicate_in_output' ELSE 'accepted' END AS gate FROM
(SELECT evidence_match_type, support_overlap, row_number() OVER (PARTITION BY posting_id, provider, lower(trim(atomic_task)) ORDER BY task_statement_id) AS r FROM (SELECT DISTINCT task_statement_id, posting_id, provider, atomic_task, evidence_match_type, support_overlap FROM task_statements WHERE atomic_task IS NOT NULL))) GROUP BY 1"""
)
def gate_status(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "task_statements").where("atomic_task is not null").select("task_statement_id", "posting_id", "provider", "atomic_task", "evidence_match_type", "support_overlap").distinct()
    w = Window.partitionBy("posting_id", "provider", F.lower(F.trim("atomic_task"))).orderBy("task_statement_id")
    return s.withColumn("r", F.row_number().over(w)).groupBy(S.gate(F.col("evidence_match_type"), F.col("support_overlap"), F.col("r") > 1).alias("gate")).agg(F.count("*").alias("n"))


_SCORE = "round(0.35 * CASE evidence_match_type WHEN 'exact' THEN 1.0 WHEN 'normalized' THEN 0.9 WHEN 'fuzzy' THEN 0.5 ELSE 0.0 END + 0.40 * CASE a WHEN 'lexical' THEN 1.0 WHEN 'semantic' THEN 0.8 WHEN 'boundary' THEN 0.5 WHEN 'validator_confirmed' THEN 0.6 ELSE 0.25 END + 0.15 * coalesce(support_overlap, 0.0) + 0.10 * CASE WHEN disagreement_type = 'kind_conflict' THEN 0.0 ELSE 1.0 END, 3)"


@query(
    f"""SELECT tier, count(*)::BIGINT AS n, round(avg(score), 4) AS mean_score FROM (SELECT score, CASE WHEN score >= 0.80 AND a IN ('lexical','semantic') THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS tier FROM
(SELECT {_SCORE} AS score, a FROM (SELECT *, CASE agreement_status WHEN 'lexical_agree' THEN 'lexical' WHEN 'semantic_agree' THEN 'semantic' ELSE CASE WHEN disagreement_type = 'boundary' THEN 'boundary' ELSE 'single_model' END END AS a FROM task_statements))) GROUP BY 1"""
)
def consensus_tiers(spark, sf):
    d = table(spark, sf, "task_statements").withColumn("a", F.when(F.col("agreement_status") == "lexical_agree", "lexical").when(F.col("agreement_status") == "semantic_agree", "semantic").when(F.col("disagreement_type") == "boundary", "boundary").otherwise("single_model"))
    d = d.withColumn("score", S.consensus_score(F.col("evidence_match_type"), F.col("a"), F.col("support_overlap"), F.col("disagreement_type").eqNullSafe("kind_conflict")))
    return d.groupBy(S.consensus_tier(F.col("score"), F.col("a")).alias("tier")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(
    """WITH s AS (SELECT DISTINCT task_statement_id, posting_id, evidence_start AS a, evidence_end AS b FROM task_statements WHERE evidence_start IS NOT NULL AND evidence_end IS NOT NULL)
SELECT x.task_statement_id, x.posting_id, x.a AS evidence_start, x.b AS evidence_end, CASE WHEN x.b > x.a THEN (SELECT count(*) FROM s y WHERE y.posting_id = x.posting_id AND y.b > y.a AND y.a < x.b AND x.a < y.b) - 1 ELSE 0 END::BIGINT AS n_overlaps FROM s x"""
)
def overlapping_evidence(spark, sf):
    s = table(spark, sf, "task_statements").where("evidence_start is not null and evidence_end is not null").select("task_statement_id", "posting_id", "evidence_start", "evidence_end").distinct()
    return matching.overlap_counts(s, ["posting_id"], "evidence_start", "evidence_end").select("task_statement_id", "posting_id", "evidence_start", "evidence_end", "n_overlaps")


@query(
    r"""WITH s AS (SELECT DISTINCT posting_id, task_statement_id, list_sort(list_distinct(regexp_extract_all(lower(atomic_task), '[a-z0-9]+'))) AS t FROM task_statements WHERE atomic_task IS NOT NULL),
k AS (SELECT posting_id, t, min(task_statement_id) AS class_id FROM s WHERE len(t) > 0 GROUP BY 1, 2),
p AS (SELECT x.posting_id, x.class_id AS a, y.class_id AS b FROM k x JOIN k y ON x.posting_id = y.posting_id AND x.class_id <> y.class_id AND len(list_intersect(x.t, y.t)) >= 0.75 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) - 1e-9),
n AS (SELECT posting_id, a, count(*)::BIGINT AS n_links FROM p GROUP BY 1, 2)
SELECT s.posting_id, s.task_statement_id, k.class_id, coalesce(n.n_links, 0)::BIGINT AS n_links FROM s LEFT JOIN k ON s.posting_id = k.posting_id AND s.t = k.t LEFT JOIN n ON n.posting_id = k.posting_id AND n.a = k.class_id"""
)
def near_duplicate_statements(spark, sf):
    s = table(spark, sf, "task_statements").where("atomic_task is not null").select("posting_id", "task_statement_id", "atomic_task").distinct()
    return matching.near_sets(s, "posting_id", "task_statement_id", F.regexp_extract_all(F.lower("atomic_task"), F.lit("([a-z0-9]+)"), 1), 0.75)


def _candidates(spark, sf):
    """Statements of two producers of one posting that share their normal text or half of their stems."""
    s = table(spark, sf, "task_statements").where("atomic_task is not null and posting_id is not null and provider is not null")
    d = s.groupBy("posting_id", "provider", T.normal_statement(F.col("atomic_task")).alias("text")).agg(F.min("task_statement_id").alias("id")).withColumn("st", F.array_distinct(T.stems(F.col("text")))).where(F.size("st") > 0)
    # stems are worked out once, then read by both sides
    d = Workspace(spark, "candidates").cut(d, "stems")
    key = d.withColumn("w", F.explode("st"))
    freq = key.groupBy("w").agg(F.count("*").alias("f"))
    # the rarest half of a statement's stems: sets that share half of their union share one of these
    ranked = key.join(freq, "w").groupBy("posting_id", "provider", "id", "text", "st").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "w"))), lambda x: x["w"]).alias("o"))
    pre = ranked.withColumn("w", F.explode(F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") * 0.5) + 1).cast("int"))))
    a = pre.select("posting_id", "w", F.col("provider").alias("provider_a"), F.col("id").alias("a"), F.col("st").alias("sa"), F.col("text").alias("ta"))
    b = pre.select("posting_id", "w", F.col("provider").alias("provider_b"), F.col("id").alias("b"), F.col("st").alias("sb"), F.col("text").alias("tb"))
    group = ["posting_id", "provider_a", "provider_b"]
    met = a.join(b, ["posting_id", "w"]).where("provider_a < provider_b").dropDuplicates([*group, "a", "b"])
    return met.withColumn("score", F.round(F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(T.set_jaccard(F.col("sa"), F.col("sb"))), 4)).where("score >= 0.5").select(*group, "a", "b", "score")


@query()
def greedy_one_to_one(spark, sf):
    """One-to-one pairs of each two producers of a posting, chosen for each pair of producers on its own."""
    return matching.greedy_pairs(_candidates(spark, sf), ["posting_id", "provider_a", "provider_b"], "a", "b", ["score"])


@query(
    """SELECT provider, count(*)::BIGINT AS predicted, sum(CASE WHEN is_valid_task THEN 1 ELSE 0 END)::BIGINT AS tp, round(avg(CASE WHEN is_valid_task THEN 1.0 ELSE 0.0 END), 6) AS precision_,
round(((tp::DOUBLE/predicted) + 1.96*1.96/(2.0*predicted) - 1.96*sqrt((tp::DOUBLE/predicted)*(1-(tp::DOUBLE/predicted))/predicted + 1.96*1.96/(4.0*predicted*predicted)))/(1+1.96*1.96/predicted), 4) AS wilson_low,
round(((tp::DOUBLE/predicted) + 1.96*1.96/(2.0*predicted) + 1.96*sqrt((tp::DOUBLE/predicted)*(1-(tp::DOUBLE/predicted))/predicted + 1.96*1.96/(4.0*predicted*predicted)))/(1+1.96*1.96/predicted), 4) AS wilson_high FROM task_statements GROUP BY 1"""
)
def precision_by_provider(spark, sf):
    d = table(spark, sf, "task_statements").groupBy("provider").agg(F.count("*").alias("predicted"), F.count_if(F.col("is_valid_task")).alias("tp"))
    w = S.wilson(F.col("tp"), F.col("predicted"))
    return d.select("provider", "predicted", "tp", F.round(S.precision(F.col("tp"), F.col("predicted")), 6).alias("precision_"), w["low"].alias("wilson_low"), w["high"].alias("wilson_high"))


@query(
    """WITH p AS (SELECT provider, source_section, avg(is_valid_task::INT) AS purity, count(*) AS n FROM task_statements WHERE is_valid_task IS NOT NULL AND source_section IS NOT NULL GROUP BY 1, 2)
SELECT provider, round(sum(purity * n) / sum(n), 6) AS weighted_purity, round(avg(purity), 6) AS plain_mean, count(*)::BIGINT AS strata FROM p GROUP BY 1"""
)
def weighted_purity(spark, sf):
    p = table(spark, sf, "task_statements").where("is_valid_task is not null and source_section is not null").groupBy("provider", "source_section").agg(F.avg(F.col("is_valid_task").cast("int")).alias("purity"), F.count("*").alias("n"))
    return p.groupBy("provider").agg(F.round(F.sum(F.col("purity") * F.col("n")) / F.sum("n"), 6).alias("weighted_purity"), F.round(F.avg("purity"), 6).alias("plain_mean"), F.count("*").alias("strata"))


@query("SELECT review_status, looks_like_qualification, is_valid_task, count(*)::BIGINT AS n FROM task_statements GROUP BY ALL")
def confusion_counts(spark, sf):
    return table(spark, sf, "task_statements").groupBy("review_status", "looks_like_qualification", "is_valid_task").agg(F.count("*").alias("n"))


@query(
    """WITH s AS (SELECT DISTINCT posting_id, task_statement_id, provider, source_section FROM task_statements), c AS (SELECT source_section, count(*)::DOUBLE AS n FROM s GROUP BY 1), t AS (SELECT sum(n) AS total FROM c)
SELECT round((SELECT sum((n / total) * (n / total)) FROM c, t), 6) AS chance, round((SELECT max(n / total) FROM c, t), 6) AS largest"""
)
def chance_rate(spark, sf):
    s = table(spark, sf, "task_statements").select("posting_id", "task_statement_id", "provider", "source_section").distinct()
    c = s.groupBy("source_section").agg(F.count("*").cast("double").alias("n"))
    return c.crossJoin(c.agg(F.sum("n").alias("total"))).agg(F.round(F.sum(F.pow(F.col("n") / F.col("total"), F.lit(2.0))), 6).alias("chance"), F.round(F.max(F.col("n") / F.col("total")), 6).alias("largest"))


@query()
def bootstrap_validity(spark, sf):
    per = table(spark, sf, "task_statements").groupBy("posting_id").agg(F.count_if(F.col("is_valid_task")).alias("tp"), F.count("*").alias("n"))
    return sampling.percentile_bounds(sampling.bootstrap(per, "posting_id", ["tp", "n"], 200), F.col("tp") / F.col("n"), "validity")


@query(
    """WITH d AS (SELECT DISTINCT posting_id, task_statement_id, provider FROM task_statements WHERE evidence_valid), n AS (SELECT posting_id, count(*)::BIGINT AS n, count(DISTINCT provider)::BIGINT AS providers FROM d GROUP BY 1)
SELECT posting_id, CASE WHEN n <= 1000 THEN '' ELSE substr(task_statement_id, 1, length(to_hex((n - 1) // 1000))) END AS chunk, n, providers, string_agg(task_statement_id, ';' ORDER BY task_statement_id) AS ids FROM d JOIN n USING (posting_id) GROUP BY ALL"""
)
def ordered_concatenation(spark, sf):
    """The ids of every posting's statements in order: one row, or for more than 1,000 ids a row for each beginning of an
    id, so that no string grows with the posting; its chunks in order are the whole."""
    d = table(spark, sf, "task_statements").where("evidence_valid").select("posting_id", "task_statement_id", "provider").distinct()
    n = d.groupBy("posting_id").agg(F.count("*").alias("n"), F.count_distinct("provider").alias("providers"))
    begin = F.substring(F.col("task_statement_id"), F.lit(1), F.length(F.hex(F.floor((F.col("n") - 1) / 1000).cast("long"))))
    chunk = F.when(F.col("n") <= 1000, "").otherwise(begin)
    return d.join(n, "posting_id").groupBy("posting_id", chunk.alias("chunk"), "n", "providers").agg(F.array_join(F.sort_array(F.collect_list("task_statement_id")), ";").alias("ids"))


@query(
    """SELECT phase, provider, count(*)::BIGINT AS n, round(avg(support_overlap), 4) AS mean_support, sum(CASE WHEN coalesce(adjudication_decision, 'keep') <> 'reject' THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN coalesce(evidence_valid, FALSE) AND NOT starts_with(review_status, 'rejected') THEN 1 ELSE 0 END)::BIGINT AS valid FROM task_statements WHERE source_section NOT IN ('requirements', 'skills') GROUP BY 1, 2"""
)
def three_valued_filters(spark, sf):
    d = table(spark, sf, "task_statements").where(~F.col("source_section").isin("requirements", "skills"))
    return d.groupBy("phase", "provider").agg(F.count("*").alias("n"), F.round(F.avg("support_overlap"), 4).alias("mean_support"), F.count_if(F.coalesce("adjudication_decision", F.lit("keep")) != "reject").alias("kept"), F.count_if(F.coalesce("evidence_valid", F.lit(False)) & ~F.col("review_status").startswith("rejected")).alias("valid"))


@query()
def statement_support(spark, sf):
    """Share of each statement's stems that its evidence holds, recomputed."""
    d = table(spark, sf, "task_statements").where("atomic_task is not null").select("task_statement_id", "atomic_task", "evidence_span").distinct()
    return d.select("task_statement_id", T.support(F.col("atomic_task"), F.col("evidence_span")).alias("support"), F.round(T.set_containment(T.stems(F.col("atomic_task")), T.stems(F.col("evidence_span"))), 4).alias("containment"))


@query(
    """WITH s AS (SELECT DISTINCT task_statement_id, posting_id FROM task_statements), a AS (SELECT task_statement_id, count(*) AS answers FROM task_statements WHERE confirming_provider IS NOT NULL GROUP BY 1)
SELECT CASE WHEN a.answers IS NULL THEN 'missing' WHEN a.answers > 1 THEN 'repeated' ELSE 'ok' END AS status, count(*)::BIGINT AS n FROM s LEFT JOIN a USING (task_statement_id) GROUP BY 1"""
)
def answer_reconciliation(spark, sf):
    t = table(spark, sf, "task_statements")
    return matching.reconcile(t.select("task_statement_id").distinct(), t.where("confirming_provider is not null").select("task_statement_id"), "task_statement_id").groupBy("status").agg(F.count("*").alias("n"))


@query()
def review_queue(spark, sf):
    """Statements that want a reader, with their reasons and a priority."""
    d = table(spark, sf, "task_statements").select("task_statement_id", "posting_id", "evidence_match_type", "support_overlap", "disagreement_type", "looks_like_qualification", "consensus_score").distinct()
    why = S.flags(fuzzy_evidence=F.col("evidence_match_type") == "fuzzy", weak_support=F.col("support_overlap") < 0.6, producers_differ=F.col("disagreement_type").isin("kind_conflict", "boundary"), qualification=F.col("looks_like_qualification"))
    rank = S.sum_of_rules((F.col("disagreement_type") == "kind_conflict", 3.0), (F.col("evidence_match_type") == "fuzzy", 2.0), (F.col("support_overlap") < 0.6, 1.0), (F.col("looks_like_qualification"), 1.0))
    return d.withColumn("reasons", why).where("reasons <> ''").select("task_statement_id", "posting_id", "reasons", rank.alias("priority"))
