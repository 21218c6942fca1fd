"""Evaluation queries: statements against statements, values against rules, counts against what is stated."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions import text as T
from quarrymill.operators import evaluation, matching, similarity
from quarrymill.plans.registry import query
from quarrymill.plans.statements import _candidates, greedy_one_to_one
from quarrymill.runtime import Workspace, table

NORM = "lower(trim(regexp_replace(atomic_task, '\\s+', ' ', 'g')))"


def _norm(c="atomic_task"):
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _statements(spark, sf):
    return table(spark, sf, "task_statements")


@query(
    f"""WITH d AS (SELECT DISTINCT posting_id, provider, {NORM} AS t FROM task_statements WHERE atomic_task IS NOT NULL AND posting_id IS NOT NULL AND provider IS NOT NULL), c AS (SELECT posting_id, provider, count(*) AS n FROM d GROUP BY 1, 2),
p AS (SELECT DISTINCT x.provider AS a, y.provider AS b FROM c x JOIN c y ON x.provider < y.provider), g AS (SELECT a, b, posting_id, max(CASE WHEN provider = a THEN n END) AS na, max(CASE WHEN provider = b THEN n END) AS nb FROM c JOIN p ON provider = a OR provider = b GROUP BY 1, 2, 3),
m AS (SELECT x.provider AS a, y.provider AS b, posting_id, count(*) AS tp FROM d x JOIN d y USING (posting_id, t) WHERE x.provider < y.provider GROUP BY 1, 2, 3), f AS (SELECT a, b, na, nb, coalesce(tp, 0) AS tp FROM g LEFT JOIN m USING (a, b, posting_id)),
s AS (SELECT a, b, count(*)::BIGINT AS groups, sum(tp)::BIGINT AS matched, sum(tp)::DOUBLE / sum(nb) AS p, sum(tp)::DOUBLE / sum(na) AS r, avg(tp::DOUBLE / nb) AS mp, avg(tp::DOUBLE / na) AS mr FROM f GROUP BY 1, 2)
SELECT a, b, groups, matched, round(p, 6) AS precision_, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall FROM s"""
)
def provider_pair_scores(spark, sf):
    """Precision, recall and F1 of each two producers' statements, matched by equal text within a posting."""
    return evaluation.pair_scores(_statements(spark, sf).withColumn("t", _norm()), "posting_id", "provider", "t")


@query()
def matched_at_thresholds(spark, sf):
    """Precision, recall and F1 of one-to-one matches at several least scores, for each two producers.

    Matches are taken in falling order of their score, so those at a threshold are the matches with that score or more.
    """
    m = Workspace(spark, "thresholds").cut(greedy_one_to_one(spark, sf).select("provider_a", "provider_b", "score"), "matches")
    n = _statements(spark, sf).where("atomic_task is not null and posting_id is not null and provider is not null").select("provider", "posting_id", T.normal_statement(F.col("atomic_task")).alias("t")).distinct().groupBy("provider").agg(F.count("*").alias("n"))
    at = m.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.5, 0.65, 0.75, 0.85, 1.0)]))).groupBy("provider_a", "provider_b", "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("matched"))
    d = at.join(n.toDF("provider_a", "na"), "provider_a").join(n.toDF("provider_b", "nb"), "provider_b")
    p, r = S.precision(F.col("matched"), F.col("nb")), S.precision(F.col("matched"), F.col("na"))
    return d.select("provider_a", "provider_b", "threshold", "matched", F.round(p, 6).alias("precision_"), F.round(r, 6).alias("recall"), F.round(S.f1(p, r), 6).alias("f1"))


@query()
def disagreement_classes(spark, sf):
    """Each matched pair of two producers: agreed, another kind of section, or other bounds of the evidence."""
    one = _statements(spark, sf).groupBy("task_statement_id").agg(F.min(F.struct("source_section", "evidence_start", "evidence_end")).alias("s"))
    m = greedy_one_to_one(spark, sf).select("posting_id", "provider_a", "provider_b", "a", "b", "score").join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b")
    iou = S.span_iou(F.col("x.evidence_start"), F.col("x.evidence_end"), F.col("y.evidence_start"), F.col("y.evidence_end"))
    kind = F.when(F.col("x.source_section") != F.col("y.source_section"), "kind_conflict").when(iou < 0.5, "boundary").otherwise("agreed")
    return m.select("posting_id", "provider_a", "provider_b", "a", "b", "score", F.round(iou, 6).alias("span_iou"), kind.alias("kind"))


@query(
    """WITH d AS (SELECT DISTINCT posting_id, provider, evidence_start AS s, evidence_end AS e FROM task_statements WHERE evidence_end > evidence_start AND provider IS NOT NULL AND posting_id IS NOT NULL)
SELECT x.posting_id, x.provider, y.provider AS inside_side, x.s AS evidence_start, x.e AS evidence_end, count(*)::BIGINT AS n FROM d x JOIN d y ON x.posting_id = y.posting_id AND x.provider <> y.provider AND y.s >= x.s AND y.e <= x.e GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2"""
)
def over_split_spans(spark, sf):
    """Evidence of one producer that holds two or more pieces of evidence of another."""
    return matching.spans_inside(_statements(spark, sf).where("posting_id is not null"), ["posting_id"], "provider", "evidence_start", "evidence_end").where("n >= 2")


@query()
def unmatched_best_candidates(spark, sf):
    """Statements that no other producer matches, with the best candidate they lost, and why."""
    ws = Workspace(spark, "unmatched")
    cands = ws.cut(_candidates(spark, sf), "candidates")
    group = ["posting_id", "provider_a", "provider_b"]
    won = ws.cut(matching.greedy_pairs(cands, group, "a", "b", ["score"], ws), "won")
    s = _statements(spark, sf).where("atomic_task is not null and posting_id is not null and provider is not null")
    own = s.groupBy("posting_id", "provider", T.normal_statement(F.col("atomic_task")).alias("t")).agg(F.min("task_statement_id").alias("id"), F.max("evidence_valid").alias("valid"))
    free = own.join(won.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
    best = cands.select(F.col("a").alias("id"), "score").union(cands.select("b", "score")).groupBy("id").agg(F.max("score").alias("best"))
    why = evaluation.first_failure([("no_evidence", ~F.coalesce("valid", F.lit(False))), ("lost_to_another", F.col("best") >= 0.75), ("near", F.col("best").isNotNull())], "alone")
    return free.join(best, "id", "left").select("id", "posting_id", "provider", "best", why.alias("why"))


@query(
    "SELECT provider, CASE WHEN atomic_task IS NULL THEN 'no_text' WHEN NOT coalesce(evidence_valid, FALSE) THEN 'no_evidence' WHEN coalesce(support_overlap, 0) < 0.5 THEN 'unsupported' WHEN looks_like_qualification THEN 'qualification' ELSE 'kept' END AS reason, count(*)::BIGINT AS n FROM task_statements GROUP BY 1, 2"
)
def dropped_reasons(spark, sf):
    rules = [("no_text", F.col("atomic_task").isNull()), ("no_evidence", ~F.coalesce("evidence_valid", F.lit(False))), ("unsupported", F.coalesce("support_overlap", F.lit(0.0)) < 0.5), ("qualification", F.col("looks_like_qualification"))]
    return _statements(spark, sf).groupBy("provider", evaluation.first_failure(rules, "kept").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT posting_id, count(*)::BIGINT AS n, avg(is_valid_task::INT) > 0.5 AS mostly_valid FROM task_statements WHERE is_valid_task IS NOT NULL GROUP BY 1")
def majority_validity(spark, sf):
    """A majority of votes for each posting; ties fall to false."""
    return _statements(spark, sf).where("is_valid_task is not null").groupBy("posting_id").agg(F.count("*").alias("n"), (F.avg(F.col("is_valid_task").cast("int")) > 0.5).alias("mostly_valid"))


@query(f"SELECT {NORM} AS statement, count(DISTINCT posting_id)::BIGINT AS postings, count(DISTINCT atomic_task)::BIGINT AS variants, min(extraction_timestamp) AS first_seen, string_agg(DISTINCT provider, ';' ORDER BY provider) AS providers FROM task_statements WHERE atomic_task IS NOT NULL GROUP BY 1")
def statement_vocabulary(spark, sf):
    """Normal forms with the postings that hold them, their variants and producers."""
    d = _statements(spark, sf).where("atomic_task is not null")
    return d.groupBy(_norm().alias("statement")).agg(F.count_distinct("posting_id").alias("postings"), F.count_distinct("atomic_task").alias("variants"), F.min("extraction_timestamp").alias("first_seen"), F.nullif(F.array_join(F.array_sort(F.collect_set("provider")), ";"), F.lit("")).alias("providers"))


@query(
    """WITH s AS (SELECT DISTINCT task_statement_id AS id, regexp_extract_all(lower(atomic_task), '[a-z]+') AS w FROM task_statements WHERE atomic_task IS NOT NULL), lex AS (SELECT w[1] AS v FROM s WHERE len(w) > 0 GROUP BY 1 HAVING count(*) >= 2),
f AS (SELECT id, w[i - 1] AS c, w[i] AS v FROM (SELECT id, w, unnest(range(2, len(w) + 1)) AS i FROM s)) SELECT id AS task_statement_id, count(DISTINCT v)::BIGINT AS verbs FROM f WHERE c IN ('and', 'or') AND v IN (SELECT v FROM lex) GROUP BY 1"""
)
def compound_statements(spark, sf):
    """Statements that join two activities: a conjunction followed by a word that begins at least two statements."""
    s = _statements(spark, sf).where("atomic_task is not null").select("task_statement_id", F.regexp_extract_all(F.lower("atomic_task"), F.lit("([a-z]+)"), 1).alias("w")).distinct()
    lexicon = s.where(F.size("w") > 0).groupBy(F.element_at("w", 1).alias("v")).agg(F.count("*").alias("n")).where("n >= 2").select("v")
    pairs = s.select("task_statement_id", F.explode(F.expr("filter(transform(w, (x, i) -> if(i > 0 and w[i - 1] in ('and', 'or'), x, null)), x -> x is not null)")).alias("v"))
    return pairs.join(lexicon, "v", "left_semi").groupBy("task_statement_id").agg(F.count_distinct("v").alias("verbs"))


@query("SELECT doc_type, count(*)::BIGINT AS n, count(*) FILTER (WHERE regexp_matches(lower(text), '\\b[0-9]+ (clusters|topics|groups|categories|visits|cases)\\b'))::BIGINT AS hinted FROM documents GROUP BY 1")
def count_hints(spark, sf):
    """Texts that tell a number of groups, which a prompt must not hold."""
    return table(spark, sf, "documents").groupBy("doc_type").agg(F.count("*").alias("n"), F.count_if(T.tells_a_count(F.col("text"), ["clusters", "topics", "groups", "categories", "visits", "cases"])).alias("hinted"))


@query(
    """WITH d AS (SELECT job_title, len(list_filter(string_split_regex(trim(job_title), '\\s+'), lambda x: x <> '')) AS words FROM job_postings)
SELECT concat_ws(';', CASE WHEN job_title IS NULL THEN 'missing' END, CASE WHEN words < 2 THEN 'too_short' END, CASE WHEN words > 8 THEN 'too_long' END, CASE WHEN NOT regexp_matches(job_title, '[A-Za-z]') THEN 'no_letters' END, CASE WHEN lower(trim(job_title)) IN ('other', 'various', 'misc', 'general') THEN 'vague' END) AS errors, count(*)::BIGINT AS n FROM d GROUP BY 1"""
)
def title_errors(spark, sf):
    """Rules of fields: which ones each title breaks."""
    c = F.col("job_title")
    words = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != ""))
    errors = S.flags(missing=c.isNull(), too_short=c.isNotNull() & (words < 2), too_long=words > 8, no_letters=~c.rlike("[A-Za-z]"), vague=F.lower(F.trim(c)).isin("other", "various", "misc", "general"))
    return table(spark, sf, "job_postings").groupBy(errors.alias("errors")).agg(F.count("*").alias("n"))


@query(
    """WITH e AS (SELECT quantile_cont(support_overlap, [0.2, 0.4, 0.6, 0.8]) AS q FROM task_statements), b AS (SELECT support_overlap AS v, CASE WHEN support_overlap IS NOT NULL THEN 1 + len(list_filter(q, lambda x: support_overlap > x)) END AS bin FROM task_statements, e)
SELECT bin::INT AS bin, count(*)::BIGINT AS n, min(v) AS least, max(v) AS most FROM b GROUP BY 1"""
)
def support_bins(spark, sf):
    d = evaluation.quantile_bins(_statements(spark, sf).select("support_overlap"), "support_overlap", 5)
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.min("support_overlap").alias("least"), F.max("support_overlap").alias("most"))


@query(
    f"""WITH d AS (SELECT source_section, {NORM} AS t, max(consensus_score) AS s, min(task_statement_id) AS id FROM task_statements WHERE atomic_task IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source_section ORDER BY s DESC NULLS LAST, t) AS r FROM d)
SELECT source_section, r::INT AS place, id AS task_statement_id, t AS statement FROM r WHERE r <= 3"""
)
def representative_statements(spark, sf):
    """The three best statements of each section, each text once."""
    d = _statements(spark, sf).where("atomic_task is not null").groupBy("source_section", _norm().alias("statement")).agg(F.max("consensus_score").alias("s"), F.min("task_statement_id").alias("task_statement_id"))
    w = Window.partitionBy("source_section").orderBy(F.desc_nulls_last("s"), "statement")
    return d.withColumn("place", F.row_number().over(w)).where("place <= 3").select("source_section", "place", "task_statement_id", "statement")


_FLAGS = {"fuzzy_evidence": "evidence_match_type = 'fuzzy'", "no_evidence": "evidence_match_type = 'none'", "weak_support": "support_overlap < 0.6", "kind_conflict": "disagreement_type = 'kind_conflict'", "boundary": "disagreement_type = 'boundary'", "qualification": "looks_like_qualification", "low_tier": "confidence_tier = 'low'"}


@query(
    "WITH d AS (SELECT task_statement_id, "
    + ", ".join(f"max(CASE WHEN {c} THEN 1 ELSE 0 END) AS {n}" for n, c in _FLAGS.items())
    + " FROM task_statements GROUP BY 1), f AS (SELECT task_statement_id, "
    + " + ".join(_FLAGS)
    + " AS flags, concat_ws(';', "
    + ", ".join(f"CASE WHEN {n} = 1 THEN '{n}' END" for n in _FLAGS)
    + ") AS reasons FROM d) SELECT task_statement_id, flags::INT AS flags, reasons FROM f WHERE flags > 0 ORDER BY flags DESC, task_statement_id LIMIT 24"
)
def case_queue(spark, sf):
    """The 24 statements with the most flags: a report of cases to read."""
    d = _statements(spark, sf).groupBy("task_statement_id").agg(*[F.max(F.when(F.expr(c), 1).otherwise(0)).alias(n) for n, c in _FLAGS.items()])
    total = sum((F.col(n) for n in _FLAGS), F.lit(0))
    f = d.select("task_statement_id", total.alias("flags"), S.flags(**{n: F.col(n) == 1 for n in _FLAGS}).alias("reasons"))
    return f.where("flags > 0").orderBy(F.desc("flags"), "task_statement_id").limit(24)


@query(
    """WITH p AS (SELECT posting_id, provider, count(*) AS n, avg((coalesce(evidence_valid, FALSE))::INT) AS valid, avg(looks_like_qualification::INT) AS quali, avg((disagreement_type IS NOT NULL)::INT) AS dis FROM task_statements GROUP BY 1, 2)
SELECT posting_id, provider, n::BIGINT AS n, concat_ws(';', CASE WHEN n < 2 THEN 'few_statements' END, CASE WHEN valid < 0.9 THEN 'invalid_evidence' END, CASE WHEN quali > 0.3 THEN 'many_qualifications' END, CASE WHEN dis > 0.5 THEN 'disagreement' END) AS triggers FROM p"""
)
def escalation_triggers(spark, sf):
    """Which rules of quality ask for a second producer of a posting."""
    p = _statements(spark, sf).groupBy("posting_id", "provider").agg(F.count("*").alias("n"), F.avg(F.coalesce("evidence_valid", F.lit(False)).cast("int")).alias("valid"), F.avg(F.col("looks_like_qualification").cast("int")).alias("quali"), F.avg(F.col("disagreement_type").isNotNull().cast("int")).alias("dis"))
    return p.select("posting_id", "provider", "n", S.flags(few_statements=F.col("n") < 2, invalid_evidence=F.col("valid") < 0.9, many_qualifications=F.col("quali") > 0.3, disagreement=F.col("dis") > 0.5).alias("triggers"))


@query(
    """WITH d AS (SELECT provider AS a, source_section AS b FROM task_statements WHERE provider IS NOT NULL AND source_section IS NOT NULL), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY 1), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY 1), t AS (SELECT sum(n) AS tot FROM c),
z AS (SELECT (SELECT sum(n*(n-1)/2) FROM c) AS ij, (SELECT sum(na*(na-1)/2) FROM ra) AS pa, (SELECT sum(nb*(nb-1)/2) FROM rb) AS pb, tot, (SELECT count(*) FROM ra) AS ka, (SELECT count(*) FROM rb) AS kb, (SELECT -sum(na/t.tot*ln(na/t.tot)) FROM ra, t) AS ha, (SELECT -sum(nb/t.tot*ln(nb/t.tot)) FROM rb, t) AS hb,
(SELECT sum(n/t.tot*ln(n*t.tot/(na*nb))) FROM c JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT sum(n*n/(na*nb)) FROM c JOIN ra USING (a) JOIN rb USING (b)) AS phi FROM t)
SELECT round((ij - pa*pb/(tot*(tot-1)/2)) / ((pa+pb)/2 - pa*pb/(tot*(tot-1)/2)), 6) AS ari, round(mi/((ha+hb)/2), 6) AS nmi, round(sqrt((phi-1)/(least(ka,kb)-1)), 6) AS cramers_v, tot::BIGINT AS n FROM z"""
)
def provider_section_association(spark, sf):
    """How far producers and sections go together."""
    return similarity.agreement(_statements(spark, sf), "provider", "source_section")


@query(
    """SELECT task_statement_id, max(coalesce(adjudication_decision, CASE WHEN NOT evidence_valid THEN 'no_evidence' END, CASE WHEN confidence_tier = 'high' THEN 'automatic' END, CASE WHEN confirming_provider IS NOT NULL THEN 'confirmed' END, 'open')) AS resolution FROM task_statements GROUP BY 1"""
)
def resolved_labels(spark, sf):
    """The first of several sources of a decision that has one."""
    first = F.coalesce("adjudication_decision", F.when(~F.col("evidence_valid"), "no_evidence"), F.when(F.col("confidence_tier") == "high", "automatic"), F.when(F.col("confirming_provider").isNotNull(), "confirmed"), F.lit("open"))
    return _statements(spark, sf).groupBy("task_statement_id").agg(F.max(first).alias("resolution"))


_WORDS = "len(list_filter(string_split_regex(trim({c}), '\\s+'), lambda x: x <> ''))"


@query(
    "SELECT count(*) FILTER (WHERE description_char_count <> length(description))::BIGINT AS chars_differ, count(*) FILTER (WHERE description_word_count <> " + _WORDS.format(c="description") + ")::BIGINT AS words_differ, count(*) FILTER (WHERE salary_min > salary_max)::BIGINT AS salaries_crossed, count(*) FILTER (WHERE date_posted > date_collected)::BIGINT AS posted_after_collected, count(*)::BIGINT AS n FROM job_postings"
)
def stated_counts(spark, sf):
    """Counts that rows state against the same counts taken anew."""
    words = F.size(F.filter(F.split(F.trim("description"), r"\s+"), lambda x: x != ""))
    return table(spark, sf, "job_postings").agg(F.count_if(F.col("description_char_count") != F.length("description")).alias("chars_differ"), F.count_if(F.col("description").isNotNull() & (F.col("description_word_count") != words)).alias("words_differ"), F.count_if(F.col("salary_min") > F.col("salary_max")).alias("salaries_crossed"), F.count_if(F.col("date_posted") > F.col("date_collected")).alias("posted_after_collected"), F.count("*").alias("n"))


@query(
    """SELECT name, failures = 0 AS ok, failures::BIGINT AS failures FROM (SELECT 'posting_ids_present' AS name, (SELECT count(*) FROM job_postings WHERE posting_id IS NULL) AS failures
UNION ALL SELECT 'statements_have_postings', (SELECT count(*) FROM (SELECT DISTINCT posting_id FROM task_statements) s WHERE NOT EXISTS (SELECT 1 FROM job_postings p WHERE p.posting_id = s.posting_id))
UNION ALL SELECT 'document_ids_unique', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'documents_chars_right', (SELECT count(*) FROM documents WHERE n_chars <> length(text))
UNION ALL SELECT 'valid_evidence_has_span', (SELECT count(*) FROM task_statements WHERE evidence_valid AND evidence_span IS NULL)
UNION ALL SELECT 'statement_rows_once', (SELECT count(*) FROM (SELECT task_statement_id FROM task_statements GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'shares_sum_to_one', (SELECT count(*) FROM (SELECT mix_id FROM mix_targets GROUP BY 1 HAVING abs(sum(target_share) - 1) > 1e-6)))"""
)
def acceptance_checks(spark, sf):
    """Checks of the delivered tables as rows: name, whether it holds, how many rows break it."""
    p, t, d, m = (table(spark, sf, n) for n in ("job_postings", "task_statements", "documents", "mix_targets"))
    n = lambda df: df.agg(F.count("*").alias("n"))
    repeated = lambda df, k: n(df.groupBy(k).agg(F.count("*").alias("c")).where("c > 1"))
    return evaluation.check_table([
        ("posting_ids_present", n(p.where("posting_id is null"))),
        ("statements_have_postings", n(t.select("posting_id").distinct().join(p.select("posting_id"), "posting_id", "left_anti"))),
        ("document_ids_unique", repeated(d, "doc_id")),
        ("documents_chars_right", n(d.where("n_chars <> length(text)"))),
        ("valid_evidence_has_span", n(t.where("evidence_valid and evidence_span is null"))),
        ("statement_rows_once", repeated(t, "task_statement_id")),
        ("shares_sum_to_one", n(m.groupBy("mix_id").agg(F.sum("target_share").alias("s")).where("abs(s - 1) > 1e-6"))),
    ])


@query(
    """SELECT retrieval_id, count(*)::BIGINT AS rows_, count(DISTINCT posting_id)::BIGINT AS ids, count(DISTINCT posting_id) = count(*) AS all_unique, count(*) FILTER (WHERE description IS NULL)::BIGINT AS without_text, min(date_collected) AS first_day, max(date_collected) AS last_day FROM job_postings GROUP BY 1"""
)
def delivery_completeness(spark, sf):
    return table(spark, sf, "job_postings").groupBy("retrieval_id").agg(F.count("*").alias("rows_"), F.count_distinct("posting_id").alias("ids"), (F.count_distinct("posting_id") == F.count("*")).alias("all_unique"), F.count_if(F.col("description").isNull()).alias("without_text"), F.min("date_collected").alias("first_day"), F.max("date_collected").alias("last_day"))


@query(
    """WITH s AS (SELECT posting_id, count(DISTINCT task_statement_id) AS n, count(DISTINCT provider) AS providers, min(support_overlap) AS support FROM task_statements GROUP BY 1), p AS (SELECT posting_id, count(*) AS deliveries, min(retrieval_id) AS first, max(retrieval_id) AS last, count(DISTINCT description) AS versions FROM job_postings GROUP BY 1)
SELECT posting_id, deliveries::BIGINT AS deliveries, versions::BIGINT AS versions, first, last, coalesce(n, 0)::BIGINT AS statements, coalesce(providers, 0)::BIGINT AS providers, support AS least_support, concat_ws(';', CASE WHEN versions > 1 THEN 'edited' END, CASE WHEN n IS NULL THEN 'no_statements' END, CASE WHEN support < 0.6 THEN 'weak_support' END) AS remarks FROM p LEFT JOIN s USING (posting_id)"""
)
def posting_cards(spark, sf):
    """One card a posting: its deliveries, its statements and what to know about them."""
    s = _statements(spark, sf).groupBy("posting_id").agg(F.count_distinct("task_statement_id").alias("n"), F.count_distinct("provider").alias("providers"), F.min("support_overlap").alias("support"))
    p = table(spark, sf, "job_postings").groupBy("posting_id").agg(F.count("*").alias("deliveries"), F.min("retrieval_id").alias("first"), F.max("retrieval_id").alias("last"), F.count_distinct("description").alias("versions"))
    d = p.join(s, "posting_id", "left")
    return d.select("posting_id", "deliveries", "versions", "first", "last", F.coalesce("n", F.lit(0)).alias("statements"), F.coalesce("providers", F.lit(0)).alias("providers"), F.col("support").alias("least_support"), S.flags(edited=F.col("versions") > 1, no_statements=F.col("n").isNull(), weak_support=F.col("support") < 0.6).alias("remarks"))


@query(
    """WITH r AS (SELECT DISTINCT family, target_count FROM final_method_comparison WHERE family IS NOT NULL AND target_count IS NOT NULL), f AS (SELECT DISTINCT family FROM r), k AS (SELECT DISTINCT target_count FROM r)
SELECT f.family, k.target_count, EXISTS (SELECT 1 FROM r WHERE r.family = f.family AND r.target_count = k.target_count) AS was_run FROM f, k"""
)
def configuration_grid(spark, sf):
    """Every family with every target number of clusters, and which of them were run."""
    r = table(spark, sf, "final_method_comparison").where("family is not null and target_count is not null").select("family", "target_count").distinct()
    grid = r.select("family").distinct().crossJoin(r.select("target_count").distinct())
    return grid.join(r.withColumn("x", F.lit(True)), ["family", "target_count"], "left").select("family", "target_count", F.coalesce("x", F.lit(False)).alias("was_run"))


@query(
    """WITH r AS (SELECT DISTINCT partition_id, family, silhouette, stability_ari, selected FROM final_method_comparison), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY silhouette DESC NULLS LAST, partition_id, stability_ari DESC NULLS LAST) AS s, row_number() OVER (PARTITION BY family ORDER BY stability_ari DESC NULLS LAST, partition_id, silhouette DESC NULLS LAST) AS t FROM r)
SELECT family, max(CASE WHEN s = 1 THEN partition_id END) AS best_silhouette, max(CASE WHEN t = 1 THEN partition_id END) AS most_stable, count(*) FILTER (WHERE selected)::BIGINT AS selected, coalesce(bool_or(selected AND s = 1), FALSE) AS selected_is_best FROM b GROUP BY 1"""
)
def claim_checks(spark, sf):
    """Superlatives of each family of runs, found anew, and whether the run marked as selected holds one."""
    r = table(spark, sf, "final_method_comparison").select("partition_id", "family", "silhouette", "stability_ari", "selected").distinct()
    best = lambda a, b: F.row_number().over(Window.partitionBy("family").orderBy(F.desc_nulls_last(a), "partition_id", F.desc_nulls_last(b)))
    b = r.withColumn("s", best("silhouette", "stability_ari")).withColumn("t", best("stability_ari", "silhouette"))
    return b.groupBy("family").agg(F.max(F.when(F.col("s") == 1, F.col("partition_id"))).alias("best_silhouette"), F.max(F.when(F.col("t") == 1, F.col("partition_id"))).alias("most_stable"), F.count_if(F.col("selected")).alias("selected"), F.coalesce(F.bool_or(F.col("selected") & (F.col("s") == 1)), F.lit(False)).alias("selected_is_best"))


@query("SELECT DISTINCT partition_id, n_clusters, floor(n_clusters * 0.8 + 0.5)::INT AS low, floor(n_clusters * 1.2 + 0.5)::INT AS high, n_clusters BETWEEN floor(target_count * 0.8 + 0.5) AND floor(target_count * 1.2 + 0.5) AS within_grid FROM final_method_comparison WHERE n_clusters IS NOT NULL")
def matched_grid(spark, sf):
    """Numbers of clusters a fifth less and more, and whether a run met its target within them."""
    at = lambda c, x: F.floor(F.col(c) * x + 0.5).cast("int")
    d = table(spark, sf, "final_method_comparison").where("n_clusters is not null")
    return d.select("partition_id", "n_clusters", at("n_clusters", 0.8).alias("low"), at("n_clusters", 1.2).alias("high"), F.col("n_clusters").between(at("target_count", 0.8), at("target_count", 1.2)).alias("within_grid")).distinct()


# Frequent words of each language.
COMMON = {
    "en": "the and of to in is for with that are this on as by from or it be at an",
    "de": "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es",
    "fr": "le la les des et en un une du est que dans pour qui par sur au pas plus avec",
    "es": "el los las del que y en un una es por con para se como su al lo más o",
    "nl": "de het een van en in is dat op te voor met zijn niet aan er ook als bij door",
}


def _count_sql(lang: str) -> str:
    return f"len(list_filter(w, lambda x: list_contains([{', '.join(repr(x) for x in COMMON[lang].split())}], x)))"


@query(
    f"""WITH d AS (SELECT language, regexp_extract_all(lower(posting_text), '[a-zäöüßàâçéèêëîïôûùñáíóú]+') AS w FROM job_postings WHERE posting_text IS NOT NULL), s AS (SELECT language, list_reverse_sort([{', '.join(f"{{'n': {_count_sql(x)}, 'l': '{x}'}}" for x in COMMON)}]) AS r FROM d)
SELECT language, CASE WHEN r[1].n = 0 OR r[1].n = r[2].n THEN NULL ELSE r[1].l END AS detected, count(*)::BIGINT AS n FROM s GROUP BY 1, 2"""
)
def detected_languages(spark, sf):
    """The language whose frequent words a text holds most of; none without any or with a tie."""
    words = F.regexp_extract_all(F.lower("posting_text"), F.lit("([a-zäöüßàâçéèêëîïôûùñáíóú]+)"), 1)
    d = table(spark, sf, "job_postings").where("posting_text is not null").select("language", words.alias("w"))
    return d.groupBy("language", T.language_by_words(F.col("w"), COMMON).alias("detected")).agg(F.count("*").alias("n"))
