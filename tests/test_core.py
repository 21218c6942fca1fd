"""Core operators against literals and brute force."""

import datetime
import itertools
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrymill.functions import scores as S
from quarrymill.functions import text as T
from quarrymill.operators import cluster, dedup, ledger, matching, sampling, sections, similarity
from quarrymill.operators.components import connected_components
from quarrymill.sources import files


def one(spark, col, **values):
    d = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return d.select(col.alias("x")).first()["x"]


def test_clean_text(spark):
    rows = [("<p>Hello&nbsp; <b>world</b></p>",), ("a  b \r\n c",), ("&amp;lt;p&amp;gt;x&amp;lt;/p&amp;gt;",), (None,), ("<br>",), ("1 < 2",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(T.clean(F.col("t")).alias("x")).collect()]
    assert got[0].split() == ["Hello", "world"] and got[1] == "a b\nc" and got[2] == "x" and got[3] is None and got[4] is None and got[5] == "1 < 2"


def test_titles(spark):
    rows = [("Senior Data Engineer (m/w/d)",), ("Working Student Marketing",), ("Director of Finance",), ("Clerk",), (None,), ("",)]
    got = spark.createDataFrame(rows, "t string").select(T.normal_title(F.col("t")).alias("n"), T.level_of_title(F.col("t")).alias("l")).collect()
    assert [r.n for r in got] == ["senior data engineer", "working student marketing", "director of finance", "clerk", None, None]
    assert [r.l for r in got] == ["senior", "intern_student", "manager", None, None, None]


def test_dates_and_numbers(spark):
    rows = [("09/15/2026",), ("",), ("2026-01-02T03:04:05",), ("2026-01-02",), ("x",), (None,)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(T.to_date_any(F.col("t")).alias("x")).collect()]
    assert got == [datetime.date(2026, 9, 15), None, datetime.date(2026, 1, 2), datetime.date(2026, 1, 2), None, None]
    got = [r.x for r in spark.createDataFrame([("$1,200.5",), ("NaN",), ("a",), (None,)], "t string").select(T.number(F.col("t")).alias("x")).collect()]
    assert got == [1200.5, None, None, None]


def test_locate():
    src = "We’re hiring.\nYou will  Prepare budgets – yearly. Other text here."
    assert T.locate(src, "Other text")["match_type"] == "exact"
    n = T.locate(src, "you will prepare budgets - yearly")
    assert n["match_type"] == "normalized" and src[n["start"] : n["end"]] == "You will  Prepare budgets – yearly"
    assert T.locate("Prepare the yearly budgets for all units. Sing.", "Prepare the yearly budget for all unit")["match_type"] == "fuzzy"
    assert T.locate(src, "nothing of this")["match_type"] == "none" and T.locate(None, "x")["start"] is None and T.locate(src, " ")["start"] is None


def test_support_and_stems(spark):
    assert one(spark, T.support(F.col("a"), F.col("b")), a="Prepare budgets", b="preparing the budget") == 1.0
    assert one(spark, T.support(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert one(spark, T.set_jaccard(T.stems(F.col("a")), T.stems(F.col("b"))), a="review budgets", b="review budget") == 1.0
    assert one(spark, T.section_at(F.col("a"), F.lit(20)), a="[requirements] words [skills] more") == "requirements"


def test_scores(spark):
    assert one(spark, S.consensus_score(F.lit("exact"), F.lit("lexical"), F.lit(1.0), F.lit(False)), a="") == 1.0
    assert one(spark, S.decision(F.lit(0.9), F.lit(0.0), 0.8, 0.6, 0.01), a="") == "review"
    w = one(spark, S.wilson(F.lit(84), F.lit(100)), a="")
    assert 0.75 < w["low"] < 0.84 < w["high"] < 0.91
    assert one(spark, S.wilson(F.lit(0), F.lit(0)), a="") is None
    assert one(spark, S.span_iou(F.lit(0), F.lit(10), F.lit(5), F.lit(15)), a="") == pytest.approx(1 / 3)
    assert one(spark, S.f1(F.lit(0.0), F.lit(0.0)), a="") == 0.0


def test_sections():
    text = "Intro words.\nResponsibilities:\nDo things.\nRequirements\nKnow things."
    got = sections.spans(text)
    assert [g[0] for g in got] == ["general_description", "responsibilities", "requirements"]
    assert text[got[1][1] : got[1][2]].strip() == "Do things."
    assert sections.spans(None) == [] and sections.spans("  ") == [] and sections.spans("just text")[0][0] == "general_description"


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components(spark, edges):
    rounds = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), one_task_edges=-1).collect()}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    comp = {n: n for e in edges for n in e}
    for _ in range(30):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == comp and rounds == comp


def test_dedup_and_changes(spark):
    d = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k"), ("c", 1, ""), ("d", 1, None)], "id string, o int, key string")
    got = {r.id: (r.dup_group, r.is_dup_duplicate) for r in dedup.flag_duplicates(d.drop("x"), F.col("key"), [F.col("o")], "id", "dup").collect()}
    assert got == {"a": ("a", False), "b": ("a", True), "c": (None, False), "d": (None, False)}
    old, new = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (4, "n"), (3, "y")], "k int, v string")
    assert {r.k: r.status for r in dedup.changed(old, new, "k", ["v"]).collect()} == {1: "same", 2: "same", 3: "changed", 4: "added"}
    assert sorted(r.v for r in dedup.upsert(old.na.fill("-"), spark.createDataFrame([(3, "new")], "k int, v string"), ["k"]).collect()) == ["-", "new", "x"]
    with pytest.raises(Exception):
        dedup.assert_keys(spark.createDataFrame([(1,), (1,)], "k int"), ["k"]).collect()


def test_overlaps_against_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(40), 0) for i in range(80)]
    rows = [(i, g, s, s + rng.randrange(0, 12)) for i, g, s, _ in rows] + [(99, 0, None, 4)]
    got = {r.id: r.n_overlaps for r in matching.overlap_counts(spark.createDataFrame(rows, "id int, g int, s int, e int"), ["g"], "s", "e").collect()}
    ok = [r for r in rows if r[2] is not None and r[3] > r[2]]
    for i, g, s, e in rows:
        want = sum(1 for j, h, a, b in ok if h == g and a < e and s < b) - 1 if (i, g, s, e) in ok else 0
        assert got[i] == want


def test_near_sets_against_pairs(spark):
    rng = random.Random(2)
    rows = [(i, "g", " ".join(rng.sample("abcdefghij", rng.randrange(1, 7)))) for i in range(60)] + [(100, "g", ""), (101, "g", None), (102, None, "a b")]
    got = {r.id: (r.class_id, r.n_links) for r in matching.near_sets(spark.createDataFrame(rows, "id int, g string, t string"), "g", "id", F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda x: x != ""), 0.6).collect()}
    sets = {i: frozenset(t.split()) for i, g, t in rows if t and g}
    cls = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    for i, s in sets.items():
        links = sum(1 for o in cls if o != s and len(o & s) / len(o | s) >= 0.6)
        assert got[i] == (cls[s], links)
    assert got[100] == (None, 0) and got[101] == (None, 0) and 102 not in got


def test_greedy_against_loop(spark):
    rng = random.Random(3)
    rows = [(f"p{rng.randrange(3)}", f"l{a}", f"r{b}", round(rng.random(), 1)) for a, b in itertools.product(range(6), range(6)) if rng.random() < 0.4]
    got = {(r.p, r.l, r.r) for r in matching.greedy_pairs(spark.createDataFrame(rows, "p string, l string, r string, s double"), ["p"], "l", "r", ["s"]).collect()}
    want, used = set(), set()
    for p, l, r, s in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):  # noqa: E741
        if (p, "l", l) not in used and (p, "r", r) not in used:
            want.add((p, l, r))
            used |= {(p, "l", l), (p, "r", r)}
    assert got == want


def test_chains_and_budgets(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", None)], "c string, p string")
    got = {r.node: r.survivor for r in ledger.survivors(m, "c", "p").collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "x": "x", "y": "x", "q": "q"}
    calls = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(10)], "t int, r string")
    got = {r.t: r.admitted for r in ledger.admitted(calls, "r", ["t"], {"a": 3, "b": 5}, 6).collect()}
    assert sum(got.values()) == 6 and not got[7]


def test_sampling(spark):
    d = spark.createDataFrame([(i, "s", i) for i in range(10)], "id int, g string, v int")
    got = {r.id: r.tercile for r in sampling.tercile(d, "g", "v", "id").collect()}
    want = pd.qcut(pd.Series(range(10)).rank(method="first"), 3, labels=["short", "medium", "long"]).tolist()
    assert [got[i] for i in range(10)] == want
    boot = sampling.bootstrap(d.withColumn("one", F.lit(1)), "id", ["one"], 300)
    assert 9 < boot.agg(F.avg("one")).first()[0] < 11


def test_kernels():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(4, 8)) * 6
    x = np.concatenate([c + rng.normal(size=(40, 8)) * 0.4 for c in centre])
    true = np.repeat(range(4), 40)
    for lab in (cluster.linkage(x, np.ones(160), 4), cluster.gmm_diagonal(x, 4, inits=6)["label"], cluster.hdbscan(x, 10, 5)[0]):
        assert len(set(zip(true, lab))) == 4, lab
    s = x @ x.T
    d = ((x[:, None] - x) ** 2).sum(2)
    nb = np.argsort(d, axis=1)[:, 1:6]
    a, b = np.repeat(range(160), 5), nb.ravel()
    assert len(set(zip(true, cluster.to_target(160, a, b, np.ones(len(a)), 4)[0]))) == 4 and s.shape
    g = rng.random((5, 7))
    best = max(sum(g[i, p[i]] for i in range(5)) for p in itertools.permutations(range(7), 5))
    assert sum(g[i, j] for i, j in cluster.assignment(g)) == pytest.approx(best)
    assert sum(g.T[i, j] for i, j in cluster.assignment(g.T)) == pytest.approx(best)
    assert np.bincount(cluster.balanced(rng.random((20, 4)), 5)).max() <= 5
    m = cluster.internal_metrics(x, true)
    assert m["silhouette"] > 0.8 and cluster.internal_metrics(x, np.zeros(160, int))["silhouette"] is None


def test_top_k_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(50, None)], "i long, v array<double>")
    got = {(r.q, r["rank"]): r.r for r in similarity.top_k(d.where("i % 10 = 0").withColumnRenamed("i", "q"), d.withColumnRenamed("i", "r"), "q", "r", "v", 3).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for q in range(0, 50, 10):
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(-s[q])[:3].tolist()


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    (tmp_path / "a.csv").write_text('Job ID,Some-Title\n1,"x\ny"\n2," "\n', encoding="utf-8")
    d = files.read_csv_text(spark, f"{p}/a.csv")
    assert d.columns == ["job_id", "some_title"] and [r.some_title for r in d.collect()] == ["x\ny", None]
    (tmp_path / "b.json").write_text('{"data": [{"slug": "s1", "n": 1}, {"slug": "s2", "n": 2}]}', encoding="utf-8")
    j = files.read_paged_json(spark, f"{p}/b.json", "struct<slug:string,n:int>").orderBy("index").collect()
    assert [r.record_ref for r in j] == ["b.json#data[0]", "b.json#data[1]"] and j[1].slug == "s2"
    (tmp_path / "c.jsonl").write_text('{"a": 1}\n{bad\n', encoding="utf-8")
    good, bad = files.read_jsonl(spark, f"{p}/c.jsonl", "a int")
    assert good.count() == 1
    files.publish(spark.range(3), f"{p}/t")
    files.publish(spark.range(5), f"{p}/t")
    assert spark.read.parquet(f"{p}/t").count() == 5
    files.replace_run(spark.range(4).withColumn("run", F.lit("a")), f"{p}/r", "run")
    files.replace_run(spark.range(2).withColumn("run", F.lit("b")), f"{p}/r", "run")
    files.replace_run(spark.range(1).withColumn("run", F.lit("a")), f"{p}/r", "run")
    assert spark.read.parquet(f"{p}/r").count() == 3
    calls = []
    compute = lambda m: calls.append(m.count()) or m.withColumn("y", F.col("id") * 2)
    files.cached_map(spark.range(3), "id", f"{p}/cache", compute)
    assert files.cached_map(spark.range(5), "id", f"{p}/cache", compute).agg(F.sum("y")).first()[0] == 20 and calls == [3, 2]
    checks = {r.file: r.status for r in files.validate(spark, f"{p}/a.csv").collect()}
    assert checks == {"a.csv": "ok"} and files.folder_digest(spark, f"{p}/a.csv").count() == 1
    v = spark.createDataFrame([("29.9",), ("29.10",), ("3.1",)], "v string").agg(files.newest_version(F.col("v")).alias("m")).first().m
    assert v == "29.10"


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, g string, t string, v array<double>")
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert matching.near_sets(e, "g", "id", F.split("t", " "), 0.5).count() == 0
    assert similarity.top_k(e.withColumnRenamed("id", "q"), e.withColumnRenamed("id", "r"), "q", "r", "v", 3).count() == 0
    assert ledger.survivors(spark.createDataFrame([], "c string, p string"), "c", "p").count() == 0


def test_ordered_concatenation_keeps_the_hot_group(spark, tmp_path):
    from quarrymill.plans.statements import ordered_concatenation

    rows = [("hot", f"s{i:04d}", "alpha", True) for i in range(2100)] + [("cold", "b", "alpha", True), ("cold", "a", "beta", True), ("cold", "c", "beta", False)]
    spark.createDataFrame(rows, "posting_id string, task_statement_id string, provider string, evidence_valid boolean").write.parquet(f"{tmp_path}/task_statements.parquet")
    got = {r.posting_id: (r.ids, r.n, r.providers) for r in ordered_concatenation(spark, str(tmp_path)).collect()}
    assert got == {"hot": (";".join(f"s{i:04d}" for i in range(2100)), 2100, 1), "cold": ("a;b", 2, 2)}


def test_greedy_compares_each_pair_of_providers(spark, tmp_path):
    from quarrymill.plans.statements import greedy_one_to_one

    rows = [("p", "alpha", "a1", "repair broken engines"), ("p", "beta", "b1", "repair broken engines"), ("p", "gamma", "g1", "repair broken engines"), ("p", "beta", "b2", "write weekly reports"), ("p", "gamma", "g2", "write weekly reports"), ("q", "beta", "b3", "write weekly reports")]
    spark.createDataFrame(rows, "posting_id string, provider string, task_statement_id string, atomic_task string").write.parquet(f"{tmp_path}/task_statements.parquet")
    got = {(r.provider_a, r.provider_b, r.a, r.b, r.score) for r in greedy_one_to_one(spark, str(tmp_path)).collect()}
    assert got == {("alpha", "beta", "a1", "b1", 1.0), ("alpha", "gamma", "a1", "g1", 1.0), ("beta", "gamma", "b1", "g1", 1.0), ("beta", "gamma", "b2", "g2", 1.0)}


def test_graph_links_every_row(spark):
    import oracle

    from quarrymill.plans.topics import graph_edge_shares, knn_edges

    n = spark.read.parquet(f"{oracle.DATA}/embeddings.parquet").count()
    ends = {x for r in knn_edges(spark, oracle.DATA).collect() for x in (r.a, r.b)}
    assert len(ends) == n and graph_edge_shares(spark, oracle.DATA).count() == n


def test_exact_neighbours_in_any_cells_and_blocks(spark):
    """Cells, blocks, ties, repeated rows and nulls: the same rows as brute force."""
    from quarrymill.operators import neighbours

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(3, 6))[rng.integers(0, 3, 150)] + 0.1 * rng.normal(size=(150, 6)), rng.normal(size=(40, 6)), np.ones((20, 6))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    d = spark.createDataFrame([*rows, (900, None), (None, rows[0][1])], "id long, v array<double>").withColumn("q", F.lit("clash")).withColumn("sim", F.lit(0))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    want = {(i, int(j), r + 1) for i in range(len(x)) for r, j in enumerate(np.argsort(-s[i], kind="stable")[:5])}
    for per_cell, block in ((1000, 4096), (30, 4096), (30, 16), (1000, 32)):
        got = neighbours.nearest(d, "id", "v", 5, per_cell, block).collect()
        assert {(r.q, r.r, r["rank"]) for r in got} == want and len(got) == len(want), (per_cell, block)
    assert neighbours.nearest(d.limit(0), "id", "v", 5).count() == 0
    assert neighbours.nearest(d.where("id < 3"), "id", "v", 5).count() == 6


def test_kernels_take_larger_tables_by_prototypes(spark, monkeypatch):
    """A table beyond a kernel's size gives every row its prototype's result; weights stand for rows."""
    from quarrymill.operators import cluster

    rng = np.random.default_rng(4)
    c = np.eye(4) * 5
    x = np.repeat(c, 60, axis=0) + 0.2 * rng.normal(size=(240, 4))
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    fit = lambda p, m: pd.DataFrame({"label": cluster.hdbscan(p, 20, 3, mult=m)[0].astype("int32"), "of": m})
    for most, fitted in ((1000, 256), (40, 256), (40, 8)):
        monkeypatch.setattr(cluster, "MOST_FITTED", fitted)
        got = cluster.on_points(d, "id", "v", fit, "label int, of long", most).toPandas().sort_values("id")
        assert len(got) == 240 and got["label"].nunique() == 4
        assert all(got["label"].to_numpy()[i * 60 : i * 60 + 60].min() == got["label"].to_numpy()[i * 60 : i * 60 + 60].max() for i in range(4))
    # repeated points and weighted points are the same
    p, m = x[::7], np.arange(len(x[::7])) % 3 + 1
    again = np.repeat(p, m, axis=0)
    assert (cluster.hdbscan(p, 8, 4, mult=m)[0][np.repeat(np.arange(len(p)), m)] == cluster.hdbscan(again, 8, 4)[0]).all()
    lab = np.arange(len(p)) % 2
    one, two = cluster.internal_metrics(p, lab, m), cluster.internal_metrics(again, np.repeat(lab, m))
    assert one["davies_bouldin"] == pytest.approx(two["davies_bouldin"]) and one["calinski_harabasz"] == pytest.approx(two["calinski_harabasz"]) and one["silhouette"] == pytest.approx(two["silhouette"])
