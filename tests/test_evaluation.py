"""Evaluation and alignment operators against literals and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import embed
from quarrymill.functions import text as T
from quarrymill.operators import evaluation


def test_pair_scores(spark):
    rows = [("g1", "a", "x"), ("g1", "a", "y"), ("g1", "b", "x"), ("g1", "b", "x"), ("g2", "a", "z"), ("g3", "b", "z"), (None, "a", "x"), ("g1", None, "x"), ("g1", "b", None)]
    d = spark.createDataFrame(rows, "g string, p string, t string").withColumn("a", F.lit(1)).withColumn("n", F.lit(1))
    (r,) = evaluation.pair_scores(d, "g", "p", "t").collect()
    assert (r.a, r.b, r.groups, r.matched) == ("a", "b", 3, 1)
    assert (r.precision_, r.recall, r.f1) == (0.5, pytest.approx(1 / 3, abs=1e-6), 0.4)
    assert (r.macro_precision, r.macro_recall) == (0.5, 0.25)
    assert evaluation.pair_scores(d.limit(0), "g", "p", "t").count() == 0


def test_first_failure_and_bins(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,), (None,)], "v double")
    why = evaluation.first_failure([("low", F.col("v") < 2), ("two", F.col("v") <= 2)], "rest")
    assert [r[0] for r in d.select(why).collect()] == ["low", "two", "two", "rest", "rest"]
    got = evaluation.quantile_bins(d, "v", 2).collect()
    assert [(r.v, r.bin) for r in got] == [(1.0, 1), (2.0, 1), (2.0, 1), (3.0, 2), (None, None)]


def test_ranks_and_permuted_labels(spark):
    d = spark.range(500).withColumn("label", (F.col("id") % 7).cast("string"))
    r = evaluation.global_rank(d, F.sha2(F.col("id").cast("string"), 256), "id").orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1, 501))
    import hashlib

    assert [x.id for x in r] == sorted(range(500), key=lambda i: hashlib.sha256(str(i).encode()).hexdigest())
    p = evaluation.permuted_labels(d, "id", "label", "s")
    assert sorted((r.label, r["count"]) for r in p.groupBy("label").count().collect()) == sorted((r.label, r["count"]) for r in d.groupBy("label").count().collect())
    assert p.select("id").distinct().count() == 500 and p.exceptAll(d).count() > 300
    assert evaluation.permuted_labels(d.limit(0), "id", "label", "s").count() == 0


def test_leave_one_out(spark):
    rng = np.random.default_rng(0)
    x, lab = rng.normal(size=(30, 5)), [i % 3 for i in range(29)] + [9]
    d = spark.createDataFrame([(i, lab[i], [float(v) for v in x[i]]) for i in range(30)] + [(99, 1, None), (98, None, [1.0] * 5)], "id long, l int, v array<double>").withColumn("label", F.lit("clash"))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array(lab)
    got = {r.id: r for r in evaluation.leave_one_out(d, "id", "v", "l").collect()}
    assert sorted(got) == list(range(30))
    for i, r in got.items():
        own = u[(lab == lab[i]) & (np.arange(30) != i)].sum(0)
        other = {c: float(u[i] @ u[lab == c].sum(0) / np.linalg.norm(u[lab == c].sum(0))) for c in set(lab.tolist()) - {int(lab[i])}}
        assert r.own_sim == (None if lab[i] == 9 else pytest.approx(float(u[i] @ own / np.linalg.norm(own)), abs=2e-6))
        assert r.other_sim == pytest.approx(max(other.values()), abs=2e-6) and other[r.other_label] == pytest.approx(max(other.values()), abs=2e-6)


def test_calibrated_margin(spark):
    d = spark.createDataFrame([(0.9, True), (0.5, True), (0.4, False), (0.1, True), (0.05, False), (None, True)], "m double, ok boolean")
    r = evaluation.calibrated_margin(d, F.col("m"), F.col("ok"), 0.75).first()
    assert (r.accuracy, r.margin, r.covered) == (0.6, 0.1, 0.8)
    assert evaluation.calibrated_margin(d.where("not ok"), F.col("m"), F.col("ok"), 0.75).first().margin is None


def test_hashed_vectors_and_encoder_cache(spark, tmp_path):
    assert embed.hashed(None, 8) is None and embed.hashed("  ?", 8) is None
    v = np.array(embed.hashed("Check the pumps", 64))
    assert v @ v == pytest.approx(1) and v @ np.array(embed.hashed("check THE pumps!", 64)) == pytest.approx(1)
    d = spark.createDataFrame([(1, "a b"), (2, None), (1, "a b")], "k int, t string")
    assert [r.v is None for r in d.select(embed.hashed_vector("t", 16).alias("v")).collect()] == [False, True, False]
    ones = lambda texts: np.ones((len(texts), 4))
    twos = lambda texts: 1 / 0
    path = "file://" + str(tmp_path / "cache")
    assert all(r.vector == [0.5] * 4 for r in embed.encoded(d, "k", "t", path, ones).collect())
    assert embed.encoded(d, "k", "t", path, twos).count() == 3


def test_languages_and_counts_in_text(spark):
    common = {"en": "the and of", "de": "der die und"}
    d = spark.createDataFrame([(["the", "cat", "and"],), (["der", "the"],), ([],), (["die", "und", "of"],)], "w array<string>")
    assert [r[0] for r in d.select(T.language_by_words(F.col("w"), common)).collect()] == ["en", None, None, "de"]
    d = spark.createDataFrame([("Make 12 topics",), ("topics 12",), (None,), ("about 3 groups.",)], "t string")
    assert [r[0] for r in d.select(T.tells_a_count(F.col("t"), ["topics", "groups"])).collect()] == [True, False, False, True]


def test_check_table(spark):
    d = spark.range(3)
    got = {r.name: (r.ok, r.failures) for r in evaluation.check_table([("none", d.agg(F.count_if(F.col("id") > 5).alias("n"))), ("some", d.agg(F.count("*").alias("n")))]).collect()}
    assert got == {"none": (True, 0), "some": (False, 3)}
