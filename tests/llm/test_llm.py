"""Training-data operators against brute force, round trips and hard cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrymill.llm import boilerplate, canonical, clusters, formatting, languages, linkage, markup, mixing, neighbours, packing, spans
from quarrymill.llm.tokens import encoder

MODEL = "m"


def emb(spark, x, extra=()):
    rows = [(f"k{i:04d}", MODEL, len(v), [float(a) for a in v]) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "k string, model string, dims int, v array<float>").withColumn("id", F.lit("clash")).withColumn("cos", F.lit(0))


HARD = [("n", MODEL, 8, None), ("e", MODEL, 8, []), ("s", MODEL, 8, [1.0]), ("z", MODEL, 8, [0.0] * 8), ("f", MODEL, 8, [float("nan")] * 8), ("o", "other", 8, [1.0] * 8), ("u", MODEL, 8, [None] * 8)]


def groups(seed=0, n=40, d=8):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(5, d))
    return np.concatenate([m + rng.normal(size=(n // 5, d)) * 0.05 for m in c] + [rng.normal(size=(10, d))]) * rng.uniform(0.5, 3, (n + 10, 1))


def test_neighbours_and_clusters(spark):
    x = groups()
    d = emb(spark, x, HARD)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i])[:5]:
            if s[i, j] >= 0.7:
                want.add((min(i, j), max(i, j)))
    got = {(r.k_a, r.k_b) for r in neighbours.similar_pairs(d, MODEL).collect()}
    assert got == {(f"k{a:04d}", f"k{b:04d}") for a, b in want}
    comp = list(range(len(x)))
    for _ in range(len(x)):
        for i in range(len(x)):
            for j in np.flatnonzero(s[i] >= 0.7):
                comp[i] = comp[j] = min(comp[i], comp[j])
    want = {(f"k{i:04d}", f"k{c:04d}") for i, c in enumerate(comp) if comp.count(c) > 1}
    assert {tuple(r) for r in clusters.found(d, MODEL).collect()} == want
    sizes = clusters.Clusters(d, MODEL).described()
    assert sizes.agg(F.sum("size")).first()[0] == len(want)
    empty = d.limit(0)
    assert neighbours.similar_pairs(empty, MODEL).count() == 0 and clusters.found(empty, MODEL).count() == 0


def test_hot_cell_is_split(spark):
    x = groups(1, 200)
    whole = {(r.k_a, r.k_b) for r in neighbours.similar_pairs(emb(spark, x), MODEL).collect()}
    near = neighbours.most_similar(emb(spark, x), MODEL, block=32)
    ids = {r.id: r.k for r in emb(spark, x).select(F.xxhash64("k").alias("id"), "k").collect()}
    split = {tuple(sorted((ids[r.id], ids[r.other]))) for r in near.collect()}
    assert split == whole


def test_additive_codes_recall():
    rng = np.random.default_rng(2)
    c = rng.normal(size=(20, 32))
    x = np.concatenate([m + rng.normal(size=(60, 32)) * 0.2 for m in c]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = neighbours.AdditiveQuantiser(8, entries=64, first=64).fit(x)
    codes = q.encode(x)
    err = ((x - q.decode(codes)) ** 2).sum(1).mean()
    assert err < 0.1
    score = q.table_scores(x[:5], codes, 0.5 * (q.decode(codes) ** 2).sum(1))
    np.testing.assert_allclose(score, x[:5] @ q.decode(codes).T - 0.5 * (q.decode(codes) ** 2).sum(1), atol=1e-4)


def test_spans_against_brute_force(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    p = [text(60) for _ in range(4)]
    docs = [(i, text(20) + " " + rng.choice(p) + rng.choice(["", " ", "\r\n"]) + text(20) + (rng.choice(p) if i % 3 == 0 else "")) for i in range(25)]
    docs += [(90, None), (91, ""), (92, "short"), (93, docs[0][1]), (94, text(3000)), (95, p[0] + text(9) + p[0]), (96, "ü😀" * 300), (97, "x" + "ü😀" * 200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("h", F.lit(1))
    got = {tuple(r) for r in spans.shared_spans(d).collect()}
    where: dict[str, set] = {}
    for i, t in docs:
        for s in range(len(t or "") - 199):
            where.setdefault(t[s : s + 200], set()).add(i)
    want = set()
    for i, t in docs:
        hit = [s for s in range(len(t or "") - 199) if len(where[t[s : s + 200]]) > 1]
        while hit:
            a = b = hit[0]
            while hit and hit[0] <= b + 200:
                b = hit.pop(0)
            want.add((i, a, b + 200))
    assert got == want
    share = {r.doc_id: r for r in spans.shared_share(d, spans.shared_spans(d)).collect()}
    assert share[93].shared_share == 1.0 and share[90].shared_chars == 0 and len(share) == len(docs)
    assert spans.shared_spans(d.limit(0)).count() == 0


def test_span_slices_of_any_size(spark, monkeypatch):
    """A passage that every text holds, read in slices of few windows: the same spans as in one."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = text(260), text(230)
    docs = [(i, text(rng.randrange(90)) + p + text(rng.randrange(300)) + (q if i % 7 == 0 else "") + (p if i % 5 == 0 else "")) for i in range(40)] + [(90, q + text(30) + q), (91, text(500))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3, "doc_id")
    whole = sorted(tuple(r) for r in spans.shared_spans(d).collect())
    monkeypatch.setattr(spans, "HELD", 300)
    assert sorted(tuple(r) for r in spans.shared_spans(d).collect()) == whole
    ends = {i: t.find(p) for i, t in docs[:40]}
    assert all(any(r[0] == i and r[1] <= s and r[2] >= s + 260 for r in whole) for i, s in ends.items())
    assert not any(r[0] == 91 for r in whole)


def test_formatting(spark):
    rows = [("p1", "Baker", "ACME Ltd.", "Bake <bread>!"), ("p2", "acme ltd", "BAKER", "bake bread"), ("p3", "Baker", "ACME", "Bake bread"), ("p4", None, "x", "y"), ("p5", "X", "", "Y."), ("p6", "a", "b", None), ("p2", "other", "job", "z"), ("p7", "JOB", "other", "Z"), ("p1", "Baker", "ACME Ltd.", "Bake <bread>!"), (None, "a", "b", "c"), ("p8", "ﬁne", "co", "①"), ("p9", "FINE", "Co", "1")]
    d = spark.createDataFrame(rows, "posting_id string, job_title string, company_name string, description string").withColumn("id", F.lit(0)).withColumn("key", F.lit(0))
    got = {(r.leader, r.id) for r in formatting.copies(d, "posting_id", ["job_title", "company_name", "description"], "description").collect()}
    assert got == {("p1", "p2"), ("p1", "p7"), ("p4", "p5"), ("p8", "p9")}
    n = {r.posting_id: r.copies for r in formatting.collapsed(d, "posting_id", ["job_title", "company_name", "description"], "description").collect()}
    assert n["p1"] == 3 and n["p3"] == 1 and sum(n.values()) == 8
    assert formatting.copies(d.limit(0), "posting_id", ["job_title"], "description").count() == 0


def postings(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(60)] for _ in range(30)]
    rows = []
    for b in range(5):
        for _ in range(20):
            t = list(rng.choice(base))
            for _ in range(rng.choice([0, 1, 3, 9, 30])):
                t[rng.randrange(60)] = rng.choice(vocab)
            rows.append((f"p{rng.randrange(150)}", f"b{b}", " ".join(t), "title", "firm"))
    return [*rows, ("n1", "b0", None, None, None), ("n2", "b1", "", None, None), ("n3", "b2", "two words", None, None), (None, "b3", rows[0][2], None, None), ("p1", None, "x", None, None)]


def brute(rows):
    sh = lambda t: set(zip(*[linkage.words(t)[i:] for i in range(3)])) if t else set()
    out = set()
    for i, b, t, *_ in rows:
        if i is None or b is None:
            continue
        for j, c, u, *_ in rows:
            if c is not None and c < b and (i == j or (sh(t) and sh(u) and len(sh(t) & sh(u)) / len(sh(t) | sh(u)) >= 0.6)):
                out.add((b, i))
    return out


def components(rows):
    """Ids joined by equal ids and similar texts, also through others; ids with a text only."""
    sh = lambda t: set(zip(*[linkage.words(t)[i:] for i in range(3)])) if t else set()
    live = [(i, sh(t)) for i, b, t, *_ in rows if b is not None and sh(t)]
    links = [(k, m) for k, (i, s) in enumerate(live) for m, (j, u) in enumerate(live[:k]) if (i is not None and i == j) or len(s & u) / len(s | u) >= 0.6]
    node, before = list(range(len(live))), None
    while node != before:
        before = node[:]
        for k, m in links:
            node[k] = node[m] = min(node[k], node[m])
    out = {}
    for k, (i, _) in enumerate(live):
        if i is not None:
            out.setdefault(node[k], set()).add(i)
    return {frozenset(v) for v in out.values()}


COLS = ("posting_id", "retrieval_id", "description", "job_title", "company_name")


def test_batches_and_history(spark, tmp_path):
    rows = postings()
    d = spark.createDataFrame(rows, "posting_id string, retrieval_id string, description string, job_title string, company_name string").withColumn("id", F.lit(1)).withColumn("cls", F.lit(1))
    want = brute(rows)
    whole = linkage.History(spark)
    got = whole.ingest(d, *COLS).collect()
    assert {(r.retrieval_id, r.posting_id) for r in got if r.seen} == want
    assert len(got) == len({(r[1], r[0]) for r in rows if r[0] is not None and r[1] is not None})
    by = {}
    for r in whole.clusters().collect():
        by.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(v) for v in by.values()} == components(rows) and all(min(v) == c for c, v in by.items())
    empty = linkage.History(spark)
    assert empty.ingest(d.limit(0), *COLS).count() == 0 and empty.clusters().count() == 0
    # several calls, in a folder that another session finds again: the same rows and clusters
    found = set()
    for part in (["b0", "b1"], ["b2"], ["b3", "b4"]):
        out = linkage.History(spark, "file://" + str(tmp_path)).ingest(d.where(F.col("retrieval_id").isin(part)), *COLS)
        found |= {(r.retrieval_id, r.posting_id) for r in out.where("seen").collect()}
    assert found == want
    again = linkage.History(spark, "file://" + str(tmp_path))
    assert {(r.id, r.cluster) for r in again.clusters().collect()} == {(r.id, r.cluster) for r in whole.clusters().collect()}
    # a batch that comes again does not count against itself
    once = again.ingest(d.where(F.col("retrieval_id") == "b1"), *COLS)
    assert {(r.retrieval_id, r.posting_id) for r in once.where("seen").collect()} == {w for w in want if w[0] == "b1"}
    # what a call that failed has left is cleared
    left = tmp_path / f"run-{len(again.runs()):06d}" / "rows"
    left.mkdir(parents=True)
    assert len(again.runs()) == 4 and again.batches().where("name is not null").count() == 5
    again.ingest(d.limit(0), *COLS)
    assert len(again.runs()) == 5 and again.rows().count() == again.rows(again.runs()[:4]).count()


def test_hot_keys_are_not_gathered(spark, monkeypatch):
    """Members of hot keys meet the leader without being collected by their key; the links are the same."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(300):
        t = base[:]
        t[rng.randrange(60)] = f"x{i}"
        rows.append((f"p{i:03d}", f"b{i % 5}", " ".join(t), "title", None))
    rows += [(f"q{i}", "b4", " ".join(rng.choice(base) for _ in range(40)), None, "firm") for i in range(20)]
    d = spark.createDataFrame(rows, "posting_id string, retrieval_id string, description string, job_title string, company_name string").repartition(3)
    plain = {tuple(r) for r in linkage.History(spark).ingest(d, *COLS).collect()}
    monkeypatch.setattr(linkage, "HOT", 8)
    monkeypatch.setattr(linkage, "CHUNK", 32)
    monkeypatch.setattr(linkage, "SLICE", 64 * linkage.BANDS)
    hot = linkage.History(spark)
    assert {(r[0], r[1], r[2]) for r in hot.ingest(d, *COLS).collect()} == {(r[0], r[1], r[2]) for r in plain}
    assert spark.read.parquet(hot.ws.path("led")).where("kind = 2").count() > 0
    assert {(r[0], r[1]) for r in plain if r[2]} == brute(rows)


def test_learned_weights(spark):
    rows = [("p1", "b0", "one two three four", "baker", "x"), ("p1", "b1", "one two three five", "Baker!", "y"), ("p2", "b0", "six seven eight", "cook", "x"), ("p3", "b0", "nine ten eleven", None, "z")]
    h = linkage.History(spark)
    h.ingest(spark.createDataFrame(rows, "posting_id string, retrieval_id string, description string, job_title string, company_name string"), *COLS).collect()
    # one pair of versions: the title agrees, the company differs; random pairs agree by (4 + 1) / 9 and (4 + 1 + 1) / 16
    m, u = 2 / 3, (5 + 1) / (9 + 2)
    assert h.weights["title"] == pytest.approx((np.log(m / u), np.log((1 - m) / (1 - u))))
    m, u = 1 / 3, (6 + 1) / (16 + 2)
    assert h.weights["company"] == pytest.approx((np.log(m / u), np.log((1 - m) / (1 - u))))


def test_markup():
    cases = {
        "<p>x</p>": ["html"], "a &amp;lt;b&amp;gt; c": ["html"], "R&D & more": [], "&#8211;": ["html"], "x <!-- c --> y": ["html"], "3 < 4 > 2, <336> y": [],
        "# Title": ["markdown"], "#30493 #tag": [], "**bold**": ["markdown"], "Prüfer*in und Leiter*in": [], "3 * 4 * 5 = x_1": [], "[a](https://b.c)": ["markdown"], "Text\n=====\n": ["markdown"], "- a\n- b\n* c\n1. d": [], "shift_plan_2_v2.xlsx": [], "|---|---|": ["markdown"], "`x`": ["markdown"],
        "'''b'''": ["wiki"], "[[Page|text]]": ["wiki"], "== Head ==": ["wiki"], "{{note|x}}": ["wiki"], "{|\n|-\n|}": ["wiki"], "l'eau d'ici": [], "[B-844] * x": [],
        "\\textbf{x}": ["latex"], "$x_1 \\leq 3$": ["latex"], "($4,870 - $5,870)": [], "($4,870 - $5,870). 3 * 2 = x_1 ($3)": [], "50% \\ 269": [], "\\[ E = m c^{2} \\]": ["latex"], "a ~ 3 => 4 {A}": [], "C:\\new\\files": [],
    }
    for text, want in cases.items():
        assert markup.kinds(text) == want, text
    assert markup.kinds(None) == [] and markup.kinds("") == []
    out = markup.clean("<h2>Tasks</h2><ul><li>One &amp; two<li>Three</ul><pre><code>run</code></pre>")
    assert out == "## Tasks\n\n- One & two\n- Three\n\n```\nrun\n```"
    assert markup.clean("== A ==\n'''b''' [[C|d]]").split("\n\n") == ["## A", "b d"] and markup.clean(None) is None
    assert markup.clean("\\section{A}\n\\begin{itemize}\n\\item x\n\\end{itemize}\n\\[ y^2 \\]").split("\n\n")[0] == "# A"


def test_residue(spark):
    d = spark.createDataFrame([("p1", "<b>x</b>", "plain"), ("p1", "<b>x</b>", "**y**"), (None, "<b>", "z"), ("p2", None, None)], "posting_id string, description string, job_title string")
    assert {tuple(r) for r in markup.residue(d, "posting_id", ["description", "job_title"]).collect()} == {("p1", "description", "html"), ("p1", "job_title", "markdown")}
    assert markup.cleaned(d, ["posting_id"], ["job_title", "description"]).count() == 4


SENT = {
    "en": "The team in the main office {} keeps the records of all visits up to date every week and answers within two days.",
    "de": "Die Werkstatt am Standort {} betreut die Maschinen und hält die Unterlagen jede Woche auf dem neuesten Stand.",
    "fr": "L'équipe du chantier {} traite les demandes de tous les visiteurs et tient les dossiers à jour chaque semaine.",
    "es": "La oficina de la sede {} tramita las peticiones del año y mantiene al día las listas de existencias cada semana.",
    "nl": "Het team op de locatie {} behandelt de aanvragen van het jaar en houdt de dossiers elke week zorgvuldig bij.",
}


def test_languages(spark):
    rng = random.Random(4)
    noun = lambda: "".join(rng.choice(["ka", "lo", "mi", "tov", "sul"]) for _ in range(3)).title()
    rows = [(f"{l}{i}", l, "Job", "Job\n\n" + " ".join(s.format(noun()) for _ in range(3))) for l, s in SENT.items() for i in range(12)]
    rows += [("mix", "en", "Job", "Job\n\n" + SENT["en"].format("A") + "\n" + SENT["de"].format("B")), ("none", None, "Job", SENT["fr"].format("C")), ("wrong", "it", "Job", SENT["es"].format("D")), ("empty", "en", "Job", ""), ("null", "en", None, None), ("head", "en", "Job", "Über uns:\n\n" + SENT["en"].format("E"))]
    d = spark.createDataFrame(rows, "posting_id string, language string, job_title string, posting_text string").withColumn("segments", F.lit(1))
    m = languages.train(d, "posting_text", "language", "job_title")
    got = {tuple(r) for r in languages.mislabelled(d, "posting_id", "posting_text", "language", "job_title", m).collect()}
    assert got == {("mix", "en"), ("mix", "de"), ("none", "fr"), ("wrong", "es")}
    main = {r.posting_id: r for r in languages.languages(d.drop("segments"), "posting_id", "posting_text", "language", "job_title", m).collect()}
    assert main["fr1"].lang == "fr" and main["fr1"].confidence > 0 and main["null"].lang is None and len(main["mix"].segments) == 2


def test_edit_metric_and_tree(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(150)]

    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, prev = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        return row[-1]

    for a, b in zip(words, words[1:]):
        assert canonical.edit_distance(a, b) == slow(a, b)
    tree = canonical.BKTree(words)
    for q in ("abc", "", "cccc", "abcabca"):
        assert tree.within(q, 2) == sorted((slow(q, w), w) for w in set(words) if slow(q, w) <= 2)
    vals = spark.createDataFrame([("abca",), ("zzzzzzzz",), (None,)], "v string")
    refs = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    got = {r.value: r for r in canonical.match_values(vals, "v", refs, "w", 2, shard_entries=40).collect()}
    want = sorted((slow("abca", w), w) for w in set(words) if slow("abca", w) <= 2)
    assert (got["abca"].distance, got["abca"].entry) == want[0] and got["abca"].candidates == len(want) and got["zzzzzzzz"].entry is None


def test_matchers():
    entries = [(f"{f}-{k}", f"{f} {k}", "\n".join([f"{dk[k]} {df[f]}"])) for f in ("bakery", "cold storage", "museum") for k in ("adviser", "engineer", "manager") for dk, df in [({"adviser": "Berater", "engineer": "Ingenieur", "manager": "Leiter"}, {"bakery": "Bäckerei", "cold storage": "Kühllager", "museum": "Museumsbetrieb"})]]
    m = canonical.LabelMatcher(entries)
    for text, want in {"Senior Bakery Adviser (m/w/d)": "bakery-adviser", "advisr, bakrey": "bakery-adviser", "Beraterin im Bereich Kühllager - Ostkal": "cold storage-adviser", "museum mgr.": "museum-manager", "Cold Storage Eng.": "cold storage-engineer", "storage engineer": None, "cod storage engineer - ostkal": "cold storage-engineer", "bakery mangaer": "bakery-manager", "bakery anviserr": "bakery-adviser", "museum engg": "museum-engineer", "manager museun": "museum-manager", "lighthouse manager": None, "bakery keeper": None, "lighthouse keeper": None, "museum": None, "": None, None: None}.items():
        assert m(text) == want, text
    ends = ["on a weekly basis", "for the regional office"]
    tasks = [(str(i), f"{v} {o} {ends[i % 2]}.") for i, (v, o) in enumerate((v, o) for v in ("Count", "Order", "Archive") for o in ("pump station logbooks", "seed tray labels", "storm damage folders", "parking meter cash boxes"))]
    t = canonical.TaskMatcher(tasks)
    for text, want in {"You will tally each pump sttaion logbook (30 per month)": "0", "Labels of the seed tray - buy for the regional office": "5", "Put on file storm damage folders": "10", "count harp strings": None, "perform other duties": None, "": None, None: None}.items():
        assert t(text) == want, text


def docs(spark, n=60, seed=6):
    rng = random.Random(seed)
    vocab = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 20, 60, 200]))), rng.choice("abc")) for i in range(n)]
    return spark.createDataFrame([*rows, (900, None, "a"), (901, "", "b"), (902, rows[0][1], "a"), (903, " ".join(vocab * 6), None)], "doc_id long, text string, source string")


def test_packing(spark):
    d = docs(spark)
    specs = spark.createDataFrame([(1, 64), (2, 512), (3, None)], "spec_id int, capacity_tokens int")
    p = packing.pack(d, specs, per_shard=1000).toPandas()
    enc = encoder()
    size = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in d.collect() if r.text}
    for spec, cap in ((1, 64), (2, 512)):
        q = p[p.spec_id == spec]
        assert q.groupby("container").n_tokens.sum().max() <= cap
        assert q.groupby("doc_id").n_tokens.sum().to_dict() == size
        for i, g in q.groupby("doc_id"):
            g = g.sort_values("start_token")
            assert len(g) == max(1, -(-size[i] // cap)) and (g.start_token.to_numpy() == np.concatenate([[0], g.n_tokens.cumsum()[:-1]])).all()
        # as full as first-fit decreasing, which knows nothing of the texts
        bins = []
        for x in sorted((v % cap for v in size.values() if v % cap), reverse=True):
            at = next((i for i, b in enumerate(bins) if b + x <= cap), None)
            if at is None:
                bins.append(x)
            else:
                bins[at] += x
        assert q.container.nunique() <= sum(v // cap for v in size.values()) + len(bins)
    assert packing.fill_report(packing.pack(d, specs), specs).count() == 2
    assert packing.pack(d.limit(0), specs).count() == 0


def test_mixing(spark):
    d = docs(spark, 400)
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.3, 4), ("m", "c", 0.2, 1), ("m", "gone", 0.1, 1), ("x", "a", 1.0, 3)], "mix_id string, source string, target_share double, max_repeats int")
    m = mixing.mix(d, targets)
    s = {(r.mix_id, r.source): r for r in mixing.shares(m, targets).collect()}
    for src, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(s["m", src].reached_share - share) < 0.02
    assert s["m", "a"].most_repeats <= 2 and s["m", "c"].most_repeats <= 1 and s["m", "gone"].tokens == 0 and s["x", "a"].most_repeats == 3
    p = m.toPandas()
    assert not p.duplicated(["mix_id", "doc_id", "pass"]).any()
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.mix(d, targets.limit(0)).count() == 0
    quota = np.array([7, 20, 0, 5])
    t = mixing.split_tree(quota, 5, np.random.default_rng(1))
    assert (t.sum(0) == quota).all() and t.sum(1).max() - t.sum(1).min() <= 1


def test_large_shards_are_ordered_in_parts(spark, monkeypatch):
    d = docs(spark, 300)
    targets = spark.createDataFrame([("m", "a", 0.5, 2), ("m", "b", 0.5, 2)], "mix_id string, source string, target_share double, max_repeats int")
    one = mixing.mix(d, targets).toPandas()
    monkeypatch.setattr(mixing, "PART_TEXTS", 20)
    many = mixing.mix(d, targets).toPandas()
    key = ["mix_id", "shard", "doc_id", "pass", "n_tokens"]
    assert sorted(map(tuple, one[key].values)) == sorted(map(tuple, many[key].values))
    for _, p in many.groupby(["mix_id", "shard"]):
        assert sorted(p["position"]) == list(range(len(p)))
    # a block that crosses its quota gives texts up to it, in whatever steps
    got = mixing._upto_quota(spark.range(5000).selectExpr("id", "'m' as mix_id", "'s' as source", "0 as block", "0 as pass", "3 as n_tokens", "6000.0 as quota"))
    assert got.count() == 2000


def test_boilerplate_in_slices(spark, monkeypatch):
    common = " ".join(f"b{i}" for i in range(30))
    rows = [(i, "h" if i % 2 else "k", f"u{i} v{i} {common} x{i} {'again ' + common if i % 5 == 0 else ''}") for i in range(60)] + [(90, "two", f"a {common}"), (91, "two", f"b {common}"), (92, "two", f"b {common}")]
    d = spark.createDataFrame(rows, "id int, host string, text string").repartition(2)
    whole = sorted(tuple(r) for r in boilerplate.unique_runs(d, "host", "id", "text").collect())
    monkeypatch.setattr(boilerplate, "HELD", 60)
    assert sorted(tuple(r) for r in boilerplate.unique_runs(d, "host", "id", "text").collect()) == whole
    by = {r[0]: r for r in whole}
    assert all(by[i][2] == (61 if i % 5 == 0 else 30) for i in range(60)) and by[90][2] == by[92][2] == 0


def test_boilerplate(spark):
    common = " ".join(f"b{i}" for i in range(30))
    rows = [(i, "h", f"u{i} v{i} {common} x{i} y{i}") for i in range(4)] + [(9, "other", f"q {common}"), (10, None, common), (11, "h", None), (12, "h", "")]
    got = {r.id: r for r in boilerplate.unique_runs(spark.createDataFrame(rows, "id int, host string, text string"), "host", "id", "text").collect()}
    assert got[0].boilerplate_tokens == 30 and got[0].unique_text == "u0 v0\nx0 y0"
    assert got[9].boilerplate_tokens == 0 and got[10].boilerplate_tokens == 0 and got[11].unique_text is None and len(got) == 8


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "p10_found"])
def test_equals_sql(spark, name):
    import oracle

    from quarrymill.llm.queries import ORACLE, QUERIES

    oracle.compare(spark, oracle.DATA, name, QUERIES[name], ORACLE[name])


def test_word_positions_survive_batches():
    pdf = pd.Series(["a b c d", ""])
    assert [linkage.shingle_set(linkage.words(t), 3, {}).size for t in pdf] == [2, 0]


def test_packing_asks_with_all_terms(spark):
    own = " ".join(f"own{i}" for i in range(30))
    texts = {1: f"{own} alpha beta gamma delta", 2: "alpha beta gamma delta", 3: " ".join(f"far{i}" for i in range(4)) + " faraway", 4: "gamma delta"}
    size = {k: len(encoder().encode_ordinary(t)) for k, t in texts.items()}
    assert size[1] > size[3] > size[2]
    specs = spark.createDataFrame([(1, size[1] + size[3])], "spec_id int, capacity_tokens int")
    p = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), specs).toPandas()
    # the thirty words of the seed alone find nobody; the words it shares do, before the best fit
    box = p[p.container == p[p.doc_id == 1].container.iloc[0]].sort_values("position")
    assert box.doc_id.tolist()[:2] == [1, 2] and 3 not in set(box.doc_id)


def test_shard_scores_against_brute_force():
    rng = np.random.default_rng(4)
    terms = [np.unique(rng.zipf(1.3, 40) % 500) for _ in range(300)] + [np.zeros(0, np.int64)]
    tf = [rng.integers(1, 5, len(t)) for t in terms]
    length = np.array([max(1, int(f.sum())) for f in tf])
    idf = rng.uniform(0.1, 5, 500).astype(np.float32)
    s = packing.Shard(terms, tf, length, idf, float(length.mean()))
    for i in (0, 17, 255, 256, 300):
        for j in range(len(terms)):
            m = np.isin(terms[j], terms[i])
            f = tf[j][m]
            want = (idf[terms[j][m]] * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length[j] / length.mean()))).sum()
            assert i == j or abs(s.scores(i)[j] - want) < 1e-3


def test_packing_hashes_words_together():
    import re
    import sys
    import zlib

    rng = random.Random(8)
    odd = ["a", "B", "7", "é", "Σ", "İ", "ß", "中", "𝔘", "😀", "\u0301", "٣", "½", "_", "-", " ", "\n", "\0", "\ud800"]
    texts = ["", "!", "x" * 64, "é" * 32 + " " + "é" * 33, "z" * 70_000, "ab é," * (packing.CHUNK // 2), "ab c" * packing.CHUNK, "q" * (packing.CHUNK + 9), "ΑΣ", "Σ", *("".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(500)), ""]
    want = [(i, zlib.crc32(w.encode("utf-8", "surrogatepass"))) for i, t in enumerate(texts) for w in re.findall(r"\w+", t.lower())]
    assert list(zip(*(x.tolist() for x in packing.word_hashes(texts)))) == want
    assert [len(x) for x in packing.word_hashes([])] == [0, 0]
    assert list(packing._chunks(["ab"] * 3 + ["c" * packing.CHUNK, "", "d"])) == [slice(0, 4), slice(4, 6)]
    assert max(map(len, packing._pieces("ab " * packing.CHUNK))) <= packing.CHUNK + 2
    # no call for each word, nor for each distinct one
    calls = 0

    def count(frame, event, what):
        nonlocal calls
        calls += event in ("call", "c_call")

    many = [" ".join(f"w{i}x{j}" for j in range(1000)) for i in range(20)]
    sys.setprofile(count)
    try:
        owner, _ = packing.word_hashes(many)
    finally:
        sys.setprofile(None)
    assert len(owner) == 20_000 and calls < 2_000


def test_packing_features_against_counts(spark):
    import re
    import zlib
    from collections import Counter

    texts = {1: "Ab ab, AB é_1 é_1", 2: "...", 3: "x " * 40_000, 4: "ΑΣ ας İ 😀 中文", 5: "", 6: None, 7: "w" * 200 + " w"}
    got = packing.features(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted(r.id for r in got) == [1, 2, 3, 4, 7]
    for r in got:
        want = Counter(zlib.crc32(w.encode()) & (packing.BUCKETS - 1) for w in re.findall(r"\w+", texts[r.id].lower()))
        assert r.terms == sorted(want) and r.tf == [min(want[t], 32767) for t in r.terms]
        assert r.n_tokens == len(encoder().encode_ordinary(texts[r.id]))


def test_unique_runs_takes_every_version(spark, tmp_path):
    from quarrymill.llm.queries import QUERIES

    common = " ".join(f"b{i}" for i in range(30))
    rows = [("a", "h", f"one {common}"), ("a", "h", f"two {common} edited"), ("a", "h", f"two {common} edited"), ("b", "h", f"three {common}"), ("c", None, "x"), ("c", "", "x"), ("d", "h", None)]
    spark.createDataFrame(rows, "posting_id string, company_name string, description string").write.parquet(f"{tmp_path}/job_postings.parquet")
    got = QUERIES["p6_unique_runs"](spark, str(tmp_path)).collect()
    # the two versions of a are pages of their own, so the run is on three pages
    assert sorted((r.posting_id, r.boilerplate_tokens, r.unique_text) for r in got) == [("a", 30, "one"), ("a", 30, "two\nedited"), ("b", 30, "three"), ("c", 0, "x"), ("c", 0, "x")]
    assert len({r.page for r in got}) == 5


def test_full_lists_of_copies_hide_no_link(spark):
    # two sets of 15 copies at a cosine of 0.75, one of exact and one of near copies; a third set stays apart
    rng = np.random.default_rng(2)
    at = lambda c: np.array([c, np.sqrt(1 - c * c), 0, 0, 0, 0, 0, 0])
    near = at(0.75) + np.concatenate([np.zeros((15, 2)), rng.normal(size=(15, 6)) * 0.005], 1)
    apart = np.tile([0.0, 0, 0, 1, 0, 0, 0, 0], (15, 1))
    x = np.concatenate([np.tile(at(1.0), (15, 1)), near, apart])
    e = emb(spark, x, HARD)
    got = {r.k: r.cluster_key for r in clusters.found(e, MODEL).collect()}
    assert got == {f"k{i:04d}": "k0000" if i < 30 else "k0030" for i in range(45)}


def test_group_links_against_brute_force():
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 4)), rng.integers(1, 4, 60), 0).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    for home in (len(x), len(x) // 2):
        a, b = np.nonzero(np.triu(s >= 0.98, 1))
        i, j, w = clusters.group_links(x, home, a, b, 0.9, chunk=16)
        assert (s[i, j] >= 0.9 - 1e-6).all() and np.allclose(w, s[i, j], atol=1e-5)
        p, q = np.nonzero(np.triu((s >= 0.9), 1))
        met = p < home
        want = clusters._components(len(x), np.concatenate([a, p[met]]), np.concatenate([b, q[met]]))
        assert (clusters._components(len(x), np.concatenate([a, i]), np.concatenate([b, j])) == want).all()
