"""Languages of documents and of their sentences, by nearest centroid over TF-IDF character trigrams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.markup import TAG, unescape

LANGS = ("en", "de", "fr", "es", "nl")
#: Labelled texts a language that the centroids are fitted on, in the order of their hashes; all texts are classified.
SAMPLE_PER_LANGUAGE = 400
# Letters with a class of their own; other letters share one.
_LETTERS = "abcdefghijklmnopqrstuvwxyz'àâáäãåæçèéêëìíîïñòóôöõøùúûüÿœß"
_CLASSES = 64

_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|br|table|tr|td|th|section|pre|code|hr|blockquote)(?:\s[^<>]*)?/?>", re.I)
_DROP = re.compile(r"<(script|style|code)\b[^>]*>.*?</\1>|```.*?```|\\begin\{(verbatim|equation)\}.*?\\end\{\2\}|<!--.*?-->", re.S | re.I)
_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+\)|\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]|\[https?://\S+ ([^\]\n]+)\]")
_LATEX = re.compile(r"\\\[.*?\\\]|\$[^$\n]*[\\_^][^$\n]*\$|~?\\(?:cite|ref|label|footnote)\{[^{}]*\}|\\item\b|\\[A-Za-z]+\*?\{|\{\{[^{}]*\}\}", re.S)
_HEAD = re.compile(r"^\s*(?:#{1,6} .*|=+ .* =+|.*:)\s*$")
_END = re.compile(r"(?<=[.!?…])[\"'»”)\]*_}]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LEAD = re.compile(r"^[\s\-–—•·*#>|!:;.\d()]+")


def sentences(text: str | None, title: str | None = None, words: int = 5) -> list[str]:
    """Whole sentences: pieces that end with a full stop, question or exclamation mark and have ``words`` words.

    Markup, code and formulas are left out, headings and the title are no sentences.
    """
    if not text:
        return []
    if title and text.startswith(title):
        text = text[len(title) :]
    text = unescape(text)
    text = _DROP.sub("\n", text)
    text = TAG.sub("", _BLOCK.sub("\n", text))
    text = _LINK.sub(lambda m: m.group(1) or m.group(2) or m.group(3) or "", text)
    text = _LATEX.sub("", text)
    out = []
    for line in text.split("\n"):
        if len(line) < 12 or _HEAD.match(line):
            continue
        for piece in _END.split(line):
            piece = _LEAD.sub("", piece).rstrip("\"'»”)]*_}\\ \t\r")
            if piece[-1:] in ".!?…" and len(_WORD.findall(piece)) >= words:
                out.append(piece)
    return out


def _class_table() -> np.ndarray:
    t = np.zeros(0x3000, np.int64)
    for c in range(len(t)):
        if chr(c).isalpha():
            at = _LETTERS.find(chr(c).lower())
            t[c] = at + 1 if at >= 0 else _CLASSES - 1
    t[0x27] = t[0x2019] = _LETTERS.index("'") + 1
    return t


class Trigrams:
    """Sentences as sparse counts of trigrams over letter classes: (sentence, trigram, count), sorted."""

    size = _CLASSES**3

    def __init__(self):
        self.table = _class_table()

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "  ".join(texts) + "  "
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.table[np.minimum(codes, len(self.table) - 1)]
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        owner = np.repeat(np.arange(len(texts)), lengths)
        tri = (np.concatenate([[0], cls[:-1]]) * _CLASSES + cls) * _CLASSES + np.concatenate([cls[1:], [0]])
        # places within runs of separators say nothing
        keep = (cls > 0) | ((tri // _CLASSES**2 > 0) & (tri % _CLASSES > 0))
        key, n = np.unique(owner[keep] * self.size + tri[keep], return_counts=True)
        return key // self.size, key % self.size, n


class CentroidModel:
    """Several centroids a language over normalised TF-IDF vectors; a piece too far from all of them is rejected."""

    def __init__(self, per_language: int = 3, rounds: int = 6, reject: float = 0.25, lead: float = 0.05):
        self.c, self.rounds, self.reject, self.lead = per_language, rounds, reject, lead

    def fit(self, texts: list[str], langs: list[str]) -> CentroidModel:
        self.langs = [x for x in LANGS if x in set(langs)]
        self.tri = Trigrams()
        row, col, n = self.tri(texts)
        lab = np.array([self.langs.index(x) for x in langs])
        df = np.bincount(col, minlength=self.tri.size)
        self.idf = np.log((1 + len(texts)) / (1 + df)).astype(np.float32) * (df > 0)
        val = self._weights(row, col, n, len(texts))
        rng = np.random.default_rng(7)
        part = lab * self.c + rng.integers(0, self.c, len(texts))
        for r in range(self.rounds):
            self._centre(part, row, col, val)
            sim = self.similarity(row, col, val, len(texts))
            if r >= 1:  # labels are wrong in places and texts mix languages: each sentence follows its nearest language
                best = sim.argmax(1) // self.c
                lab = np.where(sim.max(1) > 0, best, lab)
            own = np.where(np.arange(len(self.langs) * self.c) // self.c == lab[:, None], sim, -1)
            part = own.argmax(1)
        self._centre(part, row, col, val)
        top = self.similarity(row, col, val, len(texts)).max(1)
        self.floor = float(self.reject * np.median(top)) if len(top) else 0.0
        return self

    def _weights(self, row, col, n, rows):
        val = n * self.idf[col]
        norm = np.sqrt(np.bincount(row, val * val, minlength=rows))
        return (val / np.maximum(norm, 1e-9)[row]).astype(np.float32)

    def _centre(self, part, row, col, val):
        k = len(self.langs) * self.c
        c = np.stack([np.bincount(col[m], val[m], minlength=self.tri.size) if (m := part[row] == j).any() else np.zeros(self.tri.size) for j in range(k)])
        self.centroids = np.ascontiguousarray((c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)).T.astype(np.float32))

    def similarity(self, row, col, val, rows) -> np.ndarray:
        out = np.zeros((rows, self.centroids.shape[1]), np.float32)
        for s in range(0, len(row), 1 << 18):
            r, w = row[s : s + (1 << 18)], val[s : s + (1 << 18), None] * self.centroids[col[s : s + (1 << 18)]]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] += np.add.reduceat(w, first, axis=0)
        return out

    def classify(self, texts: list[str]) -> tuple[list[str | None], np.ndarray]:
        """Language (None: rejected) and confidence of each text: the lead over the next language."""
        langs: list[str | None] = []
        conf = []
        for s in range(0, len(texts), 1000):
            part = texts[s : s + 1000]
            row, col, n = self.tri(part)
            sim = self.similarity(row, col, self._weights(row, col, n, len(part)), len(part))
            best = sim.reshape(len(part), len(self.langs), self.c).max(2)
            at = best.argmax(1)
            top = best.max(1)
            rest = np.partition(best, -2, axis=1)[:, -2] if best.shape[1] > 1 else np.zeros(len(part))
            sure = np.where(top > 0, (top - np.maximum(rest, 0)) / np.maximum(top, 1e-9), 0.0)
            langs += [self.langs[i] if t > self.floor and c >= self.lead else None for i, t, c in zip(at, top, sure)]
            conf.append(sure)
        return langs, np.concatenate(conf) if conf else np.zeros(0)


def train(df: DataFrame, text_col: str, label_col: str, title_col: str | None, per_language: int = SAMPLE_PER_LANGUAGE) -> CentroidModel:
    """Fits the centroids on sentences of at most ``per_language`` labelled texts of each language."""
    texts, langs = [], []
    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    for lang in LANGS:
        got = df.where((F.col(label_col) == lang) & (F.length(text_col) > 100)).select(F.col(text_col).alias("t"), title.alias("h")).orderBy(F.xxhash64("t"), "t").limit(per_language).collect()
        for r in got:
            s = sentences(r.t, r.h)
            texts += s
            langs += [lang] * len(s)
    return CentroidModel().fit(texts, langs)


_SEG = "array<struct<start_sentence:int,n_sentences:int,lang:string,confidence:double>>"


def segments(df: DataFrame, text_col: str, title_col: str | None, model: CentroidModel) -> DataFrame:
    """``df`` with ``segments``: maximal runs of sentences in one language, each with its mean confidence.

    Rejected sentences belong to no language and do not break a run; null, empty and sentence-free texts have none.
    """
    b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(_SEG)
    def run(text: pd.Series, title: pd.Series) -> pd.Series:
        pieces, owner = [], []
        for i, (t, h) in enumerate(zip(text, title)):
            for p in sentences(t, h):
                owner.append(i)
                pieces.append(p)
        langs, conf = b.value.classify(pieces)
        out: list[list] = [[] for _ in range(len(text))]
        at = -1
        place = 0
        for i, lang, c in zip(owner, langs, conf):
            place = place + 1 if i == at else 0
            at = i
            if lang is None:
                continue
            if out[i] and out[i][-1]["lang"] == lang:
                s = out[i][-1]
                s["confidence"] = (s["confidence"] * s["n_sentences"] + float(c)) / (s["n_sentences"] + 1)
                s["n_sentences"] += 1
            else:
                out[i].append({"start_sentence": place, "n_sentences": 1, "lang": lang, "confidence": float(c)})
        return pd.Series(out)

    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    return df.withColumn("segments", run(F.col(text_col), title))


def languages(df: DataFrame, id_col: str, text_col: str, label_col: str, title_col: str | None, model: CentroidModel) -> DataFrame:
    """One row a record: its id, label, main language (most sentences, then name) with confidence, and segments."""
    seg = segments(df.select(id_col, label_col, text_col, *([title_col] if title_col else [])), text_col, title_col, model)
    flat = seg.select(id_col, F.col(label_col).alias("label"), "segments", F.expr("array_distinct(transform(segments, s -> s.lang))").alias("langs"))
    totals = F.expr("transform(langs, l -> struct(aggregate(filter(segments, s -> s.lang = l), 0, (a, s) -> a + s.n_sentences) as n, l as lang, aggregate(filter(segments, s -> s.lang = l), 0D, (a, s) -> a + s.confidence * s.n_sentences) as c))")
    best = flat.withColumn("best", F.array_max(totals))
    return best.select(id_col, "label", F.col("best.lang").alias("lang"), F.round(F.col("best.c") / F.col("best.n"), 4).alias("confidence"), "langs", "segments")


def mislabelled(df: DataFrame, id_col: str, text_col: str, label_col: str, title_col: str | None, model: CentroidModel) -> DataFrame:
    """``(id, lang)`` for records whose label is null or is not the only language of their sentences."""
    seg = segments(df.where(F.col(id_col).isNotNull()).select(id_col, label_col, text_col, *([title_col] if title_col else [])), text_col, title_col, model)
    langs = seg.select(id_col, F.col(label_col).alias("label"), F.expr("array_distinct(transform(segments, s -> s.lang))").alias("langs"))
    wrong = langs.where("size(langs) > 0 and (label is null or not (size(langs) = 1 and langs[0] = label))")
    return wrong.select(id_col, F.explode("langs").alias("lang")).distinct()
