"""The k most similar vectors of every vector, by additive quantisation with exact reranking."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.vectors import cells, kmeans, placed, rows, sample, unit, usable
from quarrymill.runtime import Workspace


class AdditiveQuantiser:
    """Codebooks of full-dimensional vectors; a vector is the sum of one entry of each.

    The first codebook is the finest, as it places the groups; the others are fitted one after another on what
    is left, over a bounded sample. Encoding keeps the ``beam`` best partial sums at every codebook.
    """

    def __init__(self, books: int = 14, entries: int = 256, beam: int = 2, first: int = 1024):
        self.sizes, self.beam = [first, *[entries] * (books - 1)], beam

    def fit(self, x: np.ndarray, seed: int = 3) -> AdditiveQuantiser:
        self.books = []
        left = x.copy()
        for m, k in enumerate(self.sizes):
            self.books.append(kmeans(left, min(k, max(1, len(x) // 4)), 6, seed + m))
            c = self.books[-1]
            left -= c[(left @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes ``(n, books)`` by beam search for the least squared error."""
        out = np.empty((len(x), len(self.books)), np.int32)
        for s in range(0, len(x), 512):
            out[s : s + 512] = self._encode(x[s : s + 512])
        return out

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        left, err = x[:, None, :], (x * x).sum(1)[:, None]
        codes = np.zeros((n, 1, 0), np.int32)
        i = np.arange(n)[:, None]
        for m, c in enumerate(self.books):
            gain = (err[:, :, None] - 2 * (left.reshape(-1, x.shape[1]) @ c.T).reshape(n, -1, len(c)) + (c * c).sum(1)).reshape(n, -1)
            b = min(self.beam if m < len(self.books) - 1 else 1, gain.shape[1])
            best = np.argpartition(gain, b - 1, axis=1)[:, :b]
            src, code = best // len(c), best % len(c)
            codes = np.concatenate([codes[i, src], code[:, :, None].astype(np.int32)], axis=2)
            left, err = left[i, src] - c[code], np.take_along_axis(gain, best, 1)
        return codes[np.arange(n), err.argmin(1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(c[codes[:, m]] for m, c in enumerate(self.books))

    def table_scores(self, q: np.ndarray, codes: np.ndarray, half_norm: np.ndarray) -> np.ndarray:
        """Scores of all codes for each query by one lookup a codebook, less half the stored squared norms."""
        score = -np.repeat(half_norm[None, :], len(q), 0)
        for m, c in enumerate(self.books):
            score += (q @ c.T)[:, codes[:, m]]
        return score


def _search(pdf: pd.DataFrame, aq: AdditiveQuantiser, k: int, floor: float, slack: float):
    """Best ``k`` members for each query of one task: table scores first, then exact cosines of the best ones."""
    raw, role, ids = rows(pdf["v"]), pdf["role"].to_numpy(), pdf["id"].to_numpy()
    x = unit(raw)
    mem, qry = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    if not len(mem) or not len(qry):
        return None
    exact = raw.astype(np.float64)
    exact /= np.abs(exact).max(1, keepdims=True)
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    codes = aq.encode(x[mem])
    xhat = aq.decode(codes)
    half_norm = 0.5 * (xhat * xhat).sum(1)
    n, rerank = len(mem), 1024 + len(mem) // 4
    step = max(16, min(512, (1 << 20) // n))
    members = np.ascontiguousarray(exact[mem].T)
    found = []
    for s in range(0, len(qry), step):
        q = qry[s : s + step]
        ok = x[q] @ xhat.T >= floor - slack
        live = np.flatnonzero(ok.any(1))
        if not len(live):
            continue
        q, ok = q[live], ok[live]
        crowded = np.flatnonzero(ok.sum(1) > rerank)
        if len(crowded):
            score = aq.table_scores(x[q[crowded]], codes, half_norm)
            best = np.argpartition(score, n - rerank, axis=1)[:, n - rerank :]
            keep = np.zeros((len(crowded), n), bool)
            np.put_along_axis(keep, best, True, 1)
            ok[crowded] &= keep
        cos = np.where(ok & (ids[q][:, None] != ids[mem]), exact[q] @ members, -2.0)
        if n > 4 * k:  # ties at the k-th place stay for the ordering below
            cos[cos < np.partition(cos, n - k, axis=1)[:, n - k : n - k + 1]] = -2.0
        a, b = np.nonzero(cos >= floor)
        qa, mb, cos = q[a], mem[b], cos[a, b]
        found.append(_best(qa, mb, cos, ids, k))
    if not found:
        return None
    a, b, c = (np.concatenate(t) for t in zip(*found))
    # a pair seen from the query's side also counts for a member that does not probe the query's cell
    a, b, c = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([c, c])
    a, b, c = _best(a, b, c, ids, k)
    return pd.DataFrame({"id": ids[a], "other": ids[b], "cos": c})


def _best(a: np.ndarray, b: np.ndarray, cos: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` highest of each ``a``, without repeats."""
    o = np.lexsort((ids[b], -cos, a))
    a, b, cos = a[o], b[o], cos[o]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, cos = a[new], b[new], cos[new]
    first = np.ones(len(a), bool)
    first[1:] = a[1:] != a[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    top = np.arange(len(a)) - start < k
    return a[top], b[top], cos[top]


def most_similar(emb: DataFrame, model: str, k: int = 5, floor: float = 0.70, margin: float = 0.10, slack: float = 0.25, per_cell: int = 1400, block: int = 16384, books: int = 14) -> DataFrame:
    """``(id, other, cos, rank)``: for each usable vector its ``k`` most similar others with a cosine of ``floor`` or more.

    Vectors meet in coarse cells (see ``vectors.placed``). Within a task, members are encoded by beam search over
    additive codebooks, queries score all members by table lookups with stored norms, and the best of them (a
    number that grows with the cell) are reranked by exact cosines in double precision. Codebooks and centroids
    are fitted on ``vectors.SAMPLE`` vectors; every vector is indexed. Unusable vectors (null, empty, wrong length,
    not finite, all zero) take no part; equal cosines are ordered by id; an empty table gives no rows.
    """
    v = usable(emb, model)
    total = v.count()
    x = sample(v, total)
    if not len(x):
        return v.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cos"), F.lit(1).alias("rank")).limit(0)
    centroids = cells(x, total, per_cell)
    quantiser = v.sparkSession.sparkContext.broadcast(AdditiveQuantiser(books).fit(x))

    def search(pdf):
        out = _search(pdf, quantiser.value, k, floor, slack)
        return out if out is not None else pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"), "cos": pd.Series(dtype="float64")})

    got = placed(v, centroids, margin, block).groupBy("cell", "mb", "qb").applyInPandas(search, "id long, other long, cos double")
    w = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    # a pair is scored by the same arithmetic wherever it meets, so the maximum drops repeats only
    once = got.groupBy("id", "other").agg(F.max("cos").alias("cos"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def similar_pairs(emb: DataFrame, model: str, k: int = 5, floor: float = 0.70) -> DataFrame:
    """``(k_a, k_b)``, k_a < k_b: pairs where one is among the ``k`` most similar to the other."""
    ws = Workspace(emb.sparkSession, "neighbours")
    near = most_similar(emb, model, k, floor)
    pairs = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    pairs = ws.cut(pairs, "pairs")
    names = usable(emb, model).select("id", "k")
    named = pairs.join(names.select(F.col("id").alias("a"), F.col("k").alias("x")), "a").join(names.select(F.col("id").alias("b"), F.col("k").alias("y")), "b")
    return named.select(F.least("x", "y").alias("k_a"), F.greatest("x", "y").alias("k_b"))
