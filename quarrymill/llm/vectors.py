"""Shared parts of the vector operators: usable vectors, coarse cells and blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that centroids and codebooks are fitted on; all vectors are indexed whatever this is.
SAMPLE = 8192
#: Most coarse cells; bounds the broadcast centroids (4096 x dims floats).
MOST_CELLS = 4096


def usable(emb: DataFrame, model: str, key: str = "k", vec: str = "v") -> DataFrame:
    """``(id, k, v)`` of the model's vectors with ``dims`` finite elements that are not all zero.

    ``id`` is a 64-bit hash of the key, for narrow shuffles; null vectors and keys drop out.
    """
    big = 3.0e38
    ok = (F.col("model") == model) & (F.size(vec) == F.col("dims")) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) <= big) & ~F.isnan(x)) & F.exists(vec, lambda x: x != 0)
    return emb.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(vec) > 0)).where(ok).select(F.xxhash64(key).alias("id"), F.col(key).alias("k"), F.col(vec).cast("array<float>").alias("v"))


def rows(col: pd.Series) -> np.ndarray:
    """A column of equal-length arrays as one float32 matrix."""
    if not len(col):
        return np.zeros((0, 0), np.float32)
    return np.concatenate(col.to_numpy()).astype(np.float32, copy=False).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, kept as float32."""
    y = x.astype(np.float64)
    y /= np.abs(y).max(1, keepdims=True)
    return (y / np.linalg.norm(y, axis=1, keepdims=True)).astype(np.float32)


def sample(vectors: DataFrame, total: int, n: int = SAMPLE) -> np.ndarray:
    """At most ``n`` unit vectors in the order of their hashed ids: the same whatever the partitioning.

    Only rows whose hash falls in the share that holds about twice ``n`` of ``total`` are ordered, so what reaches
    the driver doesn't grow with the table.
    """
    share = min(1 << 30, int(2 * n * (1 << 30) / max(1, total)) + 1)
    order = F.xxhash64(F.lit(11), "id")
    got = [r.v for r in vectors.where(F.pmod(order, F.lit(1 << 30)) < share).select("v", order.alias("o")).repartition(1).orderBy("o").limit(n).collect()]
    return unit(np.array(got, np.float32)) if got else np.zeros((0, 1), np.float32)


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float32)
    for _ in range(rounds):
        lab = (x @ c.T - (0 if spherical else 0.5 * (c * c).sum(1))).argmax(1)
        n = np.bincount(lab, minlength=k)
        order = np.argsort(lab, kind="stable")
        got = n > 0
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[got], axis=0)
        c[got] = sums / n[got, None]
        c[~got] = x[rng.choice(len(x), (~got).sum())]
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def cells(x: np.ndarray, total: int, per_cell: int = 1400, seed: int = 5) -> np.ndarray:
    """Unit centroids of about ``per_cell`` vectors each out of ``total``, fitted on the sample ``x``."""
    k = int(min(MOST_CELLS, max(1, round(total / per_cell)), max(1, len(x) // 4)))
    return kmeans(x, k, 8, seed, spherical=True)


def route(x: np.ndarray, centroids: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Home cell of every row, and (row, cell) of the further cells within ``margin`` of the home's similarity."""
    homes, who, where = [], [], []
    for s in range(0, len(x), 4096):
        sim = x[s : s + 4096] @ centroids.T
        home = sim.argmax(1)
        near = sim >= sim.max(1, keepdims=True) - margin
        near[np.arange(len(home)), home] = False
        w, c = np.nonzero(near)
        homes.append(home)
        who.append(w + s)
        where.append(c)
    return np.concatenate(homes) if homes else np.zeros(0, int), np.concatenate(who) if who else np.zeros(0, int), np.concatenate(where) if where else np.zeros(0, int)


def placed(vectors: DataFrame, centroids: np.ndarray, margin: float, block: int) -> DataFrame:
    """``(cell, mb, qb, role, id, v)``: who meets whom, in tasks of bounded size.

    Every row is a member of its home cell and a query of all cells within ``margin``. A cell of more than
    ``block`` members is split by hash into member blocks (mb) and query blocks (qb) that meet pairwise, each
    pair in a task of its own, so a group with a third of all rows is never gathered in one place. Role 1 is a
    member, 2 a query, 3 both. The block counts come from one count a cell, no longer than the centroids.
    """
    spark = vectors.sparkSession
    cb = spark.sparkContext.broadcast(centroids)

    def homes(batches):
        for b in batches:
            home, _, _ = route(unit(matrix(b.column("v"))), cb.value, 0.0)
            n = np.bincount(home, minlength=1)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["cell", "n"])

    counts = vectors.select("v").mapInArrow(homes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    nb_of = np.ones(len(centroids), np.int64)
    for r in counts.toLocalIterator():
        nb_of[r.cell] = -(-r.n // block)
    bb = spark.sparkContext.broadcast(nb_of)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("v"))
            ids = b.column("id").to_numpy()
            home, who, where = route(unit(x), cb.value, margin)
            nb, n = bb.value, len(ids)
            own = (ids.view(np.uint64) % np.uint64(1 << 31)).astype(np.int64)
            one = np.flatnonzero(nb[home] == 1)
            zero = np.zeros(len(one), np.int64)
            yield _placed(ids, x, home[one], zero, zero, one, 3)
            hot = np.flatnonzero(nb[home] > 1)
            if len(hot):  # a member meets every query block, and queries every member block
                w, k = _spread(hot, nb[home[hot]])
                yield _placed(ids, x, home[w], own[w] % nb[home[w]], k, w, 1)
                yield _placed(ids, x, home[w], k, own[w] % nb[home[w]], w, 2)
            if len(who):
                g, k = _spread(np.arange(len(who)), nb[where])
                yield _placed(ids, x, where[g], k, own[who[g]] % nb[where[g]], who[g], 2)

    return vectors.select("id", "v").mapInArrow(run, "cell int, mb int, qb int, role int, id long, v array<float>")


def _spread(what: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.repeat(what, times)
    return w, np.arange(len(w)) - np.repeat(np.cumsum(times) - times, times)


def _placed(ids, x, cell, mb, qb, row, role) -> pa.RecordBatch:
    v = x[row]
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), pa.array(v.ravel()))
    i32 = [pa.array(np.asarray(c).astype(np.int32)) for c in (cell, mb, qb, np.full(len(row), role))]
    return pa.RecordBatch.from_arrays([*i32, pa.array(ids[row]), flat], ["cell", "mb", "qb", "role", "id", "v"])


def matrix(col: pa.Array) -> np.ndarray:
    """An Arrow column of equal-length float lists as one matrix."""
    flat = col.flatten().to_numpy()
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1), np.float32)
