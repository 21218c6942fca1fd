"""Exact nearest neighbours of every row: coarse cells, and a bound that says which of them a row may leave out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.runtime import Workspace

#: Rows that the cells' centres are fitted on, and the most cells there are; all rows are placed whatever these are.
SAMPLE, MOST_CELLS = 8192, 1024
#: Rows of one side of one task.
BLOCK = 4096
#: Slack of the bound, far above the rounding of angles.
EPS = 1e-7


def _unit(col) -> np.ndarray:
    x = np.stack(list(col)).astype(np.float64) if len(col) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centres by k-means on the sphere."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
    return c


def _best(q: np.ndarray, r: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` rows of y most similar to each row of x, ties by id; ``r`` is in order."""
    sim = np.round(x @ y.T, 9)
    sim[q[:, None] == r[None, :]] = -9.0
    k = min(k, sim.shape[1])
    if not k or not len(q):
        return pd.DataFrame({"q": q[:0], "r": r[:0], "sim": np.zeros(0)})
    # the k-th value is kept with its ties, so that the smallest ids win
    keep = sim >= np.partition(sim, sim.shape[1] - k, axis=1)[:, [sim.shape[1] - k]]
    i, j = np.nonzero(keep & (sim > -9.0))
    o = np.lexsort((j, -sim[i, j], i))
    i, j = i[o], j[o]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    i, j = i[top], j[top]
    return pd.DataFrame({"q": q[i], "r": r[j], "sim": sim[i, j]})


def nearest(df: DataFrame, id_col: str, vec: str, k: int, per_cell: int = 1000, block: int = BLOCK) -> DataFrame:
    """``(q, r, sim, rank)``: the ``k`` most similar other rows of every row, exact, ties by id.

    Rows are placed in cells of similar rows. Each row first meets a block of its own cell, which gives a floor for its
    k-th similarity. It then meets the cells that may hold a nearer row: those where the angle to the centre less the
    widest angle of the cell's rows reaches that floor. Cells and the rows that visit them are split into blocks, each
    pair a task of its own, so a cell with a third of all rows is never gathered. How many cells a row visits depends on
    how well the rows fall into groups. Null vectors and ids take no part, repeated ids are neighbours of others only,
    an empty table gives no rows.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "nearest")
    d = df.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).where("id is not null and v is not null")
    kind = d.schema["id"].dataType.simpleString()
    total = d.count()
    order = F.xxhash64(F.lit(5), "id")
    share = min(1 << 30, int(2 * SAMPLE * (1 << 30) / max(1, total)) + 1)
    got = [r.v for r in d.where(F.pmod(order, F.lit(1 << 30)) < share).orderBy(order, "id").limit(SAMPLE).collect()]
    if not got:
        return spark.createDataFrame([], f"q {kind}, r {kind}, sim double, rank int")
    centres = _centres(_unit(got), int(min(MOST_CELLS, max(1, total // per_cell))))
    cb = spark.sparkContext.broadcast(centres)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                x = _unit(pdf["v"])
                cell = (x @ cb.value.T).argmax(1)
                angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, cb.value[cell]), -1, 1))
                yield pd.DataFrame({"id": pdf["id"], "cell": cell.astype(np.int32), "angle": angle, "v": list(x)})

    homes = ws.cut(d.mapInPandas(place, f"id {kind}, cell int, angle double, v array<double>"), "homes")
    wide, size = np.full(len(centres), -1.0), np.zeros(len(centres), np.int64)
    for r in homes.groupBy("cell").agg(F.max("angle").alias("w"), F.count("*").alias("n")).toLocalIterator():
        wide[r.cell], size[r.cell] = r.w, r.n
    blocks = np.maximum(1, -(-size // block)).astype(np.int32)
    # tables as long as the cells
    own = F.array(*[F.lit(int(b)) for b in blocks])
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    slot = homes.withColumn("nb", F.element_at(own, F.col("cell") + 1)).withColumn("mb", part(F.col("nb")))

    def floor(pdf):
        pdf = pdf.sort_values("id", ignore_index=True)
        x, ids = _unit(pdf["v"]), pdf["id"].to_numpy()
        low = np.full(len(ids), -1.0)
        for s in range(0, len(ids), 512):
            sim = x[s : s + 512] @ x.T
            sim[ids[s : s + 512, None] == ids[None, :]] = -1.0
            if sim.shape[1] > k:
                low[s : s + 512] = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        return pd.DataFrame({"id": ids, "low": low, "v": pdf["v"]})

    low = ws.cut(slot.groupBy("cell", "mb").applyInPandas(floor, f"id {kind}, low double, v array<double>"), "floors")

    def reach(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        angle = np.arccos(np.clip(x @ cb.value.T, -1, 1))
        return np.nonzero((np.cos(np.maximum(0, angle - wide)) >= low[:, None] - EPS) & (size > 0))

    def visits(batches):
        n = np.zeros(len(size), np.int64)
        for pdf in batches:
            if len(pdf):
                n += np.bincount(reach(_unit(pdf["v"]), pdf["low"].to_numpy())[1], minlength=len(n))
        yield pd.DataFrame({"cell": np.arange(len(n), dtype=np.int32), "n": n})

    visitors = np.zeros(len(size), np.int64)
    for r in low.mapInPandas(visits, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        visitors[r.cell] = r.n
    qblocks = np.maximum(1, -(-visitors // block)).astype(np.int32)

    def visit(batches):
        for pdf in batches:
            if len(pdf):
                i, c = reach(_unit(pdf["v"]), pdf["low"].to_numpy())
                yield pd.DataFrame({"id": pdf["id"].to_numpy()[i], "cell": c.astype(np.int32), "v": pdf["v"].to_numpy()[i]})

    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    nq = F.element_at(F.array(*[F.lit(int(b)) for b in qblocks]), F.col("cell") + 1)
    asks = low.mapInPandas(visit, f"id {kind}, cell int, v array<double>").withColumn("qb", part(nq)).withColumn("mb", every(F.element_at(own, F.col("cell") + 1)))
    rows = slot.select("id", "cell", "mb", "v").withColumn("qb", every(nq))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": a["id"][:0], "r": a["id"][:0], "sim": np.zeros(0)})
        b = b.sort_values("id", ignore_index=True)
        x, y, q, r = _unit(a["v"]), _unit(b["v"]), a["id"].to_numpy(), b["id"].to_numpy()
        return pd.concat([_best(q[s : s + 512], r, x[s : s + 512], y, k) for s in range(0, len(q), 512)], ignore_index=True)

    met = asks.groupBy("cell", "mb", "qb").cogroup(rows.groupBy("cell", "mb", "qb")).applyInPandas(score, f"q {kind}, r {kind}, sim double")
    w = Window.partitionBy("q").orderBy(F.desc("sim"), "r")
    once = met.groupBy("q", "r").agg(F.max("sim").alias("sim"))
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q", "r", F.round("sim", 6).alias("sim"), "rank")
