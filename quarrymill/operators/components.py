"""Connected components by alternating star contraction, on edge tables of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.runtime import Workspace, fold


#: Edges (of distinct pairs) that one task joins by union-find; more are contracted in rounds over all tasks.
ONE_TASK_EDGES = 200_000


def _union_find(batches):
    """Components of the edges of one task, whose number is checked before."""
    parts = [pdf for pdf in batches if len(pdf)]
    if not parts:
        return
    e = pd.concat(parts, ignore_index=True)
    names = np.unique(np.concatenate([e["u"].to_numpy(), e["v"].to_numpy()]))
    u, v = np.searchsorted(names, e["u"].to_numpy()), np.searchsorted(names, e["v"].to_numpy())
    root = list(range(len(names)))
    for a, b in zip(u.tolist(), v.tolist()):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        while root[b] != b:
            root[b] = root[root[b]]
            b = root[b]
        # the smaller name stays the root
        root[max(a, b)] = min(a, b)
    for i in range(len(root)):
        root[i] = root[root[i]]
    yield pd.DataFrame({"node": names, "component": names[np.array(root)]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40, ws: Workspace | None = None, one_task_edges: int = ONE_TASK_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the smallest node of its component.

    Each round joins edges with the current minimum of their end points and keeps, for every node, an edge to
    the smallest node seen near it (large-star then small-star). Minima are aggregated map-side, so a hub with
    a third of all edges is one partial row a task, and the rounds grow with the logarithm of the diameter.
    At most ``one_task_edges`` edges are joined by union-find in one task instead, with the same result.
    Null end points are dropped, self loops name a node without linking it, an empty table gives no rows.
    """
    ws = ws or Workspace(edges.sparkSession, "components")
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select(F.col("u").alias("node"))
    pairs = ws.step(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    seen = None
    if pairs.count() <= one_task_edges:
        kind = pairs.schema["u"].dataType.simpleString()
        ends = pairs.coalesce(1).mapInPandas(_union_find, f"node {kind}, component {kind}")
        ends = ws.cut(ends, "components")
        alone = loops.distinct().join(ends, "node", "left_anti").select("node", F.col("node").alias("component"))
        return ends.union(alone)
    for _ in range(max_rounds):
        both = pairs.union(pairs.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: each neighbour above u goes to the least node around u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lower neighbours go to the least of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(m.select("u", F.col("m").alias("v"))).distinct()
        pairs = ws.step(small, "pairs")
        now = fold(pairs, n=F.count("*"), u=F.count_distinct("u"), s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    alone = loops.distinct().join(ends.select("node").union(roots.select("node")), "node", "left_anti").select("node", F.col("node").alias("component"))
    return ends.union(roots).union(alone)
