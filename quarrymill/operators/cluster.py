"""Clustering: distributed fits by pyspark.ml, and NumPy kernels for problems of a checked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.vectors import l2, mean_vectors
from quarrymill.runtime import Workspace

#: Most points a kernel takes; larger tables are first reduced to weighted prototypes.
MOST_POINTS = 4000


def kmeans(df: DataFrame, id_col: str, vec: str, k: int, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(id, cluster, distance, confidence)`` of the best of several seeded fits; clusters numbered by size.

    Confidence is one less the ratio of the distances to the nearest and second nearest centre. Null vectors drop out.
    """
    ws = Workspace(df.sparkSession, "kmeans")
    x = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(l2(F.col(vec))).alias("f"))
    # written once and read by every round; a small table is few tasks
    x = ws.cut(x, "features")
    parts = max(1, min(x.rdd.getNumPartitions(), -(-x.count() // 20_000)))
    x = x.coalesce(parts).cache()
    fits = [KMeans(featuresCol="f", k=k, seed=s, maxIter=20).fit(x) for s in seeds]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    x.unpersist()
    centres = np.array(best.clusterCenters())
    b = df.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            for s in range(0, len(pdf), 512):
                m = np.stack(pdf["f"].to_numpy()[s : s + 512])
                near = (b.value * b.value).sum(1) - 2 * m @ b.value.T
                two = np.argsort(near, axis=1, kind="stable")[:, :2] if near.shape[1] > 1 else np.zeros((len(m), 2), int)
                d = np.linalg.norm(m[:, None, :] - b.value[two], axis=2)
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[s : s + 512], "raw": two[:, 0], "distance": d[:, 0], "confidence": 1 - d[:, 0] / np.maximum(d[:, 1], 1e-12)})

    kind = df.schema[id_col].dataType.simpleString()
    got = x.select(id_col, vector_to_array("f").alias("f")).mapInPandas(assign, f"{id_col} {kind}, raw int, distance double, confidence double")
    return numbered(got, "raw", "cluster").select(id_col, "cluster", F.round("distance", 6).alias("distance"), F.round("confidence", 6).alias("confidence"))


def numbered(df: DataFrame, label: str, out: str) -> DataFrame:
    """Labels renumbered from 0 by falling size, ties by the old label; -1 and null stay."""
    sizes = df.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("_n"))
    ranks = sizes.withColumn(out, F.row_number().over(Window.orderBy(F.desc("_n"), label)) - 1).drop("_n")
    return df.join(F.broadcast(ranks), label, "left").withColumn(out, F.coalesce(out, F.col(label)))


def pca(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """``(id, projection)`` on the first ``k`` components of the centred unit vectors; the largest weight of each
    component is positive."""
    x = df.where(F.col(vec).isNotNull()).select(id_col, array_to_vector(l2(F.col(vec))).alias("f"))
    centred = StandardScaler(inputCol="f", outputCol="c", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(centred)
    pc = model.pc.toArray()
    signs = [float(np.sign(pc[np.abs(pc[:, j]).argmax(), j]) or 1.0) for j in range(pc.shape[1])]
    return model.transform(centred).select(id_col, F.transform(vector_to_array("p"), lambda v, i: F.round(v * F.element_at(F.array(*[F.lit(s) for s in signs]), i + 1), 5)).alias("projection"))


# -- kernels ----------------------------------------------------------------------------------------------------------


def gmm_diagonal(x: np.ndarray, k: int, rounds: int = 40, inits: int = 3, reg: float = 1e-6, mult: np.ndarray | None = None) -> dict:
    """Gaussian mixture with diagonal covariances: posteriors, labels, BIC, AIC and mean entropy of the best start.

    A point counts as many times as ``mult`` says.
    """
    d = x.shape[1]
    mult = np.ones(len(x)) if mult is None else np.asarray(mult, float)
    n = mult.sum()
    best = None
    for seed in range(inits):
        rng = np.random.default_rng(seed)
        mean, var, weight = x[rng.choice(len(x), k, replace=len(x) < k)], np.tile(x.var(0) + reg, (k, 1)), np.full(k, 1 / k)
        last = -np.inf
        for _ in range(rounds):
            log = -0.5 * (((x[:, None] - mean) ** 2 / var).sum(2) + np.log(2 * np.pi * var).sum(1)) + np.log(weight)
            top = log.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(log - top).sum(1))
            post = np.exp(log - total[:, None])
            held = post * mult[:, None]
            mass = held.sum(0) + 1e-12
            weight, mean = mass / n, held.T @ x / mass[:, None]
            var = np.maximum(held.T @ (x * x) / mass[:, None] - mean**2, 0) + reg
            now = (total * mult).sum() / n
            if now - last < 1e-5:
                break
            last = now
        fit = float((total * mult).sum())
        if best is None or fit > best["loglik"]:
            p = k * 2 * d + k - 1
            best = {"loglik": fit, "posterior": post, "label": post.argmax(1), "bic": float(p * np.log(n) - 2 * fit), "aic": float(2 * p - 2 * fit), "entropy": float((-(post * np.log(post + 1e-12)).sum(1) * mult).sum() / n)}
    return best


def hdbscan(x: np.ndarray, min_size: int = 10, min_samples: int = 5, leaf: bool = False, mult: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Labels (-1: noise) and membership probabilities by the density hierarchy of mutual reachability distances.

    A point counts as many times as ``mult`` says, in core distances, sizes and stabilities.
    """
    n = len(x)
    mult = np.ones(n, int) if mult is None else np.asarray(mult, int)
    if mult.sum() <= min_samples:
        return np.full(n, -1), np.zeros(n)
    sq = (x * x).sum(1)
    core = np.empty(n)
    for s in range(0, n, 512):
        d = np.sqrt(np.maximum(sq[s : s + 512, None] + sq - 2 * x[s : s + 512] @ x.T, 0))
        near = np.argsort(d, axis=1)
        at = (np.cumsum(mult[near], axis=1) > min_samples).argmax(1)
        core[s : s + 512] = np.take_along_axis(d, np.take_along_axis(near, at[:, None], 1), 1)[:, 0]
    # spanning tree by Prim, one row of distances at a time
    dist, link, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):
        done[at] = True
        d = np.maximum(np.maximum(np.sqrt(np.maximum(sq[at] + sq - 2 * x @ x[at], 0)), core), core[at])
        near = (d < dist) & ~done
        dist[near], link[near] = d[near], at
        at = int(np.where(done, np.inf, dist).argmin())
        edges.append((dist[at], link[at], at))
    edges.sort()
    # single linkage tree
    parent = list(range(2 * n - 1))
    kids, height, size = {}, {}, [*mult.tolist(), *[0] * (n - 1)]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for j, (w, a, b) in enumerate(edges):
        ra, rb, new = root(a), root(b), n + j
        parent[ra] = parent[rb] = new
        kids[new], height[new], size[new] = (ra, rb), max(w, 1e-12), size[ra] + size[rb]

    def leaves(i):
        todo, out = [i], []
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j]
        return out

    # condensed tree: a split counts if both sides are large enough
    birth, members, stability, children, todo = {0: 0.0}, {0: []}, {0: 0.0}, {0: []}, [(2 * n - 2, 0)]
    nxt = 1
    while todo:
        node, c = todo.pop()
        if node < n:
            members[c].append((node, np.inf))
            continue
        lam, sides = 1 / height[node], kids[node]
        large = [s for s in sides if size[s] >= min_size]
        if len(large) == 2:
            stability[c] += (lam - birth[c]) * size[node]
            for s in sides:
                birth[nxt], members[nxt], stability[nxt], children[nxt] = lam, [], 0.0, []
                children[c].append(nxt)
                todo.append((s, nxt))
                nxt += 1
            continue
        for s in sides:
            if s in large:
                todo.append((s, c))
            else:
                out = leaves(s)
                stability[c] += (lam - birth[c]) * int(mult[out].sum())
                members[c] += [(i, lam) for i in out]
    chosen, worth = {}, {}
    for c in sorted(birth, reverse=True):
        below = sum(worth[k] for k in children[c])
        take = not children[c] or (not leaf and c != 0 and stability[c] >= below)
        worth[c], chosen[c] = (max(stability[c], 0.0), True) if take else (below, False)
    label, prob = np.full(n, -1), np.zeros(n)
    todo, k = [(0, -1)], 0
    peak: dict[int, float] = {}
    while todo:
        c, lab = todo.pop()
        if lab < 0 and chosen[c] and c != 0:
            lab, k = k, k + 1
        for i, lam in members[c]:
            if lab >= 0:
                label[i], prob[i] = lab, min(lam, 1e12)
                peak[lab] = max(peak.get(lab, 0.0), prob[i])
        todo += [(s, lab) for s in children[c]]
    for i in np.flatnonzero(label >= 0):
        prob[i] = prob[i] / peak[label[i]] if peak[label[i]] else 1.0
    return label, prob


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 1) -> np.ndarray:
    """Modularity communities of one bounded graph: local moves, split to connected parts, contracted, repeated."""
    rng = np.random.default_rng(seed)
    of = np.arange(n)
    while True:
        m = int(max(of.max() + 1, 1)) if n else 0
        ca, cb = of[a], of[b]
        adj: list[dict[int, float]] = [{} for _ in range(m)]
        own = np.zeros(m)
        for i, j, x in zip(ca.tolist(), cb.tolist(), w.tolist()):
            if i == j:
                own[i] += 2 * x
            else:
                adj[i][j] = adj[i].get(j, 0.0) + x
                adj[j][i] = adj[j].get(i, 0.0) + x
        degree = np.array([sum(d.values()) for d in adj]) + own
        two_m = degree.sum() or 1.0
        lab, total = np.arange(m), degree.copy()
        moved = True
        rounds = 0
        while moved and rounds < 20:
            moved, rounds = False, rounds + 1
            for i in rng.permutation(m):
                if not adj[i]:
                    continue
                links: dict[int, float] = {}
                for j, x in adj[i].items():
                    links[lab[j]] = links.get(lab[j], 0.0) + x
                total[lab[i]] -= degree[i]
                f = resolution * degree[i] / two_m
                best = max(sorted(links), key=lambda c: links[c] - f * total[c])
                if links[best] - f * total[best] > links.get(lab[i], 0.0) - f * total[lab[i]] + 1e-12:
                    lab[i], moved = best, True
                total[lab[i]] += degree[i]
        # a community that fell apart becomes its connected parts
        part, seen = {}, np.full(m, -1)
        for i in range(m):
            if seen[i] >= 0:
                continue
            c, todo = len(part), [i]
            part[c] = lab[i]
            while todo:
                j = todo.pop()
                if seen[j] >= 0:
                    continue
                seen[j] = c
                todo += [x for x in adj[j] if lab[x] == lab[i] and seen[x] < 0]
        if len(part) == m:
            return seen[of] if n else of
        of = seen[of]


def to_target(n: int, a, b, w, target: int, rounds: int = 14) -> tuple[np.ndarray, float]:
    """Communities whose number is nearest to ``target``, by bisection of the resolution's logarithm."""
    lo, hi, best = -4.0, 5.0, None
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lab = communities(n, a, b, w, float(np.exp(mid)))
        k = len(set(lab.tolist()))
        if best is None or abs(k - target) < best[0]:
            best = (abs(k - target), lab, float(np.exp(mid)))
        if k == target:
            break
        lo, hi = (mid, hi) if k < target else (lo, mid)
    return best[1], best[2]


def linkage(x: np.ndarray, weight: np.ndarray, k: int, method: str = "ward") -> np.ndarray:
    """Agglomerative clusters of bounded points cut at ``k``: Ward on Euclidean or average on cosine distances."""
    n = len(x)
    if method == "ward":
        sq = (x * x).sum(1)
        d = np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0) * (weight[:, None] * weight / (weight[:, None] + weight))
    else:
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, lab, live = weight.astype(float).copy(), np.arange(n), n
    while live > k:
        i, j = sorted(divmod(int(d.argmin()), n))
        si, sj = size[i], size[j]
        if method == "ward":
            new = ((si + size) * d[i] + (sj + size) * d[j] - size * d[i, j]) / (si + sj + size)
        else:
            new = (si * d[i] + sj * d[j]) / (si + sj)
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += sj
        lab[lab == lab[j]] = lab[i]
        live -= 1
    return np.unique(lab, return_inverse=True)[1]


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of rows and columns with the highest total, by successive shortest paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while match[j0]:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = cur < low[free]
            low[free[better]], way[free[better]] = cur[better], j0
            j1 = int(free[low[free].argmin()])
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in out)


def farthest_points(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows picked greedily, each farthest (by cosine) from those before, and the radius after each; the first is the
    one nearest to the mean."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    at = int((u @ u.mean(0)).argmax())
    near, picks, radius = u @ u[at], [at], []
    for _ in range(min(k, len(u)) - 1):
        radius.append(1 - near.min())
        at = int(near.argmin())
        picks.append(at)
        near = np.maximum(near, u @ u[at])
    return np.array(picks), np.array([*radius, 1 - near.min()])


def knee(y: np.ndarray) -> int:
    """The place of a falling curve farthest from the line between its ends."""
    if len(y) < 3 or y[0] == y[-1]:
        return 0
    t = np.linspace(0, 1, len(y))
    return int(((1 - t) - (y - y[-1]) / (y[0] - y[-1])).argmax())


def balanced(sim: np.ndarray, capacity: int, mult: np.ndarray | None = None) -> np.ndarray:
    """Each row to its most similar column with room left, the surest rows first; a row takes ``mult`` places, the last
    one of a column may take more than are left. Where no column has room, the most similar one takes it."""
    mult = np.ones(len(sim), int) if mult is None else mult
    lead = np.sort(sim, axis=1)
    order = np.argsort(-(lead[:, -1] - (lead[:, -2] if sim.shape[1] > 1 else 0)), kind="stable")
    room, out = np.full(sim.shape[1], capacity), sim.argmax(1)
    for i in order:
        for j in np.argsort(-sim[i], kind="stable"):
            if room[j] > 0:
                room[j] -= mult[i]
                out[i] = j
                break
    return out


def silhouettes(x: np.ndarray, label: np.ndarray, mult: np.ndarray | None = None) -> np.ndarray:
    """Silhouette of each point by Euclidean distance, 0 for points alone; in blocks. Points count ``mult`` times."""
    k = int(label.max()) + 1
    one = np.eye(k)[label] * (np.ones(len(x)) if mult is None else mult)[:, None]
    count, sq, out = one.sum(0), (x * x).sum(1), np.zeros(len(x))
    for s in range(0, len(x), 512):
        d = np.sqrt(np.maximum(sq[s : s + 512, None] + sq - 2 * x[s : s + 512] @ x.T, 0)) @ one
        own = label[s : s + 512]
        i = np.arange(len(own))
        a = d[i, own] / np.maximum(count[own] - 1, 1)
        mean = d / np.maximum(count, 1)
        mean[:, count == 0] = np.inf
        mean[i, own] = np.inf
        b = mean.min(1)
        out[s : s + 512] = np.where((count[own] > 1) & np.isfinite(b), (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0)
    return out


def internal_metrics(x: np.ndarray, label: np.ndarray, mult: np.ndarray | None = None) -> dict:
    """Mean silhouette, Davies-Bouldin and Calinski-Harabasz of the labelled points; noise is left out."""
    mult = (np.ones(len(x)) if mult is None else np.asarray(mult, float))[label >= 0]
    x, label = x[label >= 0], np.unique(label[label >= 0], return_inverse=True)[1]
    k = int(label.max()) + 1 if len(label) else 0
    if k < 2:
        return {"silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
    n = np.bincount(label, mult)
    mean = lambda j, y: (y[label == j] * (mult[label == j] if y.ndim == 1 else mult[label == j, None])).sum(0) / n[j]
    c = np.stack([mean(j, x) for j in range(k)])
    far = np.linalg.norm(x - c[label], axis=1)
    spread = np.array([mean(j, far) for j in range(k)])
    gap = np.linalg.norm(c[:, None] - c[None], axis=2)
    np.fill_diagonal(gap, np.inf)
    centre = (x * mult[:, None]).sum(0) / n.sum()
    within, between = (far * far * mult).sum(), (n[:, None] * (c - centre) ** 2).sum()
    return {"silhouette": float((silhouettes(x, label, mult) * mult).sum() / n.sum()), "davies_bouldin": float(((spread[:, None] + spread) / gap).max(1).mean()), "calinski_harabasz": float(between / (k - 1) / (within / (n.sum() - k)))}


def on_points(df: DataFrame, id_col: str, vec: str, kernel, fields: str, most: int = MOST_POINTS) -> DataFrame:
    """``(id, fields)``: the result of a kernel over all rows, of bounded size whatever the table's.

    ``kernel(x, mult)`` takes unit points and how many rows each stands for, and returns a frame of ``fields`` with a row
    for each point. Rows of a table of at most ``most`` rows are the points themselves, in the order of their ids; a
    larger table is first reduced to ``most`` prototypes over all rows (see ``prototypes``), and each row gets its
    prototype's result. Null vectors take no part; an empty table gives no rows.
    """
    d = df.where(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias("v"))
    kind = d.schema[id_col].dataType.simpleString()

    def run(key: str):
        def one(pdf):
            pdf = pdf.sort_values(key, ignore_index=True)
            x = np.stack(pdf["v"].to_numpy())
            got = kernel(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), pdf["n"].to_numpy() if "n" in pdf else np.ones(len(pdf), int))
            return pd.concat([pdf[[key]], got], axis=1)

        return one

    if d.count() <= most:
        return d.groupBy().applyInPandas(run(id_col), f"{id_col} {kind}, {fields}")
    lab, cents = prototypes(d, id_col, "v", most)
    points = cents.select("cluster", "n", F.col("centroid").alias("v")).groupBy().applyInPandas(run("cluster"), f"cluster int, {fields}")
    return lab.join(points, "cluster").drop("cluster")


#: Prototypes that k-means fits; more of them are the rows nearest to seeds.
MOST_FITTED = 256


def _to_seeds(df: DataFrame, id_col: str, vec: str, k: int) -> DataFrame:
    """``(id, cluster)``: each row's nearest of ``k`` seeds, the first rows in the order of their ids' hashes."""
    order = F.xxhash64(F.lit(3), id_col)
    x = np.array([r.v for r in df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), order.alias("o"), id_col).orderBy("o", id_col).limit(k).collect()])
    b = df.sparkSession.sparkContext.broadcast(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))

    def near(batches):
        for pdf in batches:
            for s in range(0, len(pdf), 1024):
                m = np.stack(pdf["v"].to_numpy()[s : s + 1024])
                yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[s : s + 1024], "cluster": (m @ b.value.T).argmax(1).astype(np.int32)})

    kind = df.schema[id_col].dataType.simpleString()
    return df.where(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias("v")).mapInPandas(near, f"{id_col} {kind}, cluster int")


def prototypes(df: DataFrame, id_col: str, vec: str, k: int) -> tuple[DataFrame, DataFrame]:
    """``(id, cluster)`` of every row and ``(cluster, n, centroid)``: the reduction for tables beyond a kernel's size.

    Up to MOST_FITTED clusters are fitted by k-means; of more, each row joins its nearest of ``k`` seed rows, and the
    prototypes are the means of what joined.
    """
    lab = kmeans(df, id_col, vec, k, seeds=(1,)).select(id_col, "cluster") if k <= MOST_FITTED else _to_seeds(df, id_col, vec, k)
    lab = Workspace(df.sparkSession, "prototypes").cut(lab, "labels")
    return lab, mean_vectors(df.join(lab, id_col), ["cluster"], vec)
