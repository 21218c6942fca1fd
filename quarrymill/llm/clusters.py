"""Similarity clusters: neighbour-descent graph, modularity communities, descriptions by internal degree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.vectors import cells, placed, rows, sample, unit, usable
from quarrymill.operators.components import connected_components
from quarrymill.runtime import Workspace, fold

_EDGE = "a long, b long, w double, label long"


def _leaves(x: np.ndarray, leaf: int, rng: np.random.Generator) -> list[np.ndarray]:
    """One random tree: halves by the median of a random direction until a leaf is small enough."""
    todo, out = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            out.append(at)
            continue
        p, q = x[at[rng.integers(len(at))]], x[at[rng.integers(len(at))]]
        side = x[at] @ (p - q)
        o = np.argsort(side, kind="stable")
        todo += [at[o[: len(at) // 2]], at[o[len(at) // 2 :]]]
    return out


class Descent:
    """Approximate k-nearest-neighbour graph by neighbour descent, started from random trees.

    A row's list improves by the neighbours of its neighbours, in both directions, until few lists change. Only
    pairs of a cosine of ``floor`` or more enter a list, so isolated rows cost nothing after the start.
    """

    def __init__(self, k: int, floor: float, trees: int = 6, leaf: int = 128, rounds: int = 8, seed: int = 1):
        self.k, self.floor, self.trees, self.leaf, self.rounds, self.seed = k, floor, trees, leaf, rounds, seed

    def fit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Neighbour rows (-1: none) and cosines, both ``(n, k)``, by falling cosine."""
        rng = np.random.default_rng(self.seed)
        n = len(x)
        self.x, self.nbr, self.sim = x, np.full((n, self.k), -1, np.int64), np.full((n, self.k), -2.0, np.float32)
        for _ in range(self.trees):
            for at in _leaves(x, self.leaf, rng):
                s = x[at] @ x[at].T
                np.fill_diagonal(s, -2)
                a, b = np.nonzero(s >= self.floor)
                self._merge(at[a], at[b], s[a, b])
        for _ in range(self.rounds):
            if self._round(rng) <= 0.002 * max(1, (self.nbr >= 0).sum()):
                break
        return self.nbr, self.sim

    def _round(self, rng) -> int:
        live, slot = np.nonzero(self.nbr >= 0)
        to = self.nbr[live, slot]
        # links in both directions, at most 2k a row, drawn at random for rows that many others name
        u, v = np.concatenate([live, to]), np.concatenate([to, live])
        o = np.lexsort((rng.random(len(u)), u))
        u, v = u[o], v[o]
        first = np.ones(len(u), bool)
        first[1:] = u[1:] != u[:-1]
        pos = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0)) if len(u) else u
        keep = pos < 2 * self.k
        hop = np.full((len(self.x), 2 * self.k), -1, np.int64)
        hop[u[keep], pos[keep]] = v[keep]
        changed = 0
        rows_ = np.flatnonzero(hop[:, 0] >= 0)
        for s in range(0, len(rows_), 2048):
            r = rows_[s : s + 2048]
            pick = rng.integers(0, 2 * self.k, (len(r), 24))
            mid = hop[r[:, None], pick]
            cand = np.where(mid >= 0, hop[mid, rng.integers(0, 2 * self.k, mid.shape)], -1)
            a, j = np.nonzero((cand >= 0) & (cand != r[:, None]))
            b = cand[a, j]
            a = r[a]
            w = np.einsum("ij,ij->i", self.x[a], self.x[b])
            good = w > self.sim[a, -1]
            good &= w >= self.floor
            changed += self._merge(a[good], b[good], w[good])
        return changed

    def _merge(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> int:
        """Offers ``b`` to the list of ``a``; the number of places that changed."""
        if not len(a):
            return 0
        who = np.unique(a)
        old = np.flatnonzero(self.nbr[who].ravel() >= 0)
        ra, rb, rw = np.repeat(who, self.k)[old], self.nbr[who].ravel()[old], self.sim[who].ravel()[old]
        fa, fb, fw = np.concatenate([ra, a]), np.concatenate([rb, b]), np.concatenate([rw, w.astype(np.float32)])
        new = np.concatenate([np.zeros(len(ra), bool), np.ones(len(a), bool)])
        o = np.lexsort((new, fb, fa))
        fa, fb, fw, new = fa[o], fb[o], fw[o], new[o]
        one = np.ones(len(fa), bool)
        one[1:] = (fa[1:] != fa[:-1]) | (fb[1:] != fb[:-1])
        fa, fb, fw, new = fa[one], fb[one], fw[one], new[one]
        o = np.lexsort((fb, -fw, fa))
        fa, fb, fw, new = fa[o], fb[o], fw[o], new[o]
        first = np.ones(len(fa), bool)
        first[1:] = fa[1:] != fa[:-1]
        pos = np.arange(len(fa)) - np.maximum.accumulate(np.where(first, np.arange(len(fa)), 0))
        top = pos < self.k
        self.nbr[who], self.sim[who] = -1, -2.0
        self.nbr[fa[top], pos[top]], self.sim[fa[top], pos[top]] = fb[top], fw[top]
        return int(new[top].sum())


def local_moves(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float = 1.0, rounds: int = 6) -> np.ndarray:
    """Communities of one bounded graph by modularity: each node moves to the neighbouring community of best gain."""
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, x in zip(a.tolist(), b.tolist(), w.tolist()):
        adj[i][j] = adj[j][i] = x
    degree = [sum(d.values()) for d in adj]
    two_m = sum(degree) or 1.0
    label, total = list(range(n)), degree[:]
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            if not adj[i]:
                continue
            links: dict[int, float] = {}
            for j, x in adj[i].items():
                c = label[j]
                links[c] = links.get(c, 0.0) + x
            own = label[i]
            total[own] -= degree[i]
            f = resolution * degree[i] / two_m
            best, gain = own, links.get(own, 0.0) - f * total[own]
            for c, x in links.items():
                g = x - f * total[c]
                if g > gain + 1e-12 or (abs(g - gain) <= 1e-12 and c < best):
                    best, gain = c, g
            total[best] += degree[i]
            if best != own:
                label[i] = best
                moved += 1
        if moved <= n // 200:
            break
    return np.array(label)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected set."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def group_links(x: np.ndarray, home: int, a: np.ndarray, b: np.ndarray, floor: float, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a cosine of ``floor`` or more between the connected sets of ``(a, b)``: the best of each two sets.

    Full lists of near copies hide every weaker link of their rows, so the rows of different sets are compared in
    full, after exact copies are one. Of the largest set only the pairs with other sets are worked out. Two rows that
    are both behind the first ``home`` meet elsewhere.
    """
    n = len(x)
    raw = np.ascontiguousarray(x)
    _, first, back = np.unique(raw.view(np.dtype((np.void, raw.dtype.itemsize * raw.shape[1]))).ravel(), return_index=True, return_inverse=True)
    rep = first[back.ravel()]
    comp = _components(n, a, b)
    apart = np.flatnonzero(comp != comp[rep])
    fa, fb, fw = [rep[apart]], [apart], [np.ones(len(apart), np.float32)]
    comp = _components(n, np.concatenate([a, fa[0]]), np.concatenate([b, fb[0]]))
    # the first of its copies: a member, where one of them is
    one = np.unique(rep)
    big = comp[one] == np.bincount(comp[one]).argmax()
    own = one < home
    small, rest = one[own & ~big], np.concatenate([one[own & big], one[~own]])
    for left, right in ((small, np.concatenate([small, rest])), (one[own & big], one[~own & ~big])):
        for s in range(0, len(left), chunk):
            u, v = left[s : s + chunk], right[s:] if left is small else right
            ok = x[u] @ x[v].T >= floor
            ok &= comp[u][:, None] != comp[v]
            i, j = np.nonzero(ok)
            i, j = u[i], v[j]
            w = np.einsum("ij,ij->i", x[i], x[j])
            p, q = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
            o = np.lexsort((j, i, -w, q, p))
            best = o[np.unique(p[o] * n + q[o], return_index=True)[1]]
            fa.append(i[best])
            fb.append(j[best])
            fw.append(w[best])
    i, j, w = np.concatenate(fa), np.concatenate(fb), np.concatenate(fw)
    return np.minimum(i, j), np.maximum(i, j), w


def neighbour_graph(emb: DataFrame, model: str, k: int = 10, floor: float = 0.70, margin: float = 0.10, per_cell: int = 1400, block: int = 16384) -> DataFrame:
    """Edges ``(a, b, w, label)`` of the approximate nearest-neighbour graph, and first communities.

    Rows meet in coarse cells of bounded blocks; each task runs neighbour descent over its block, then looks for links
    between the connected sets it found, as a list of ``k`` may be full of nearer copies. An edge row has
    ``b``; a row without ``b`` gives the first community of the member ``a``: modularity moves over the edges
    between the members of one block.
    """
    v = usable(emb, model)
    total = v.count()
    x = sample(v, total)
    empty = v.sparkSession.createDataFrame([], _EDGE)
    if not len(x):
        return empty

    def descend(pdf):
        # members first, so their rows are a prefix; a query that is a member of this block too comes once
        pdf = pdf.assign(q=(pdf["role"] == 2)).sort_values(["q", "id"]).drop_duplicates("id")
        y, ids = unit(rows(pdf["v"])), pdf["id"].to_numpy()
        home = int((~pdf["q"]).sum())
        nbr, sim = Descent(k, floor).fit(y)
        a, j = np.nonzero(nbr >= 0)
        b, w = nbr[a, j], sim[a, j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        la, lb, lw = group_links(y, home, lo, hi, floor)
        lo, hi, w = np.concatenate([lo, la]), np.concatenate([hi, lb]), np.concatenate([w, lw])
        key = np.unique(lo * len(ids) + hi, return_index=True)[1]
        lo, hi, w = lo[key], hi[key], w[key].astype(np.float64)
        inner = (lo < home) & (hi < home)
        label = local_moves(home, lo[inner], hi[inner], w[inner])
        linked = np.unique(np.concatenate([lo[lo < home], hi[hi < home]])).astype(int)
        # nullable integers throughout: ids use all 64 bits
        none = pd.array([pd.NA] * len(linked), "Int64")
        far = pd.array([pd.NA] * len(lo), "Int64")
        edges = pd.DataFrame({"a": np.minimum(ids[lo], ids[hi]), "b": pd.array(np.maximum(ids[lo], ids[hi]), "Int64"), "w": w, "label": far})
        firsts = pd.DataFrame({"a": ids[linked], "b": none, "w": np.zeros(len(linked)), "label": pd.array(ids[label[linked]], "Int64")})
        return pd.concat([edges, firsts], ignore_index=True)

    return placed(v, cells(x, total, per_cell), margin, block).groupBy("cell", "mb", "qb").applyInPandas(descend, _EDGE)


class Clusters:
    """Graph, communities and groups of one model's vectors, each a written table."""

    def __init__(self, emb: DataFrame, model: str, floor: float = 0.70, k: int = 10, rounds: int = 2, resolution: float = 1.0):
        self.emb, self.model = emb, model
        self.ws = ws = Workspace(emb.sparkSession, "clusters")
        raw = ws.cut(neighbour_graph(emb, model, k, floor), "graph")
        self.edges = raw.where("b is not null").groupBy("a", "b").agg(F.max("w").alias("w"))
        firsts = raw.where("label is not null").groupBy("a").agg(F.min("label").alias("c")).withColumnRenamed("a", "node")
        ends = self.edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        labels = ends.join(firsts, "node", "left").select("node", F.coalesce("c", "node").alias("c"))
        self.labels = ws.cut(labels, "labels")
        self.between = ws.cut(self._contract(self.edges, self.labels), "between")
        self.rounds, self.resolution = rounds, resolution

    @staticmethod
    def _contract(edges: DataFrame, labels: DataFrame) -> DataFrame:
        """Weights between communities (x < y) and inside them (x = y)."""
        la, lb = labels.toDF("a", "ca"), labels.toDF("b", "cb")
        return edges.join(la, "a").join(lb, "b").groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("w").alias("w"))

    def communities(self) -> DataFrame:
        """``(node, community)``: the first communities merged by modularity gain, level by level."""
        names = self.labels.select(F.col("c").alias("x")).distinct().withColumn("community", F.col("x"))
        graph = self.between
        for _ in range(self.rounds):
            both = graph.where("x <> y").select("x", "y", "w").union(graph.where("x <> y").select("y", "x", "w"))
            degree = both.select("x", "w").union(graph.where("x = y").select("x", F.col("w") * 2)).groupBy("x").agg(F.sum("w").alias("d"))
            two_m = fold(degree, m=F.sum("d"))["m"]
            if not two_m:
                break
            gain = both.join(degree, "x").join(degree.toDF("y", "dy"), "y").withColumn("g", F.col("w") - F.lit(self.resolution) * F.col("d") * F.col("dy") / F.lit(float(two_m)))
            best = gain.where("g > 0").groupBy("x").agg(F.max_by("y", F.struct("g", F.negate("y"))).alias("t"))
            # heads of stars absorb: a community follows its best partner only if that one does not itself follow
            star = best.join(best.toDF("t", "tt"), "t", "left").where("tt is null or (tt = x and t < x)").select("x", "t")
            moved = self.ws.cut(star, "moves")
            names = self.ws.cut(names.join(moved.toDF("community", "t"), "community", "left").select("x", F.coalesce("t", "community").alias("community")), "names")
            m = moved.toDF("x", "cx"), moved.toDF("y", "cy")
            named = graph.join(m[0], "x", "left").join(m[1], "y", "left").select(F.coalesce("cx", "x").alias("p"), F.coalesce("cy", "y").alias("q"), "w")
            graph = self.ws.cut(named.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.sum("w").alias("w")), "level")
        return self.labels.join(names.toDF("c", "community"), "c").select("node", "community")

    def groups(self) -> DataFrame:
        """``(node, group)``: communities that any edge joins, also through others, are one group."""
        comp = connected_components(self.between.select(F.col("x").alias("a"), F.col("y").alias("b")), ws=self.ws)
        return self.labels.join(comp.toDF("c", "group"), "c").select("node", "group")

    def names(self) -> DataFrame:
        return usable(self.emb, self.model).select(F.col("id").alias("node"), "k")

    def described(self, typical: int = 3) -> DataFrame:
        """``(community, size, typical_members, internal_degree)``: members by internal weighted degree, then key."""
        lab = self.ws.cut(self.communities(), "communities")
        la, lb = lab.toDF("a", "ca"), lab.toDF("b", "cb")
        inner = self.edges.join(la, "a").join(lb, "b").where("ca = cb")
        deg = inner.select(F.explode(F.array("a", "b")).alias("node"), "w").groupBy("node").agg(F.sum("w").alias("deg"))
        full = lab.join(deg, "node", "left").join(self.names(), "node").select("community", "k", F.coalesce("deg", F.lit(0.0)).alias("deg"))
        w = Window.partitionBy("community").orderBy(F.desc("deg"), "k")
        tops = full.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
        sizes = full.groupBy("community").agg(F.count("*").alias("size"), F.min("k").alias("cluster_key"))
        best = tops.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("r", "k", "deg"))).alias("t"))
        return sizes.join(best, "community").select("cluster_key", "size", F.array_join(F.transform("t", lambda s: s["k"]), ";").alias("typical_members"), F.round(F.element_at("t", 1)["deg"], 6).alias("highest_internal_degree"))


def found(emb: DataFrame, model: str) -> DataFrame:
    """``(k, cluster_key)`` of every vector in a group of two or more; the key is the smallest of its group.

    Unusable vectors (null, empty, wrong length, not finite, all zero) take no part; exact copies belong
    together; an empty table gives no rows.
    """
    c = Clusters(emb, model)
    named = c.ws.cut(c.groups().join(c.names(), "node").select("group", "k"), "named")
    keys = named.groupBy("group").agg(F.min("k").alias("cluster_key"))
    return named.join(keys, "group").select("k", "cluster_key")
