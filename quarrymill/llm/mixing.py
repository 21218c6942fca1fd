"""Sources mixed to target shares of tokens, by a multivariate-hypergeometric splitting tree over block quotas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.tokens import FOLDER, RANKS, size
from quarrymill.runtime import Workspace

#: Blocks of each source; block totals (sources x BLOCKS rows) are what the driver plans with.
BLOCKS = 256
#: Texts of a shard that one task orders; a larger shard is ordered in parts.
PART_TEXTS = 100_000
#: Most sources and mixes that are planned on the driver.
MOST_SOURCES = 10_000


def split_tree(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Block counts ``(shards, sources)``: the quotas of all sources dealt to output shards of equal block numbers.

    A node deals its blocks to its halves by one multivariate-hypergeometric draw, so each shard holds an exact
    random share of every source, the column sums are the quotas and no shard is drawn twice.
    """
    out = np.zeros((shards, len(quota)), np.int64)
    todo = [(0, shards, quota.astype(np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid = (lo + hi) // 2
        # block numbers of shard s: from total s / shards to total (s + 1) / shards, within this node
        left = int(have.sum()) * (mid - lo) // (hi - lo)
        draw = rng.multivariate_hypergeometric(have, left, method="marginals") if have.sum() else have
        todo += [(lo, mid, draw), (mid, hi, have - draw)]
    return out


class Plan:
    """Which blocks of which source go to which shard, for one mix."""

    def __init__(self, mix: str, targets: list[tuple[str, float, int]], totals: dict[str, np.ndarray], blocks_per_shard: int, seed: int):
        rng = np.random.default_rng([seed, *mix.encode()])
        live = [(s, w, r) for s, w, r in targets if w > 0 and r > 0 and totals.get(s, np.zeros(1)).sum() > 0]
        weight = sum(w for _, w, _ in live) or 1.0
        # the largest total at which every source holds its share within its repeats
        self.total = min((float(totals[s].sum()) * r * weight / w for s, w, r in live), default=0.0)
        self.units: list[tuple] = []
        quota, units = [], []
        for s, w, _ in live:
            t = totals[s]
            want = self.total * w / weight
            whole, left = divmod(want, float(t.sum()))
            order = rng.permutation(len(t))
            got = [(s, int(b), p, -1.0) for p in range(int(whole)) for b in rng.permutation(len(t))]
            for b in order:
                if left < 0.5:
                    break
                if t[b] <= left:
                    got.append((s, int(b), int(whole), -1.0))
                elif t[b] > 0:  # the block that crosses the quota gives part of its texts
                    got.append((s, int(b), int(whole), left))
                left -= t[b]
            units.append([got[i] for i in rng.permutation(len(got))])
            quota.append(len(got))
        shards = max(1, -(-sum(quota) // blocks_per_shard))
        dealt = split_tree(np.array(quota, np.int64), shards, rng) if quota else np.zeros((0, 0), np.int64)
        for j, us in enumerate(units):
            ends = np.cumsum(dealt[:, j])
            for i, u in enumerate(us):  # disjoint runs of the permuted blocks
                self.units.append((mix, int(np.searchsorted(ends, i, side="right")), *u))


def _upto_quota(taken: DataFrame) -> DataFrame:
    """Of each block that crosses its quota, the texts in random order up to it, to within half a text.

    Sums of 1,024 steps of the order come first, so that a block of any size is ordered step by step, not in one task.
    """
    key = ["mix_id", "source", "block", "pass"]
    d = taken.withColumn("o", F.xxhash64("id", "pass")).withColumn("step", F.shiftright("o", 54))
    sums = d.groupBy(*key, "step").agg(F.sum("n_tokens").alias("t"))
    before = sums.select(*key, "step", (F.sum("t").over(Window.partitionBy(*key).orderBy("step")) - F.col("t")).alias("before"))
    w = Window.partitionBy(*key, "step").orderBy("o", "id")
    upto = d.join(before, [*key, "step"]).where(F.col("before") <= F.col("quota")).withColumn("upto", F.col("before") + F.sum("n_tokens").over(w))
    return upto.where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("quota")).drop("quota", "upto", "before", "step", "o")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks_per_shard: int = 256, seed: int = 17, folder: str = FOLDER, ranks: str = RANKS) -> DataFrame:
    """``(mix_id, shard, position, id, source, pass, n_tokens)``: the records of each mix, in shuffled order.

    The total is the largest at which each source reaches its share within its ``max_repeats``; shares are met to
    within one text. Texts fall into BLOCKS blocks a source by hash, so a source with a third of all rows is as many
    tasks as any. Sources without a text, a share or repeats are left out and the other shares keep their
    proportions; null and empty texts take no part; repeated texts count each.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size(text_col, folder, ranks).alias("n_tokens"), F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(BLOCKS)).cast("int").alias("block"))
    sized = ws.cut(d.where("n_tokens > 0 and source is not null"), "sized")
    rows = targets.select("mix_id", "source", "target_share", "max_repeats").where("mix_id is not null and source is not null").groupBy("mix_id", "source").agg(F.sum("target_share").alias("w"), F.max("max_repeats").alias("r")).orderBy("mix_id", "source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources of mixes")
    wanted = spark.createDataFrame(sorted({(r["source"],) for r in rows}), "source string") if rows else spark.createDataFrame([], "source string")
    totals: dict[str, np.ndarray] = {}
    texts: dict[str, np.ndarray] = {}
    for r in sized.join(F.broadcast(wanted), "source").groupBy("source", "block").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).toLocalIterator():
        totals.setdefault(r["source"], np.zeros(BLOCKS))[r["block"]] = r["t"]
        texts.setdefault(r["source"], np.zeros(BLOCKS))[r["block"]] = r["n"]
    units = []
    for m in sorted({r["mix_id"] for r in rows}):
        units += Plan(m, [(r["source"], r["w"] or 0.0, r["r"] or 0) for r in rows if r["mix_id"] == m], totals, blocks_per_shard, seed).units
    cols = ["mix_id", "shard", "source", "block", "pass", "quota"]
    schema = "mix_id string, shard int, source string, block int, pass int, quota double"
    plan = spark.createDataFrame(pd.DataFrame(units, columns=cols), schema) if units else spark.createDataFrame([], schema)
    size_of: dict[tuple, float] = {}
    for m, shard, source, block, *_ in units:
        size_of[m, shard] = size_of.get((m, shard), 0) + texts[source][block]
    parts = max([1, *(-(-int(n) // PART_TEXTS) for n in size_of.values())])
    # the plan holds mixes x sources x BLOCKS x repeats rows, whatever the corpus
    taken = sized.join(F.broadcast(plan), ["source", "block"])
    whole = taken.where("quota < 0").drop("quota")
    got = whole.unionByName(_upto_quota(ws.cut(taken.where("quota >= 0"), "crossing")))
    # a shuffle of a shard: texts go to parts at random, and are ordered at random in them
    mixed = F.xxhash64(F.lit(seed), "id", "pass", "mix_id")
    got = got.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "pass", "mix_id"), F.lit(parts)).cast("int"))
    local = Window.partitionBy("mix_id", "shard", "part").orderBy(mixed, "id", "pass")
    got = got.withColumn("position", F.row_number().over(local) - 1)
    if parts > 1:
        n = got.groupBy("mix_id", "shard", "part").agg(F.count("*").alias("n"))
        before = n.select("mix_id", "shard", "part", (F.sum("n").over(Window.partitionBy("mix_id", "shard").orderBy("part")) - F.col("n")).cast("int").alias("before"))
        got = got.join(before, ["mix_id", "shard", "part"]).withColumn("position", F.col("position") + F.col("before"))
    return got.select("mix_id", "shard", "position", F.col("id").alias(id_col), "source", "pass", "n_tokens")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(mix_id, source, target_share, reached_share, tokens, texts, most_repeats)`` of every target."""
    per = mixed.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"), (F.max("pass") + 1).alias("most_repeats"))
    total = per.groupBy("mix_id").agg(F.sum("tokens").alias("all_tokens"))
    t = targets.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    out = t.join(per, ["mix_id", "source"], "left").join(total, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select("mix_id", "source", "target_share", F.round(zero("tokens") / F.col("all_tokens"), 6).alias("reached_share"), zero("tokens").alias("tokens"), zero("texts").alias("texts"), zero("most_repeats").alias("most_repeats"))
