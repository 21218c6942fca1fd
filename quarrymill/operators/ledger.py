"""Event-sourced tables: registries replayed to their last state, merge chains, budgets of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.runtime import Workspace, fold


def replay(events: DataFrame, key: str, order: list[str], fields: list[str], kind: str = "kind", drop: tuple[str, ...] = ("reject",)) -> DataFrame:
    """Last state of each key: its version (number of events) and the last non-null value of each field.

    Aggregated by ``max_by`` with partial results, so a key with any number of events is one row a task. Keys whose
    last event is of a dropped kind are inactive.
    """
    o = F.struct(*order)
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), o)).alias(f) for f in fields]
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("version"), *last, (~F.max_by(kind, o).isin(*drop)).alias("active"))


def survivors(merges: DataFrame, child: str, parent: str, most_rounds: int = 40, ws: Workspace | None = None) -> DataFrame:
    """``(node, survivor, cyclic)``: where each node ends up by following its parents, by pointer doubling.

    The rounds grow with the logarithm of the longest chain. Nodes that end in a cycle survive as its smallest node;
    a node with several parents follows the smallest; null parents end a chain.
    """
    ws = ws or Workspace(merges.sparkSession, "survivors")
    e = merges.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("node")).agg(F.min(parent).alias("to"))
    ends = e.select(F.explode(F.array("node", "to")).alias("node")).where("node is not null").distinct()
    p = ends.join(e, "node", "left").select("node", F.coalesce("to", "node").alias("to"), F.least("node", F.coalesce("to", "node")).alias("low"))
    p = ws.step(p, "chains")
    rounds = max(1, fold(p, n=F.count("*"))["n"].bit_length())
    for _ in range(min(most_rounds, rounds)):
        nxt = p.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        q = ws.step(p.join(nxt, "to").select("node", F.col("to2").alias("to"), F.least("low", "low2").alias("low"), (F.col("to") != F.col("to2")).alias("went")), "chains")
        p = q.drop("went")
        if not fold(q, m=F.max("went"))["m"]:
            break
    roots = e.select(F.col("node").alias("to"), F.lit(True).alias("_has"))
    out = p.join(roots, "to", "left")
    # on a cycle the pointer lands anywhere on it: its smallest node stands for it
    low = out.where("_has").groupBy("to").agg(F.min("low").alias("cycle_low"))
    return out.join(low, "to", "left").select("node", F.when(F.col("_has"), F.col("cycle_low")).otherwise(F.col("to")).alias("survivor"), F.coalesce("_has", F.lit(False)).alias("cyclic"))


def admitted(calls: DataFrame, role: str, order: list[str], caps: dict[str, int], total: int) -> DataFrame:
    """Whether each call fits its role's cap and the total, in order; calls of roles without a cap are refused.

    Running counts come from windows over (role) and over all calls; the total's is kept in two steps, counts before
    each bucket of calls and counts within it, so no task orders the whole log.
    """
    cap = F
    for r, n in caps.items():
        cap = cap.when(F.col(role) == r, F.lit(n))
    c = calls.withColumn("n_role", F.row_number().over(Window.partitionBy(role).orderBy(*order)))
    c = c.withColumn("in_role", F.col("n_role") <= cap.otherwise(F.lit(0)))
    first = F.col(order[0])
    c = c.withColumn("bucket", F.date_trunc("day", first) if dict(calls.dtypes)[order[0]].startswith("timestamp") else F.floor(first / 1000))
    ok = c.where("in_role")
    per = ok.groupBy("bucket").agg(F.count("*").alias("n"))
    before = per.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = ok.join(before, "bucket").withColumn("n_total", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).drop("before")
    done = ranked.withColumn("admitted", F.col("n_total") <= total)
    return done.unionByName(c.where("not in_role").withColumn("n_total", F.lit(None).cast("long")).withColumn("admitted", F.lit(False))).drop("bucket")


def ledger_totals(calls: DataFrame, by: str, tokens_in: str, tokens_out: str, ok: str, cached: str) -> DataFrame:
    return calls.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(F.col(cached)).alias("cache_hits"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))
