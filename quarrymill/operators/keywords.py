"""Class-based TF-IDF keywords."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


_WORD = re.compile(r"[a-z][a-z\-]+")


def ctfidf(df: DataFrame, group: str, text: str, n: int, stopwords: list[str], bigrams: bool = True) -> DataFrame:
    """The ``n`` terms of each group of the highest tf x ln(1 + A / f): tf is a term's share of the group's terms, A the
    mean number of terms a group and f the term's number over all groups. Ties by the term.

    Terms are words of ASCII letters and pairs of neighbours among words that are no stopwords. Counts are partial
    before each shuffle; rows with a null group or text drop out.
    """
    stop = frozenset(stopwords)
    kind = df.schema[group].dataType.simpleString()

    def count(batches):
        # terms are counted within each batch before anything travels
        for pdf in batches:
            acc: dict = defaultdict(Counter)
            for g, t in zip(pdf["g"], pdf["t"]):
                ws = [w for w in _WORD.findall(t.lower()) if w not in stop]
                acc[g].update(ws)
                if bigrams:
                    acc[g].update(f"{a} {b}" for a, b in zip(ws, ws[1:]))
            rows = [(g, term, n) for g, c in acc.items() for term, n in c.items()]
            yield pd.DataFrame(rows, columns=["g", "term", "n"])

    d = df.where(F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(group).alias("g"), F.col(text).alias("t"))
    c = d.mapInPandas(count, f"g {kind}, term string, n long").groupBy("g", "term").agg(F.sum("n").alias("n"))
    size = c.groupBy("g").agg(F.sum("n").alias("words"))
    freq = c.groupBy("term").agg(F.sum("n").alias("f"))
    mean = size.agg((F.sum("words") / F.count("*")).alias("A"))
    s = c.join(size, "g").join(freq, "term").crossJoin(F.broadcast(mean)).withColumn("score", F.round(F.col("n") / F.col("words") * F.ln(1 + F.col("A") / F.col("f")), 9))
    w = Window.partitionBy("g").orderBy(F.desc("score"), "term")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(F.col("g").alias(group), "term", F.round("score", 6).alias("score"), "rank")
