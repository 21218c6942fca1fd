"""Boilerplate of hosts: long token runs that several pages of one host share, and what is left without them."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.linkage import _mix
from quarrymill.llm.spans import _packed, _unpacked
from quarrymill.runtime import Workspace, fold

_TOKEN = re.compile(r"\S+")


def _codes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    import xxhash

    return np.fromiter((memo[t] if t in memo else memo.setdefault(t, xxhash.xxh64_intdigest(t)) for t in tokens), np.uint64, len(tokens))


#: Windows that a task holds at once, and windows a bucket holds on average.
HELD, BUCKET_WINDOWS = 1 << 20, 1_000_000


def _texts(h: np.ndarray, t: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by (hash, text): how many texts hold each one's hash, and whether it is the first of one of
    the first ``most`` texts of its hash."""
    if not len(h):
        return np.zeros(0, int), np.zeros(0, bool)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    other = first | np.concatenate([[True], t[1:] != t[:-1]])
    at = np.flatnonzero(first)
    place = np.cumsum(other) - np.repeat(np.cumsum(other)[at] - 1, np.diff(np.append(at, len(h))))
    return np.repeat(np.add.reduceat(other.astype(np.int64), at), np.diff(np.append(at, len(h)))), other & (place <= most)


def unique_runs(df: DataFrame, host: str, id_col: str, text: str, least: int = 24, pages: int = 3) -> DataFrame:
    """``(id, n_tokens, boilerplate_tokens, unique_text)``, one row a page.

    A token is boilerplate if it lies in a run of ``least`` tokens that at least ``pages`` distinct pages of the host
    hold; a suffix array of the host's pages finds the same runs, but needs the host in one place. Here each page's
    windows of ``least`` tokens are hashed with the host and grouped, so a host with a third of all pages spreads over
    all tasks; runs that enough pages of a slice of HELD windows hold are settled where they are read, and ``pages``
    windows of each stand for the slice. Pages with the same text count as one. Null hosts share nothing; null and
    short texts are unique. Ids must be unique.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "boilerplate")
    d = df.select(F.xxhash64(F.col(id_col).cast("string")).alias("pid"), F.col(id_col).alias("id"), F.col(host).alias("host"), F.col(text).alias("text"))
    # a token and the space after it are some six letters
    buckets = max(64, int(fold(d, n=F.sum(F.length("text")))["n"] or 0) // 6 // BUCKET_WINDOWS)

    def flush(held):
        h, ids, at, t = (np.concatenate(c) for c in zip(*held))
        o = np.lexsort((t, h))
        h, ids, at, t = h[o], ids[o], at[o], t[o]
        n, lead = _texts(h, t, pages)
        out = []
        for kind, keep in ((0, n < pages), (2, (n >= pages) & lead), (1, n >= pages)):
            if keep.any():
                bucket = (_mix(ids[keep].view(np.uint64)) if kind == 1 else h[keep]) % np.uint64(buckets)
                out.append(_packed([h[keep], ids[keep], at[keep], t[keep]] if kind != 1 else [h[:0], ids[keep], at[keep], t[:0]], bucket.astype(np.int32), ("h", "id", "at", "t")).assign(kind=kind))
        return pd.concat(out, ignore_index=True)[["bucket", "kind", "h", "id", "at", "t"]]

    def windows(batches):
        held, total = [], 0
        for pdf in batches:
            memo: dict[str, int] = {}
            for pid, h, t in zip(pdf["pid"], pdf["host"], pdf["text"]):
                if not t or h is None:
                    continue
                c = _codes(_TOKEN.findall(t), memo)
                n = len(c) - least + 1
                if n < 1:
                    continue
                acc = np.full(n, _mix(_codes([h], memo))[0], np.uint64)
                for i in range(least):
                    acc = _mix(acc + c[i : i + n] + np.uint64(i + 1))
                held.append((acc, np.full(n, pid, np.int64), np.arange(n, dtype=np.int32), np.full(n, np.bitwise_xor.reduce(_mix(c + np.arange(len(c), dtype=np.uint64))), np.uint64)))
                total += n
                if total > HELD:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    def repeated(pdf):
        done = pdf[pdf["kind"] == 1]
        rest = pdf[pdf["kind"] != 1]
        h, ids, at, t = _unpacked(rest["h"], np.uint64), _unpacked(rest["id"], np.int64), _unpacked(rest["at"], np.int32), _unpacked(rest["t"], np.uint64)
        told = np.repeat(rest["kind"].to_numpy() == 2, [len(x) // 8 for x in rest["id"]])
        o = np.lexsort((t, h))
        n, _ = _texts(h[o], t[o], pages)
        keep = o[(n >= pages) & ~told[o]]
        return pd.DataFrame({"pid": np.concatenate([ids[keep], _unpacked(done["id"], np.int64)]), "at": np.concatenate([at[keep], _unpacked(done["at"], np.int32)])})

    hits = d.select("pid", "host", "text").mapInPandas(windows, "bucket int, kind int, h binary, id binary, at binary, t binary").groupBy("bucket").applyInPandas(repeated, "pid long, at int")
    per = ws.cut(hits.groupBy("pid").agg(F.collect_list("at").alias("ats")), "hits")

    @F.pandas_udf("struct<n_tokens:int,boilerplate_tokens:int,unique_text:string>")
    def rest(texts: pd.Series, ats: pd.Series) -> pd.DataFrame:
        out = []
        for t, a in zip(texts, ats):
            ms = list(_TOKEN.finditer(t or ""))
            gone = np.zeros(len(ms) + 1, np.int32)
            if a is not None and len(a):
                a = np.asarray(a)
                np.add.at(gone, a, 1)
                np.add.at(gone, np.minimum(a + least, len(ms)), -1)
            gone = np.cumsum(gone[:-1]) > 0 if len(ms) else np.zeros(0, bool)
            runs, last = [], None
            for m, g in zip(ms, gone):
                if g:
                    last = None
                elif last is None:
                    runs.append([m.start(), m.end()])
                    last = runs[-1]
                else:
                    last[1] = m.end()
            out.append((len(ms), int(gone.sum()), None if t is None else "\n".join(t[s:e] for s, e in runs)))
        return pd.DataFrame(out, columns=["n_tokens", "boilerplate_tokens", "unique_text"])

    return d.join(per, "pid", "left").select(F.col("id").alias(id_col), rest("text", "ats").alias("r")).select(id_col, "r.*")
