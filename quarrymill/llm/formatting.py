"""Duplicates hidden by formatting, by progressive partition refinement."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.operators.components import connected_components
from quarrymill.runtime import Workspace

_DROP = re.compile(r"[\W_]+")


def bare(text: str | None) -> str:
    """NFKC, lower case, letters and digits only; null counts as empty."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text).lower()) if text else ""


def _invariants(parts: list[str]) -> int:
    """A cheap invariant of formatting and field order: total length and letter histogram, in 64 bits."""
    data = "".join(parts).encode("utf-32-le", "surrogatepass")
    codes = np.frombuffer(data, np.uint32)
    hist = np.bincount(codes % 251, minlength=251)
    return int.from_bytes(hashlib.blake2b(hist.tobytes() + len(codes).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)


def classes(df: DataFrame, id_col: str, fields: list[str], required: str, ws: Workspace) -> DataFrame:
    """``(id, key)`` of the rows that share their exact key with a row of another id.

    Rows are first split by the invariants (8 bytes a row travel), then rows of classes with several ids alone are
    split by the costly key: a 128-bit hash of the sorted bare fields. Classes with one id never get a key.
    """
    cols = [F.col(f) for f in fields]

    @F.pandas_udf("long")
    def cheap(*s: pd.Series) -> pd.Series:
        return pd.Series([_invariants([bare(x) for x in r]) for r in zip(*s)], dtype="int64")

    @F.pandas_udf("binary")
    def exact(*s: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b("\x00".join(sorted(map(bare, r))).encode("utf-8", "surrogatepass"), digest_size=16).digest() for r in zip(*s)])

    rows = df.where(F.col(id_col).isNotNull() & F.col(required).isNotNull())
    coarse = ws.cut(rows.select(F.col(id_col).alias("id"), cheap(*cols).alias("inv")), "coarse")
    several = coarse.groupBy("inv").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("inv")
    ids = ws.cut(coarse.join(several, "inv", "left_semi").select("id").distinct(), "members")
    fine = rows.join(ids, rows[id_col] == ids["id"], "left_semi").select(F.col(id_col).alias("id"), exact(*cols).alias("key")).distinct()
    fine = ws.cut(fine, "fine")
    shared = fine.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key", F.col("lo").alias("leader"))
    return fine.join(shared, "key")


def groups(df: DataFrame, id_col: str, fields: list[str], required: str) -> DataFrame:
    """``(id, leader)``: every id that has a copy, with the smallest id of its group (itself for the leader).

    Two ids are copies if rows of theirs with a ``required`` field hold the same bare texts in ``fields``, in
    whatever order of the fields; an id with several versions joins the groups of all of them. Null fields count
    as empty, rows without an id or the required field take no part, exact repeats of a row count once.
    """
    ws = Workspace(df.sparkSession, "formatting")
    links = ws.cut(classes(df, id_col, fields, required, ws).where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "links")
    return connected_components(links, ws=ws).select(F.col("node").alias("id"), F.col("component").alias("leader"))


def copies(df: DataFrame, id_col: str, fields: list[str], required: str) -> DataFrame:
    """``(id, leader)`` of the ids other than their group's leader."""
    return groups(df, id_col, fields, required).where("id <> leader")


def collapsed(df: DataFrame, id_col: str, fields: list[str], required: str) -> DataFrame:
    """One row a record: ``(leader, copies)``, copies being the number of ids it stands for (1: no copy)."""
    ids = df.where(F.col(id_col).isNotNull() & F.col(required).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    return ids.join(groups(df, id_col, fields, required), "id", "left").groupBy(F.coalesce("leader", "id").alias(id_col)).agg(F.count("*").alias("copies"))
