"""Text to vectors: hashed words without a model, or an injected encoder behind a cache."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.sources.files import cached_map

_WORD = re.compile(r"[^\W_]+")


def hashed(text: str | None, dims: int) -> list[float] | None:
    """Signed counts of hashed words and word pairs, scaled to length one; null for texts without a word."""
    ws = _WORD.findall((text or "").lower())
    h = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]], np.int64)
    v = np.bincount(h % dims, np.where(h >> 31, 1.0, -1.0), dims) if len(h) else np.zeros(dims)
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else None


def hashed_vector(c: Column | str, dims: int = 256) -> Column:
    """The hashed vector of a text column; null for null, empty and wordless texts."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: hashed(t, dims))

    return run(c)


def encoded(df: DataFrame, key: str, text: str, cache_path: str, encode) -> DataFrame:
    """``df`` with ``vector``, by an injected encoder (a list of texts to a matrix). Only keys that the cache lacks are
    encoded, in batches; vectors have length one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = np.asarray(encode(pdf[text].tolist()), float)
                yield pd.DataFrame({key: pdf[key], "vector": list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))})

    return cached_map(df, key, cache_path, lambda missing: missing.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<double>"))
