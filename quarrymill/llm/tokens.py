"""Sizes of texts in tokens of a public tokenizer, whose files are a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folder of the vocabulary files; never copied into the library.
FOLDER = os.environ.get("QUARRYMILL_TOKENIZERS", "/opt/tokenizers")
RANKS = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_LOADED: dict = {}


def encoder(folder: str = FOLDER, ranks: str = RANKS):
    """The tokenizer of a rank file, loaded once a process."""
    import tiktoken

    if (folder, ranks) not in _LOADED:
        with open(os.path.join(folder, ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[folder, ranks] = tiktoken.Encoding(ranks, pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _LOADED[folder, ranks]


def size(text: str | Column, folder: str = FOLDER, ranks: str = RANKS) -> Column:
    """Tokens of a text; 0 for null and empty ones."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        enc = encoder(folder, ranks)
        return s.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int32")

    return run(text)
