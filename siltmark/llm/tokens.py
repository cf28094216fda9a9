"""Sizes of texts in tokens of a public byte-level BPE vocabulary, and the folding of source names."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F
from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary splits text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding_of(lines: bytes):
    """The tokenizer of base64 tokens and ranks, one per line."""
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load_encoding(path: str):
    """The tokenizer of a vocabulary file; loaded once per process."""
    if path not in _loaded:
        with open(path, "rb") as f:
            _loaded[path] = encoding_of(f.read())
    return _loaded[path]


def token_count(spark: SparkSession, folder: str = TOKENIZERS, file: str = VOCABULARY):
    """Arrow UDF string -> number of tokens; null and empty texts have none.

    The vocabulary file is read by the driver and travels with the job, so workers need no copy of it.
    """
    path = os.path.join(folder, file)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())  # one vocabulary file, about a megabyte

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        if path not in _loaded:
            _loaded[path] = encoding_of(shared.value)
        return texts.map(lambda t: len(_loaded[path].encode_ordinary(t)) if t else 0).astype("int64")

    return count


def source_key(source: Column) -> Column:
    """A source without case, blanks, `-` and `_`; null and blank give the empty name."""
    return F.regexp_replace(F.lower(F.coalesce(source, F.lit(""))), r"[\s_\- ]+", "")
