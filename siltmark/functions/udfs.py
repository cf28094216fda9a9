"""Functions for SQL: vectorised UDFs and a table function of threshold sweeps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql import types as T

from siltmark.functions import imaging


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def l2_normalize(vectors: pd.Series) -> pd.Series:
    """Vectors of length 1; zero vectors stay, null stays null."""
    known = vectors[vectors.notna()]
    if not len(known):
        return vectors
    flat = np.concatenate([np.asarray(v, dtype=float) for v in known]) if known.map(len).sum() else np.empty(0)
    ends = np.cumsum(known.map(len).to_numpy())
    owner = np.repeat(np.arange(len(known)), known.map(len).to_numpy())
    length = np.sqrt(np.bincount(owner, flat * flat, len(known)))
    flat = flat / np.where(length > 0, length, 1.0)[owner]
    return pd.Series(np.split(flat, ends[:-1]), index=known.index).reindex(vectors.index)


@F.pandas_udf(T.LongType())
def dhash64(contents: pd.Series) -> pd.Series:
    """Perceptual hash of PNG bytes; null for what is no readable PNG."""
    images = contents.map(imaging.decode_png)
    return pd.Series([None if i is None else imaging.dhash64(i) for i in images], dtype="Int64")


class ThresholdSweep:
    """Rows (threshold, tp, np) at the ends of tied scores, largest first; rows come as (y, s) arrays."""

    def eval(self, y, s) -> Iterator[tuple[float, int, int]]:
        rows = sorted(zip(s or [], y or []), key=lambda r: -r[0])
        tp = 0
        for i, (score, label) in enumerate(rows):
            tp += int(label)
            if i + 1 == len(rows) or rows[i + 1][0] != score:
                yield float(score), tp, i + 1


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL as l2_normalize, dhash64 and threshold_sweep."""
    spark.udf.register("l2_normalize", l2_normalize)
    spark.udf.register("dhash64", dhash64)
    spark.udtf.register("threshold_sweep", F.udtf(ThresholdSweep, returnType="threshold double, tp int, np int"))
