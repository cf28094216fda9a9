"""Grouped bootstrap: resampled groups enter as weights of their rows; rows are never copied."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siltmark.operators.metrics import ratio, usable
from siltmark.operators.ordered import running_totals

#: Draws (groups times replicates) that may be made on the driver; more is an error, not a silent cut.
MOST_DRAWS = 200_000_000
#: Replicates that one pass over the rows sums.
BLOCK = 50


def multiplicities(df: DataFrame, group: str, reps: int, seed: int = 0) -> DataFrame:
    """(group, m): how often each group is drawn in each replicate, an array of `reps` numbers.

    Draws like `default_rng(seed).choice` over the sorted distinct groups, replicate by replicate.
    """
    most = max(1, MOST_DRAWS // max(1, reps))
    names = df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(most + 1).toArrow().column(0)
    if len(names) > most:
        raise ValueError(f"more than {most} groups to draw {reps} times from")
    rng, n = np.random.default_rng(seed), len(names)
    drawn = np.stack([np.bincount(rng.choice(n, size=n, replace=True), minlength=n) for _ in range(reps)], axis=1) if n and reps else np.zeros((n, reps))
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * reps)
    weights = pa.ListArray.from_arrays(offsets, pa.array(drawn.astype(np.int32).ravel()))
    return df.sparkSession.createDataFrame(pa.table({group: names, "m": weights}))


def replicates(df: DataFrame, group: str, draws: DataFrame, reps: int) -> DataFrame:
    """(rep, auroc, n_pos, n_neg) of every replicate; replicates of one class give a null AUROC.

    Weights are summed per score, BLOCK replicates at a time as columns of one pass, so a row is shuffled once a
    block, whatever the number of groups it is drawn with.
    """
    rows = usable(df).join(draws, group)
    out = None
    for block in range(math.ceil(reps / BLOCK)):
        own = range(block * BLOCK, min(reps, (block + 1) * BLOCK))
        m = lambda k: F.col("m")[k]
        steps = rows.groupBy("s").agg(*[F.sum(m(k) * F.col("y")).cast("double").alias(f"p{k}") for k in own], *[F.sum(m(k) * (1 - F.col("y"))).cast("double").alias(f"n{k}") for k in own])
        run = running_totals(steps, "s", [f"n{k}" for k in own])
        area = [F.sum(F.col(f"p{k}") * (F.col(f"run_n{k}") - F.col(f"n{k}") / 2)).alias(f"u{k}") for k in own]
        sums = run.agg(*area, *[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in own for c in "pn"])
        per = F.array(*[F.struct(F.lit(k).alias("rep"), F.coalesce(f"u{k}", F.lit(0.0)).alias("u"), F.coalesce(f"p{k}", F.lit(0.0)).alias("p"), F.coalesce(f"n{k}", F.lit(0.0)).alias("n")) for k in own])
        part = sums.select(F.explode(per).alias("r")).select("r.rep", ratio(F.col("r.u"), F.col("r.p") * F.col("r.n"), None).alias("auroc"), F.col("r.p").cast("long").alias("n_pos"), F.col("r.n").cast("long").alias("n_neg"))
        out = part if out is None else out.unionByName(part)
    return out


def interval(values: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    low = (1 - level) / 2
    ends = F.percentile(column, F.array(F.lit(low), F.lit(1 - low)))
    return values.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("n_reps"), F.avg(column).alias("mean"), ends[0].alias("ci_lo"), ends[1].alias("ci_hi"))
