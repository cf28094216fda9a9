"""Patch anomaly scores against a memory bank of clean patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.operators.ordered import quantiles
from siltmark.operators.similarity import nearest_references


def memory_bank(patches: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """`rows` patches in hash order: a uniform sample that is the same in every run."""
    return patches.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows)


def nearest_distance(queries: DataFrame, bank: DataFrame, vector: str) -> DataFrame:
    """(q_id, distance): Euclidean distance of unit vectors to the nearest other patch of the bank."""
    near = nearest_references(queries, bank, vector, 1)
    return near.select("q_id", F.sqrt(F.greatest(2 - 2 * F.col("cosine"), F.lit(0.0))).alias("distance"))


def calibration(bank: DataFrame, vector: str) -> DataFrame:
    """One row: median and 99.5th percentile of the bank's own nearest distances."""
    found = quantiles(nearest_distance(bank, bank, vector), "distance", [0.5, 0.995])
    return found.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p995"))


def anomaly(queries: DataFrame, bank: DataFrame, vector: str) -> DataFrame:
    """(q_id, score): 0 at the bank's median distance, 1 at its 99.5th percentile, cut to [0, 1]."""
    scale = F.col("distance") - F.col("p50")
    width = F.when(F.col("p995") > F.col("p50"), F.col("p995") - F.col("p50")).otherwise(F.lit(1e-9))
    joined = nearest_distance(queries, bank, vector).crossJoin(F.broadcast(calibration(bank, vector)))  # one row of calibration
    return joined.select("q_id", F.least(F.greatest(scale / width, F.lit(0.0)), F.lit(1.0)).alias("score"))


def negatives(patches: DataFrame, image: str, most: int = 200, seed: int = 0) -> DataFrame:
    """At most `most` content patches of every image, in hash order: training negatives."""
    order = Window.partitionBy(image).orderBy(F.xxhash64("id", F.lit(seed)), "id")
    kept = patches.where("content").withColumn("__r", F.row_number().over(order))
    return kept.where(F.col("__r") <= most).drop("__r")


def image_score(scores: DataFrame, image: str, fraction: float) -> DataFrame:
    """Mean of the largest part of each image's patch scores, at least one patch."""
    ranked = scores.withColumns({"r": F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "q_id")), "n": F.count(F.lit(1)).over(Window.partitionBy(image))})
    return ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * fraction))).groupBy(image).agg(F.avg("score").alias("score"))


def weighted_sample(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, proportional to weight: the smallest -ln(u) / weight win."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 1) / float(1 << 53)
    return df.where(F.col(weight) > 0).withColumn("__p", -F.log(u) / F.col(weight)).orderBy("__p", key).limit(n).drop("__p")
