"""Incremental ingestion: landed files, exact and perceptual deduplication, session windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.operators.components import greedy_hashes

def landed(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the parquet files that land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def exact_dedup(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key; state older than the delay is dropped with the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Closed sessions per key in append mode; filter on the aggregates, never on the window."""
    window = F.session_window(ts, gap).alias("w")
    return stream.withWatermark(ts, delay).groupBy(window, key).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")).select(key, "n", "first_ts", "last_ts")


def perceptual_dedup(stream: DataFrame, radius: int, folder: str) -> DataFrame:
    """(id, phash, kept) of what has landed: greedy deduplication against all hashes kept so far, whatever their source.

    Every micro-batch meets the kept hashes of the earlier ones in a join and then itself, in the order of its
    ids; no task holds all kept hashes. Batches write under their number, so one that runs twice leaves the same files.
    Null hashes are kept.
    """
    spark, out = stream.sparkSession, f"{folder}/kept"
    schema = "id long, phash long, kept boolean, batch long"

    def step(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(out).where(F.col("kept") & (F.col("batch") < number)).select("phash") if number else None
        found = greedy_hashes(batch.select("id", "phash"), "id", "phash", radius, before)
        found.select("id", "phash", "kept").write.mode("overwrite").parquet(f"{out}/batch={number}")

    each_batch(stream, folder, step)
    return spark.read.schema(schema).parquet(out).select("id", "phash", "kept")


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed, into parquet with a checkpoint, and read the result."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def each_batch(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Persist after every micro-batch with a checkpoint, so a restart loses nothing."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
