"""Session factory, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from siltmark.guard import guarded


def build_session(app: str = "siltmark", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the library is tested under: UTC, ANSI, AQE, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; columns and filters are pruned into the scan by Catalyst."""
    guarded(name)  # tables of held-out splits are locked, whatever folder they lie in
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's `spark.checkpoint.dir`, else a folder of our own.

    The fallback is for local sessions that name no shared folder (tests, a laptop); elsewhere a missing
    folder is an error, because executors do not share a temporary one.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    wanted = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
    if not wanted and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    wanted = wanted or tempfile.mkdtemp(prefix="siltmark-checkpoint-")
    context.setCheckpointDir(wanted)
    return wanted


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the shared checkpoint folder and continue from there.

    Reliable checkpoints survive the loss of executors, which local checkpoints do not.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """`df` in enough partitions to keep all cores busy with work that is heavy per row.

    A small compressed file can be one split; inputs that already have enough splits stay as they are.
    """
    wanted = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted)
