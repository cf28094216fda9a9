"""Rebuilding a dataset: representatives, recovered labels, sessions, group-atomic splits, checks, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltmark.config import Config
from siltmark.functions import names, taxonomy
from siltmark.operators import components, curate, splits
from siltmark.session import cut_lineage
from siltmark.sources.sinks import publish_checked


def session_groups(rows: DataFrame, config: Config, hashes: DataFrame | None = None) -> DataFrame:
    """`rows` with the group of clean captures replaced by what was captured together.

    That is their session, also over midnight, and, where `hashes` (name, phash) are given, what looks nearly the
    same, directly or through others; it is named by its first file name. Clean rows that stand alone without a
    capture time and all error rows keep their group.
    """
    timed = rows.withColumn("ts", names.shot_time(F.col("name")))
    clean = timed.where("category = 'clean'").select("sample_id", "name", "ts")
    if hashes is not None:
        clean = clean.join(hashes.groupBy("name").agg(F.min("phash").alias("phash")), "name", "left")
    found = components.capture_components(clean, "sample_id", "ts", None if hashes is None else "phash", config.split.gap_seconds, config.split.near_dup_radius)
    named = clean.join(found, "sample_id")
    together = named.groupBy("component").agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"), F.count("ts").alias("n_timed")).where("n > 1 OR n_timed > 0")
    keyed = named.join(together, "component").select("sample_id", taxonomy.clean_group(F.concat(F.lit("session:"), "first")).alias("session_group"))
    return timed.join(keyed, "sample_id", "left").withColumn("group", F.coalesce("session_group", "group")).drop("session_group", "ts")


def rebuild(labels: DataFrame, config: Config, hashes: DataFrame | None = None) -> DataFrame:
    """Real records, one per normalised name, with recovered labels and new splits.

    Groups are those of `session_groups`, in one spelling. Rows whose category cannot be recovered are left
    out; rows without a group stand alone. Raises if a group ends up in two splits.
    """
    tidy = curate.tidy_labels(labels).where("source = 'real'").withColumn("name", names.normalize_name(names.base_name(F.col("path"))))
    kept = curate.representatives(tidy, "name", names.base_name(F.col("path")), ["sample_id", "path", "category", "group", "form_factor", "orientation", "kind"]).withColumnRenamed("n", "copies")
    known = F.col("category").isin("clean", "black_bars", "disordered_layout", "empty_space", "overlay")
    kept = kept.withColumn("ticket", names.ticket(F.col("name")))
    by_ticket = curate.majority(kept.where(known), "ticket", "category", "sample_id").select("ticket", "majority")
    labelled = kept.join(by_ticket, "ticket", "left").withColumn("category", F.when(known, F.col("category")).otherwise(F.col("majority"))).where(F.col("category").isNotNull())
    grouped = session_groups(labelled.withColumn("group", F.coalesce("group", taxonomy.clean_group(F.concat(F.lit("file:"), "name")))), config, hashes)
    placed = cut_lineage(splits.grouped_stratified_split(grouped, "group", "category", "sample_id", config.split.val_frac, config.split.test_frac, config.split.seed))
    if not curate.leaks(placed.withColumn("group", taxonomy.clean_group(F.col("group"))), "group", "split").isEmpty():
        raise AssertionError("a group lies in more than one split")
    return placed.select("sample_id", "path", "name", "category", "group", "split", "form_factor", "orientation", "kind", "copies")


def merge_pool(dataset: DataFrame, pool: DataFrame, config: Config) -> DataFrame:
    """`dataset` with the clean pool rows whose name it does not hold, in group-atomic splits.

    Groups that the dataset knows keep their split; new groups fill the splits that lack most. The
    dataset's own rows stay as they are.
    """
    fresh = pool.withColumn("name", names.normalize_name(names.base_name(F.col("path")))).join(dataset.select("name"), "name", "left_anti")
    fresh = fresh.withColumn("group", F.coalesce(taxonomy.clean_group(F.col("group")), taxonomy.clean_group(F.concat(F.lit("file:"), "name"))))
    fresh = fresh.groupBy("name", "group").agg(F.min_by(F.struct("pool_id", "path", "form_factor", "orientation"), "pool_id").alias("r")).select("name", "group", "r.*")
    known = dataset.groupBy("group").agg(F.min("split").alias("known"))
    joined = cut_lineage(fresh.join(known, "group", "left"))
    share = config.split
    placed = splits.grouped_deficit_fill(joined.where("known IS NULL"), "group", {"train": 1 - share.val_frac - share.test_frac, "val": share.val_frac, "test": share.test_frac}, share.seed)
    rows = placed.unionByName(joined.where("known IS NOT NULL").withColumn("split", F.col("known")))
    added = rows.select("path", "name", F.lit("clean").alias("category"), "group", "split", "form_factor", "orientation", F.lit("screenshot").alias("kind"), F.lit("pool").alias("origin"))
    return dataset.select("path", "name", "category", "group", "split", "form_factor", "orientation", "kind", F.lit("dataset").alias("origin")).unionByName(added)


def run(labels: DataFrame, folder: str, config: Config, hashes: DataFrame | None = None) -> str:
    """Rebuild, check and publish under the key of the configuration; returns the new path."""
    checks = {
        "rows": lambda df: not df.isEmpty(),
        "splits": lambda df: df.where(~F.col("split").isin(*taxonomy.SPLITS)).isEmpty(),
        "groups": lambda df: curate.leaks(df, "group", "split").isEmpty(),
        "names": lambda df: df.groupBy("name").count().where("count > 1").isEmpty(),
    }
    return publish_checked(rebuild(labels, config, hashes), folder, config.key(), checks)
