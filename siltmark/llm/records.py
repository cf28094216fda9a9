"""Records of `labels` with the split, group and image that the problems on screenshots need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

import pandas as pd

from siltmark.llm import names
from siltmark.session import cut_lineage, table


@F.pandas_udf(T.StringType())
def _stem_of_synthetic(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: names.parent_stem(names.base_name(p)) if p else None)


def _named_stem(group):
    """The stem in a `synthparent:<stem>` group, whatever its case and blanks."""
    return F.nullif(F.trim(F.regexp_extract(group, r"(?is)^\s*synth\s*parent\s*:\s*(.*)$", 1)), F.lit(""))


def labelled_names(spark: SparkSession, sf_dir: str, parents_from_cache: bool = True) -> DataFrame:
    """(sample_id, split, source, group_key, is_real, shown): `shown` names the image of the record.

    A real record shows its own file name. A synthetic record shows its parent, told by its own file
    name, its group, the export manifest (a stem, a sample_id in digits or the path of the parent
    file) or the embedding cache, in this order; repeated rows of one path share what one of them
    tells. Records whose parent nobody tells have a null `shown`.
    """
    labels = table(spark, sf_dir, "labels").select("sample_id", "path", "split", "source", F.col("group").alias("raw_group"))
    labels = labels.withColumn("is_real", F.lower(F.trim(F.coalesce("source", F.lit("real")))) != "synthetic")
    synthetic = labels.where(~F.col("is_real"))
    told = synthetic.select("sample_id", "path", F.coalesce(_stem_of_synthetic("path"), _named_stem(F.col("raw_group"))).alias("told"))

    manifest = table(spark, sf_dir, "export_manifest").where(F.lower(F.trim("source")) == "synthetic").select("sample_id", F.nullif(F.trim("parent"), F.lit("")).alias("parent"), F.nullif(F.trim("origem"), F.lit("")).alias("origem"))
    by_id = manifest.where(F.col("parent").rlike(r"^\d{1,18}$")).select("sample_id", F.col("parent").cast("bigint").alias("parent_id"))
    parents = labels.where("is_real").select(F.col("sample_id").alias("parent_id"), F.col("path").alias("parent_path"))
    evidence = (
        by_id.join(parents, "parent_id").select("sample_id", F.col("parent_path").alias("evidence"))
        .unionByName(manifest.select("sample_id", F.when(~F.coalesce("parent", F.lit("1")).rlike(r"^\d{1,18}$"), F.col("parent")).alias("evidence")))
        .unionByName(manifest.select("sample_id", F.col("origem").alias("evidence")))
        .where(F.col("evidence").isNotNull()).groupBy("sample_id").agg(F.min("evidence").alias("evidence"))
    )
    told = told.join(evidence, "sample_id", "left").select("sample_id", "path", F.coalesce("told", "evidence").alias("told"))
    per_path = told.where(F.col("told").isNotNull()).select("path", "told")
    if parents_from_cache:
        cached = table(spark, sf_dir, "emb_cache").where(F.col("parent").isNotNull() & (F.trim("parent") != "")).select("path", F.col("parent").alias("told"))
        per_path = per_path.unionByName(cached)
    # files that name nobody themselves: few rows, one row per path on the right
    missing = told.where(F.col("told").isNull()).select("sample_id", "path")
    per_path = per_path.join(missing.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.min("told").alias("told"))
    filled = missing.join(per_path, "path", "left").select("sample_id", "told")
    told = told.where(F.col("told").isNotNull()).select("sample_id", "told").unionByName(filled)

    out = labels.join(told, "sample_id", "left")
    return out.select(
        "sample_id",
        names.clean_split(F.col("split"), F.col("path")).alias("split"),
        F.lower(F.trim("source")).alias("source"),
        F.when(F.col("is_real"), names.group_key(F.col("raw_group"))).alias("group_key"),
        "is_real",
        F.when(F.col("is_real"), F.element_at(F.split("path", "/"), -1)).otherwise(F.col("told")).alias("shown"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labelled_names` with gate, words and raw of the image (see `names`); checkpointed once."""
    named = cut_lineage(labelled_names(spark, sf_dir))
    lexicon = names.learn_lexicon(named.select("shown"))
    return named.withColumn("image", names.parser(lexicon)("shown")).select("sample_id", "split", "source", "group_key", "is_real", "image.gate", "image.words", "image.raw")
