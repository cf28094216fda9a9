"""Readers and writers: manifests, label files, vectors, images, access control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.functions import names, taxonomy
from siltmark.guard import LOCK, HeldOutAccessError, guarded, is_held_out
from siltmark.operators.components import capture_components

# Column lists of the files that are read and written.
LABELS = "path string, split string, source string, category string, category_id int, label int, `group` string, form_factor string, orientation string, kind string, is_competitor string, has_boundbox string"
SPLIT_MANIFEST = "path string, label int, category string, `group` string, split string, form_factor string, orientation string, kind string, is_competitor string, has_boundbox string, source string"
EXPORT_MANIFEST = "arquivo string, split string, source string, category string, category_id int, label int, tipos_erro string, parent string, origem string, orig_source string, kind string"
POOL = "path string, source string, w int, h int, aspect double, `group` string, phash string, form_factor string, orientation string, device string"
CLEAN_SOURCE, ERROR_SOURCES = "no_erros", ("errors_dataset", "with_errors")
CAPTURE_PLAN = "app string, screen string, form_factor string, orientation string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest with the given columns; missing trailing columns are null."""
    return spark.read.csv(guarded(path), header=True, schema=schema, enforceSchema=True, escape='"', multiLine=True)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(guarded(path))


def unsigned_hash(text):
    """An unsigned 64-bit number in decimal digits as a bigint in two's complement."""
    return F.conv(text, 10, -10).cast("bigint")


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, stem, route, length) of every file below a folder; content is not read.

    route: junk for zone identifiers, other for files that are no images, image for the rest.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(guarded(folder)).select("path", "length")
    name = names.base_name(F.col("path"))
    route = F.when(F.col("path").contains("Zone.Identifier"), "junk").when(names.is_image(name), "image").otherwise("other")
    return files.select("path", name.alias("name"), names.stem(name).alias("stem"), route.alias("route"), "length")


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(guarded(folder))
    return files.select("path", names.base_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"))


def png_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, w, h) from the header bytes of PNG files; -1 for anything else.

    The source hands over whole files; only 24 bytes of each leave the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(guarded(folder))
    head = F.hex(F.substring("content", 1, 24))
    number = lambda at: F.conv(F.substring(head, at, 8), 16, 10).cast("int")
    png = head.startswith("89504E470D0A1A0A") & (F.length(head) == 48)
    return files.select("path", F.when(png, number(33)).otherwise(-1).alias("w"), F.when(png, number(41)).otherwise(-1).alias("h"))


def scan_classes(spark: SparkSession, folder: str, error_source: str) -> DataFrame:
    """(path, name, class, source, label, group) of a folder with one folder per class.

    The clean class and one of the two error sources are read; the other error source is left out.
    """
    if error_source not in ERROR_SOURCES:
        raise ValueError(f"unknown error source: {error_source}")
    parts = F.split("path", "/")
    files = scan_files(spark, folder).where("route = 'image'").withColumn("class", F.element_at(parts, -2))
    rows = files.where(F.col("class").isin(CLEAN_SOURCE, error_source))
    return rows.select("path", "name", "class", F.col("class").alias("source"), (F.col("class") != CLEAN_SOURCE).cast("int").alias("label"), names.group_key(F.col("name"), F.col("class")).alias("group"))


def has_file(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def scan_dataset(spark: SparkSession, folder: str, gap_seconds: int = 300) -> DataFrame:
    """(path, name, split, source, category, label, group, applied, parent) of a dataset folder, in either layout.

    With a `labels.csv` at the root the folder is flat (split/source/file) and the file's labels hold; rows whose
    file is missing are left out (`reconcile` names them). Otherwise split, source and category are the
    folders of a file, and clean files are grouped by capture session. Names of synthetic files tell parent and operators.
    """
    files = scan_files(spark, folder).where("route = 'image'")
    synthetic = F.col("source") == "synthetic"
    told = [F.when(synthetic, names.synthetic_operators(F.col("name"))).alias("applied"), F.when(synthetic, names.synthetic_parent(F.col("name"))).alias("parent")]
    if has_file(spark, f"{folder}/labels.csv"):
        rows = read_csv(spark, f"{folder}/labels.csv", LABELS).withColumn("name", names.base_name(F.col("path")))
        here = files.select(F.array_join(F.slice(F.split("path", "/"), -3, 3), "/").alias("path"))
        rows = rows.join(here, "path", "left_semi").withColumn("group", taxonomy.clean_group(F.col("group")))
        return rows.select("path", "name", "split", "source", "category", "label", "group", *told)
    parts = F.slice(F.split("path", "/"), -4, 3)
    rows = files.select("path", "name", parts[0].alias("split"), parts[1].alias("source"), parts[2].alias("category")).where(F.col("split").isin(*taxonomy.SPLITS) & F.col("source").isin("real", "synthetic"))
    rows = rows.withColumns({"label": (F.col("category") != "clean").cast("int"), "group": names.group_key(F.col("name"), F.col("source"))})
    clean = rows.where("category = 'clean'").select("path", "name").withColumns({"id": F.xxhash64("path"), "ts": names.shot_time(F.col("name"))})
    found = clean.join(capture_components(clean, "id", "ts", None, gap_seconds, 0), "id")
    named = found.groupBy("component").agg(F.min("name").alias("first"))
    sessions = found.join(named, "component").select("path", F.concat(F.lit("session:"), "first").alias("session"))
    return rows.join(sessions, "path", "left").select("path", "name", "split", "source", "category", "label", F.coalesce("session", "group").alias("group"), *told)


def error_aspects(labels: DataFrame, sizes: DataFrame, split: str = "train") -> DataFrame:
    """(path, aspect) of the error records of a split whose size (path, w, h) is known."""
    errors = labels.where((F.col("split") == split) & (F.col("label") == 1)).select("path")
    return errors.join(sizes.where("w > 0 AND h > 0"), "path").select("path", (F.col("w") / F.col("h")).alias("aspect"))


def reconcile(manifest: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Keys only the manifest has and keys only the folder has."""
    only = lambda a, b, side: a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit(side))
    return only(manifest, files, "manifest").unionByName(only(files, manifest, "files"))


def write_split_manifests(df: DataFrame, folder: str) -> DataFrame:
    """CSV files partitioned by split; returns the rows of each split."""
    df.write.partitionBy("split").mode("overwrite").option("header", "true").csv(folder)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def write_json_report(df: DataFrame, folder: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


__all__ = [
    "LOCK", "HeldOutAccessError", "error_aspects", "file_hashes", "guarded", "is_held_out", "png_sizes", "read_csv", "read_vectors", "reconcile",
    "scan_classes", "scan_dataset", "scan_files", "unsigned_hash", "write_json_report", "write_split_manifests",
]
