"""Writers: versions with checks and a pointer, embedded vectors, class trees, packages and grids."""

from __future__ import annotations

import os
import tarfile
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.functions.imaging import decode_png, grey, pad_square, resize
from siltmark.sources.readers import reconcile

POINTER, BACKUP = "_current", "_previous"


def publish(df: DataFrame, folder: str, version: str) -> str:
    """Write a new version beside the old ones and return its path."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_pointer(spark: SparkSession, folder: str, name: str = POINTER) -> str | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not _file_system(spark, folder).exists(path):
        return None
    stream = _file_system(spark, folder).open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_pointer(spark: SparkSession, folder: str, name: str, value: str) -> None:
    """The pointer is written aside and renamed, so readers see the old one or the new one."""
    fs, path = _file_system(spark, folder), spark._jvm.org.apache.hadoop.fs.Path
    aside = path(f"{folder}/{name}.writing")
    out = fs.create(aside, True)
    out.write(bytearray(value.encode()))
    out.close()
    fs.delete(path(f"{folder}/{name}"), False)
    fs.rename(aside, path(f"{folder}/{name}"))


def publish_checked(df: DataFrame, folder: str, version: str, checks: dict[str, Callable[[DataFrame], bool]]) -> str:
    """Write a version, read it again, check it, then point to it; the version before stays as backup.

    A failed check raises and leaves the pointer where it was; the written version stays for inspection.
    """
    spark = df.sparkSession
    path = publish(df, folder, version)
    written = spark.read.parquet(path)
    failed = [name for name, check in checks.items() if not check(written)]
    if failed:
        raise ValueError(f"version {version} failed: {', '.join(failed)}")
    before = _read_pointer(spark, folder)
    if before:
        _write_pointer(spark, folder, BACKUP, before)
    _write_pointer(spark, folder, POINTER, version)
    return path


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The version that the pointer names."""
    version = _read_pointer(spark, folder)
    if version is None:
        raise FileNotFoundError(f"{folder} has no published version")
    return spark.read.parquet(f"{folder}/version={version}")


def roll_back(spark: SparkSession, folder: str) -> str:
    """Point to the backup version again."""
    before = _read_pointer(spark, folder, BACKUP)
    if before is None:
        raise FileNotFoundError(f"{folder} has no backup")
    _write_pointer(spark, folder, POINTER, before)
    return before


class Embedder(Protocol):
    """Vectors of a list of RGB images; `name` tells vectors of different embedders apart."""

    name: str

    def __call__(self, images: list[np.ndarray]) -> np.ndarray: ...


class GridEmbedder:
    """Mean light of a grid of cells of the padded screen: needs no weights, and works offline."""

    def __init__(self, cells: int = 16):
        self.cells, self.name = cells, f"grid{cells}"

    def __call__(self, images: list[np.ndarray]) -> np.ndarray:
        return np.stack([resize(grey(pad_square(i)), self.cells, self.cells).ravel() / 255 for i in images])


def embed(images: DataFrame, embedder: Embedder, keep: list[str], batch_rows: int = 64) -> DataFrame:
    """`keep` with emb and embedder, for every readable image (column content); batches of at most `batch_rows` images."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), batch_rows):
                rows = batch.iloc[low : low + batch_rows]
                decoded = [decode_png(c) for c in rows.content]
                fine = [i is not None for i in decoded]
                if any(fine):
                    made = embedder([i for i in decoded if i is not None])
                    yield rows[fine][keep].assign(emb=[v.astype(np.float32).tolist() for v in made], embedder=embedder.name)

    types = dict(images.dtypes)
    return images.select(*keep, "content").mapInPandas(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "emb array<float>", "embedder string"]))


def embed_and_persist(images: DataFrame, embedder: Embedder, folder: str, keep: list[str]) -> DataFrame:
    """Embed and write by split and source (both in `keep`); returns the rows of each part."""
    embed(images, embedder, keep).write.partitionBy("split", "source").mode("overwrite").parquet(folder)
    return images.sparkSession.read.parquet(folder).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def export_class_tree(images: DataFrame, folder: str) -> DataFrame:
    """Write content to split/source/category/name below a folder that all executors share; returns the manifest.

    Names must be unique within their folder (see `unique_names`). Writing again gives the same files.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = []
            for split, source, category, name, content in zip(batch.split, batch.source, batch.category, batch["name"], batch.content):
                path = os.path.join(split, source, category, name)
                os.makedirs(os.path.dirname(os.path.join(folder, path)), exist_ok=True)
                with open(os.path.join(folder, path), "wb") as f:
                    f.write(content)
                paths.append(path)
            yield pd.DataFrame({"path": paths, "split": batch.split, "source": batch.source, "category": batch.category})

    return images.select("split", "source", "category", "name", "content").mapInPandas(run, "path string, split string, source string, category string")


def package(spark: SparkSession, folder: str, manifest: DataFrame, out: str) -> str:
    """A tar of a folder with SHA256SUMS, after manifest (path below the folder) and folder agree; returns the tar's path.

    Hashes are computed in the cluster; the driver writes one line per file and the tar.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    below = F.regexp_replace("path", f"^.*{os.path.basename(folder.rstrip('/'))}/", "")
    hashed = files.select(below.alias("path"), F.sha2("content", 256).alias("sha256")).where("path <> 'SHA256SUMS'")
    wrong = reconcile(manifest, hashed, "path").limit(5).collect()
    if wrong:
        raise ValueError(f"manifest and folder differ: {', '.join(f'{r.path} only in {r.only_in}' for r in wrong)}")
    with open(os.path.join(folder, "SHA256SUMS"), "w") as f:
        f.writelines(f"{r.sha256}  {r.path}\n" for r in hashed.orderBy("path").toLocalIterator())
    with tarfile.open(out, "w") as tar:
        tar.add(folder, arcname=os.path.basename(folder.rstrip("/")))
    return out


def write_grid(rows: list[dict], folder: str, spark: SparkSession) -> DataFrame:
    """Results of a grid as one CSV file, best score first, NaN last; returns what was written."""
    columns = list(dict.fromkeys(k for r in rows for k in r))
    table = spark.createDataFrame(pd.DataFrame(rows, columns=columns))
    score = F.nanvl(F.coalesce(F.col("score").cast("double"), F.lit(float("nan"))), F.lit(float("-inf")))
    ordered = table.orderBy(F.desc(score), *[c for c in columns if c != "score"])
    ordered.coalesce(1).write.mode("overwrite").option("header", "true").csv(folder)  # one row per configuration
    return ordered
