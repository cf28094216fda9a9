"""Model registry: one-row tables for fitted parameters, with what they were fitted on."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

BUNDLE = "model_id string, config string, inputs string, history string, arrays array<struct<name:string,shape:array<int>,data:array<double>>>"


def fingerprint(df: DataFrame) -> str:
    """Order-independent hash of all rows, computed in the cluster."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    row = df.select(F.xxhash64(*parts).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.shiftrightunsigned("h", 24)).alias("s")).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()


def save(spark: SparkSession, folder: str, model_id: str, arrays: dict[str, np.ndarray], config: dict, inputs: dict[str, str], history: list[dict] = ()) -> None:
    """Append one model; ids are meant to be unique."""
    rows = [(name, list(a.shape), [float(v) for v in np.asarray(a, dtype=float).ravel()]) for name, a in arrays.items()]
    spark.createDataFrame([(model_id, json.dumps(config, sort_keys=True), json.dumps(inputs, sort_keys=True), json.dumps(list(history)), rows)], BUNDLE).write.mode("append").parquet(folder)


def load(spark: SparkSession, folder: str, model_id: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, configuration); missing models raise KeyError."""
    row = spark.read.schema(BUNDLE).parquet(folder).where(F.col("model_id") == model_id).first()
    if row is None:
        raise KeyError(model_id)
    return {a.name: np.array(a.data).reshape(a.shape) for a in row.arrays}, json.loads(row.config)
