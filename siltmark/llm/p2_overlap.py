"""Problem 2: same or near-same records across splits.

A name is shingled into letter triples of its words, each tied to the gate (numbers, hash, form
factor, shot and competitor mark, which are never mistyped): names that differ in the gate share no
shingle. Minwise signatures are banded, buckets join evaluation names with training names only, and
candidates are verified by exact Jaccard similarity. Names whose corrected words are the same share one
more bucket and need no similarity: one typing error in a short word can leave one triple. Rows are collapsed to distinct names before
anything is shuffled by bucket, so hot names count once; they are expanded again at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
import xxhash

from siltmark.llm.records import records
from siltmark.session import cut_lineage

#: 24 bands of 2 rows: a pair of similarity 0.4 is missed with probability 0.015, one of 0.5 with 0.001.
BANDS, ROWS = 24, 2
#: One or two typing errors in short words cost up to half of the letter triples.
SIMILARITY = 0.4
EVAL_SPLITS = ("val", "test")
_PRIME = np.uint64((1 << 61) - 1)


def shingles(gate: str, raw: str) -> set[int]:
    """Hashes of gate and letter triple; a name without words has the one shingle of its gate."""
    text = f"^{raw}$" if raw else ""
    parts = {text[i : i + 3] for i in range(max(0, len(text) - 2))} or {""}
    return {xxhash.xxh64_intdigest(f"{gate}\x00{p}") for p in parts}


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhash(hashes: set[int], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.fromiter(hashes, dtype=np.uint64, count=len(hashes))
    mixed = x[:, None] * a[None, :] + b[None, :]
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0)


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(gates: pd.Series, raws: pd.Series) -> pd.Series:
    a, b = _coefficients(BANDS * ROWS)
    out = []
    for gate, raw in zip(gates, raws):
        signature = minhash(shingles(gate, raw), a, b).reshape(BANDS, ROWS)
        out.append([xxhash.xxh64_intdigest(signature[k].tobytes(), seed=k) - (1 << 63) for k in range(BANDS)])
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def jaccard(gate_a: pd.Series, raw_a: pd.Series, gate_b: pd.Series, raw_b: pd.Series) -> pd.Series:
    out = []
    for ga, ra, gb, rb in zip(gate_a, raw_a, gate_b, raw_b):
        x, y = shingles(ga, ra), shingles(gb, rb)
        out.append(len(x & y) / len(x | y))
    return pd.Series(out, dtype=float)


def name_overlaps(found: DataFrame) -> DataFrame:
    """(train_gate, train_raw, train_words, eval_raw, eval_words, similarity) of names across splits.

    `found` is `records`; records without an image overlap with nothing.
    """
    usable = found.where(F.col("gate").isNotNull() & F.col("split").isin("train", *EVAL_SPLITS))
    named = usable.groupBy("gate", "raw", "words").agg(F.max((F.col("split") == "train").cast("int")).alias("in_train"), F.max((F.col("split") != "train").cast("int")).alias("in_eval"))
    named = cut_lineage(named.withColumn("name_id", F.monotonically_increasing_id()))  # fixed by the checkpoint
    # buckets hold numbers only; names meet again when the candidates are known
    banded = cut_lineage(named.select("name_id", "in_train", "in_eval", F.explode(F.concat(band_keys("gate", "raw"), F.array(F.xxhash64("gate", "words")))).alias("key")))
    left = banded.where("in_train = 1").select("key", F.col("name_id").alias("t"))
    right = banded.where("in_eval = 1").select("key", F.col("name_id").alias("e"))
    pairs = left.join(right, "key").select("t", "e").distinct()
    trains = named.where("in_train = 1").select(F.col("name_id").alias("t"), "gate", F.col("raw").alias("train_raw"), F.col("words").alias("train_words"))
    evals = named.where("in_eval = 1").select(F.col("name_id").alias("e"), F.col("gate").alias("eval_gate"), F.col("raw").alias("eval_raw"), F.col("words").alias("eval_words"))
    both = pairs.join(trains, "t").join(evals, "e").where(F.col("gate") == F.col("eval_gate"))
    scored = both.withColumn("similarity", jaccard("gate", "train_raw", "eval_gate", "eval_raw")).where((F.col("similarity") >= SIMILARITY) | (F.col("train_words") == F.col("eval_words")))
    return scored.select("gate", "train_raw", "train_words", "eval_raw", "eval_words", "similarity")


def same_image_pairs(found: DataFrame) -> DataFrame:
    """(train_id, eval_id, eval_split, eval_source) of records that show the same image.

    Confirmed name pairs whose corrected words agree, joined back to the records of either name.
    """
    same = name_overlaps(found).where(F.col("train_words") == F.col("eval_words")).select("gate", "train_raw", "eval_raw", F.col("train_words").alias("words"))
    train = found.where("split = 'train'").select("gate", F.col("raw").alias("train_raw"), "words", F.col("sample_id").alias("train_id"))
    evals = found.where(F.col("split").isin(*EVAL_SPLITS)).select("gate", F.col("raw").alias("eval_raw"), "words", F.col("sample_id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    return same.join(train, ["gate", "train_raw", "words"]).join(evals, ["gate", "eval_raw", "words"]).select("train_id", "eval_id", "eval_split", "eval_source")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = same_image_pairs(cut_lineage(records(spark, sf_dir)))
    return pairs.select(F.least("train_id", "eval_id").alias("sample_a"), F.greatest("train_id", "eval_id").alias("sample_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: records, records shown again in train, and pairs."""
    found = cut_lineage(records(spark, sf_dir))
    same = name_overlaps(found).where(F.col("train_words") == F.col("eval_words")).select("gate", F.col("train_words").alias("words"), "train_raw", "eval_raw")
    named = found.where(F.col("gate").isNotNull()).groupBy("gate", "words", "raw", "split", "source").agg(F.count(F.lit(1)).alias("n"))
    train = named.where("split = 'train'").groupBy("gate", "words", F.col("raw").alias("train_raw")).agg(F.sum("n").alias("n_train"))
    evals = named.where(F.col("split").isin(*EVAL_SPLITS)).withColumnRenamed("raw", "eval_raw")
    # names stand for their records: a name of a train and b evaluation records is one row of n_train = a and n = b
    shown = same.join(train, ["gate", "words", "train_raw"]).groupBy("gate", "words", "eval_raw").agg(F.sum("n_train").alias("n_train"))
    hit = evals.join(shown, ["gate", "words", "eval_raw"]).groupBy("split", "source").agg(F.sum("n").alias("n_overlapping"), F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"))
    every = found.where(F.col("split").isin(*EVAL_SPLITS)).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"))
    hit = hit.withColumnRenamed("source", "hit_source").withColumnRenamed("split", "hit_split")
    return every.join(hit, F.col("split").eqNullSafe(F.col("hit_split")) & F.col("source").eqNullSafe(F.col("hit_source")), "left").drop("hit_split", "hit_source").na.fill(0, ["n_overlapping", "n_pairs"])
