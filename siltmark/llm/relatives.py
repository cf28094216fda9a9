"""The second look of problems 1 and 4: vectors that the first look links meet whole, wherever their cells lie.

The first look (see `multi_index`) visits a number of directions that does not grow with the table, so in a large
table it finds a part of what is similar to a vector. What it finds of cosine LINKED and more are relatives, and
relatives of relatives make a set. Every vector of a set meets all of its set. One vector of every set of LEAST
and more, and all vectors of smaller ones, ask an index of the former, where as many visits reach much farther: sets
that relatives lie in are joined (up to SCANNED of them need no index). When no more than SCANNED vectors are left without a set, they meet all vectors
where they lie.

Two things are left as the first look has them: what more than SCANNED vectors without a set do not find, and sets of more
than SET_ROWS (a chain or a mass; its square would be compared).
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.llm import multi_index as mi
from siltmark.llm.components import random_mate_components, settled
from siltmark.session import cut_lineage

#: Above what unrelated vectors reach in a large table (0.40 in check_l), below what a set holds (0.6).
LINKED = 0.5
#: The K of problem 1 and the vector itself.
LEAST = 6
#: Vectors that may be sent to every task.
SCANNED = 8192
SET_ROWS = 32768
#: Vectors of a task that compares within sets, about.
TASK_ROWS = 8192


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what was checkpointed and is not referred to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, payload) of the usable vectors."""
    return vectors.mapInArrow(mi.reader(lambda ids, x: pa.record_batch({"vec_id": pa.array(ids), "payload": pa.array(mi.encode(x), pa.binary())})), "vec_id long, payload binary")


def sets_of(links: DataFrame) -> DataFrame:
    """(vec_id, root, n), written: linked vectors with some vector of their set and the size of the set."""
    roots = random_mate_components(links)
    return settled(roots.join(roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select(F.col("node").alias("vec_id"), "root", "n"))


def placed(spark: SparkSession, both: DataFrame) -> DataFrame:
    """What tasks need when the `few` of some vectors (checkpointed) are entries, and all of them are queries."""
    few, asking = both.where("few"), both.where("NOT few")
    index = mi.build_index(spark, few)
    index.chunks = mi.chunks_of(spark, both, both.count(), index, mi.TARGET)
    return mi.send(spark, few, index, mi.TARGET).unionByName(mi.send(spark, asking, index, mi.TARGET, ("asks",)))


def related_sets(spark: SparkSession, vectors: DataFrame, links: DataFrame, look: Callable[[DataFrame], DataFrame], scan: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(vec_id, root, n) as in `sets_of`, when vectors of small sets were placed.

    `links` (u, v) are those of the first look; `look` (rows of the schema SENT) and `scan` (vectors, and at most
    SCANNED that meet all of them) return what links they find.
    """
    sets = sets_of(links)
    ids = vectors.mapInArrow(mi.reader(lambda ids, x: pa.record_batch({"vec_id": pa.array(ids)})), "vec_id long")
    for scanning in (False, True):
        whole = sets.where(F.col("n") >= LEAST).select("vec_id", "root")
        alone = cut_lineage(ids.join(whole, "vec_id", "left_anti").distinct())
        left = alone.count()
        release(spark)
        if scanning and not 0 < left <= SCANNED:
            break
        if scanning:
            new = scan(vectors, vectors.join(F.broadcast(alone), "vec_id", "left_semi"))  # at most SCANNED ids
        else:
            roots = whole.select(F.col("root").alias("vec_id")).distinct()
            if roots.isEmpty():
                break
            # all vectors are shuffled once for both, as payloads, and their files may go before the next step
            wanted = roots.withColumn("few", F.lit(True)).unionByName(alone.withColumn("few", F.lit(False)))
            both = cut_lineage(packed(vectors).join(wanted, "vec_id"))
            release(spark)
            new = scan(both.where("few"), both) if both.count() <= SCANNED else look(placed(spark, both))
        # vectors of whole sets stand for their sets, the others for themselves
        for c in ("u", "v"):
            new = new.join(whole.select(F.col("vec_id").alias(c), F.col("root").alias("__root")), c, "left").withColumn(c, F.coalesce("__root", c)).drop("__root")
        small = sets.where(F.col("n") < LEAST).select(F.col("vec_id").alias("u"), F.col("root").alias("v"))
        moved = random_mate_components(new.select("u", "v").unionByName(small)).select(F.col("node").alias("root"), F.col("root").alias("to"))
        base = whole.unionByName(alone.select("vec_id", F.col("vec_id").alias("root")))
        base = settled(base.join(moved, "root", "left").select("vec_id", F.coalesce("to", "root").alias("root")))
        sets = settled(base.join(base.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root").select("vec_id", "root", "n"))
    return sets


def meeting(vectors: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the schema SENT: every vector of a set, once, in the task of its set; the set stands for its cell."""
    wanted = sets.where(F.col("n").between(2, SET_ROWS))
    tasks = max(1, wanted.count() // TASK_ROWS)
    number = F.xxhash64("root", F.lit(5))
    zero, yes = F.lit(0).alias("leaf"), F.lit(True)
    placed = wanted.select("vec_id", F.pmod(number, F.lit(tasks)).cast("int").alias("bin"), F.array((F.shiftrightunsigned(number, 33)).cast("int")).alias("cells"))
    joined = packed(vectors).join(placed, "vec_id")
    return joined.select("bin", zero, F.lit(0).alias("part"), F.lit(0).alias("chunk"), yes.alias("entry"), yes.alias("asks"), "cells", F.array("vec_id").alias("ids"), "payload")
