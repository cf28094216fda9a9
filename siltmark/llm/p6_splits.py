"""Problem 6: splits that keep related records together.

Records and hubs form a sparse graph: a real record hangs on its group, a synthetic record on the
image it shows, and a real record also on its image if some synthetic record shows it. A hub stands
for all pairs of its members, so a group with a third of all rows costs one edge per image with
derived records. Components come from random-mate contraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siltmark.llm.components import join_hot, random_mate_components
from siltmark.llm.records import records
from siltmark.session import cut_lineage

SHARES = {"train": 0.61, "val": 0.15, "test": 0.24}
#: Components above this part of all rows are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.001
BUCKETS = 4096


def related_sets(found: DataFrame) -> DataFrame:
    """(sample_id, split, source, first_id) from `records`: first_id is the smallest id of the set.

    Null and blank groups name no group; records that nothing ties to others are sets of one.
    """
    image = F.when(F.col("gate").isNotNull(), F.concat(F.lit("i:"), "gate", F.lit("#"), "words"))
    hung = found.select("sample_id", "split", "source", "is_real", F.concat(F.lit("g:"), "group_key").alias("g"), image.alias("i"))
    derived = hung.where(~F.col("is_real") & F.col("i").isNotNull()).select("i").distinct().withColumn("has_derived", F.lit(True))
    hung = hung.join(derived, "i", "left")
    hub = F.when(F.col("is_real"), F.coalesce("g", F.when(F.col("has_derived"), F.col("i")))).otherwise(F.col("i"))
    hung = cut_lineage(hung.select("sample_id", "split", "source", F.coalesce(hub, F.concat(F.lit("s:"), F.col("sample_id").cast("string"))).alias("node"), F.when(F.col("is_real") & F.col("has_derived"), F.col("i")).alias("i")))
    edges = hung.where(F.col("i").isNotNull() & (F.col("i") != F.col("node"))).select(F.col("node").alias("u"), F.col("i").alias("v")).distinct()
    roots = random_mate_components(edges)
    placed = cut_lineage(join_hot(hung, roots, "node", "left").select("sample_id", "split", "source", F.coalesce("root", "node").alias("root")))
    first = placed.groupBy("root").agg(F.min("sample_id").alias("first_id"))
    return join_hot(placed, first, "root").select("sample_id", "split", "source", "first_id")


def divided_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: first_id of the sets whose records now lie in more than one split."""
    sets = related_sets(records(spark, sf_dir))
    return sets.groupBy("first_id").agg(F.min("split").alias("a"), F.max("split").alias("b")).where(F.col("a") != F.col("b")).select("first_id")


def assign_splits(sets: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(sample_id, first_id, split): whole sets, with shares of rows near `shares`.

    Large sets go one by one to the split that lacks most; the small ones follow in hash order by
    cumulative weight, each to the split in whose interval its middle lies. The running sum is built
    from bucket totals, so no task sees all sets. An empty table gives an empty table.
    """
    sizes = cut_lineage(sets.groupBy("first_id").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.pmod(F.xxhash64("first_id"), F.lit(BUCKETS))))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    filled = dict.fromkeys(shares, 0)
    large: list[tuple[int, str]] = []
    for row in sizes.where(F.col("n") > LARGE * total).orderBy(F.desc("n"), "first_id").toLocalIterator():
        split = max(shares, key=lambda s: shares[s] * total - filled[s])
        filled[split] += row.n
        large.append((row.first_id, split))
    room = {s: max(0.0, shares[s] * total - filled[s]) for s in shares}
    scale = sum(room.values()) or 1.0
    small = sizes.where(F.col("n") <= LARGE * total)
    per_bucket = small.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    before = per_bucket.select("bucket", (F.sum("in_bucket").over(Window.orderBy("bucket")) - F.col("in_bucket")).alias("before"), F.sum("in_bucket").over(Window.partitionBy()).alias("all_small"))
    inside = Window.partitionBy("bucket").orderBy(F.xxhash64("first_id", F.lit(7)), "first_id")
    middle = (F.col("before") + F.sum("n").over(inside) - F.col("n") / 2) / F.col("all_small")
    split, edge = None, 0.0
    placed = small.join(F.broadcast(before), "bucket").select("first_id", middle.alias("at"))
    for name in shares:
        edge += room[name] / scale
        split = F.when(F.col("at") < edge, name) if split is None else split.when(F.col("at") < edge, name)
    spark = sets.sparkSession
    chosen = placed.select("first_id", F.coalesce(split, F.lit(list(shares)[-1])).alias("split"))
    chosen = chosen.unionByName(spark.createDataFrame(large, "first_id long, split string"))
    return join_hot(sets.select("sample_id", "first_id"), chosen, "first_id").select("sample_id", "first_id", "split")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its set and its new split."""
    return assign_splits(cut_lineage(related_sets(records(spark, sf_dir))))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, sets and shares of each new split beside the target."""
    placed = p6_splits(spark, sf_dir)
    per = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("first_id").alias("n_sets"))
    target = spark.createDataFrame(list(SHARES.items()), "split string, target double")
    joined = target.join(per, "split", "left").na.fill(0, ["n_rows", "n_sets"])
    return joined.select("split", "n_rows", "n_sets", F.round(F.col("n_rows") / F.greatest(F.sum("n_rows").over(Window.partitionBy()), F.lit(1)), 6).alias("share"), "target")
