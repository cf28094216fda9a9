"""Connected components by random-mate contraction, in SQL joins only.

Each round every vertex tosses a coin that follows from its name and the round; tails collapse into
their smallest head neighbour. Pendant vertices (one edge left) always lose the toss, so that stars,
the usual shape around a hot group, vanish in one round. Pointers are unwound by doubling.

Nothing is collected: the driver sees one row count per round. Every round is checkpointed to the
shared folder, so lost executors do not lose the state.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, functions as F

from siltmark.session import cut_lineage, ensure_checkpoint_dir

MAX_ROUNDS = 200


def settled(df: DataFrame) -> DataFrame:
    """`df` written to files of the shared checkpoint folder and read from there.

    A checkpoint hands on the planner's estimate of its size. Joins multiply that, so over rounds of joins it
    grows to numbers that fill the driver; the size of files is what it is.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/settled-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _collapse(edges: DataFrame, turn: int) -> DataFrame:
    """Pointers (u, p) of the vertices that this round collapses."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    degree = both.groupBy("v").agg(F.count(F.lit(1)).alias("v_degree"))
    seen = both.join(degree, "v")
    coin = (F.xxhash64("v", F.lit(turn)) % 2 == 0) & (F.col("v_degree") > 1)
    near = seen.groupBy("u").agg(
        F.count(F.lit(1)).alias("degree"),
        F.min(F.when(coin, F.col("v"))).alias("head"),
        F.min("v").alias("first"),
        F.min("v_degree").alias("first_degree"),
    )
    tails = (F.xxhash64("u", F.lit(turn)) % 2 != 0) & F.col("head").isNotNull()
    pendant = F.col("degree") == 1
    pair = pendant & (F.col("first_degree") == 1)
    target = F.when(pair, F.when(F.col("u") > F.col("first"), F.col("first"))).when(pendant, F.col("first")).when(tails, F.col("head"))
    return near.select("u", target.alias("p")).where(F.col("p").isNotNull())


def _relabel(edges: DataFrame, pointers: DataFrame) -> DataFrame:
    to_u = pointers.select("u", F.col("p").alias("pu"))
    to_v = pointers.select(F.col("u").alias("v"), F.col("p").alias("pv"))
    moved = edges.join(to_u, "u", "left").join(to_v, "v", "left")
    # an edge along which a vertex collapsed is spent, also where its target moves on in this round
    moved = moved.where(~F.col("pu").eqNullSafe(F.col("v")) & ~F.col("pv").eqNullSafe(F.col("u"))).select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
    return moved.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def random_mate_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (columns u, v of one type); loops and nulls are ignored.

    `root` is some node of the component, the same for all of its nodes. An empty table of edges
    gives an empty table. Nodes only seen in loops are not returned.
    """
    kept = edges.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = settled(kept)
    nodes = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    found: DataFrame | None = None
    for turn in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        pointers = cut_lineage(_collapse(left, turn))
        found = pointers if found is None else found.unionByName(pointers)
        left = settled(_relabel(left, pointers))
    else:
        raise RuntimeError(f"contraction did not end within {MAX_ROUNDS} rounds")
    if found is None:
        return nodes.select("node", F.col("node").alias("root"))
    # each vertex collapses once, so the pointers form a forest; doubling halves its depth
    while True:
        found = cut_lineage(found)
        onward = found.select(F.col("u").alias("p"), F.col("p").alias("next"))
        if found.join(onward, "p", "left_semi").isEmpty():
            break
        found = found.join(onward, "p", "left").select("u", F.coalesce("next", "p").alias("p"))
    return nodes.join(found.select(F.col("u").alias("node"), "p"), "node", "left").select("node", F.coalesce("p", "node").alias("root"))


#: A key with more than this part of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def join_hot(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """`rows` joined with a table of one row per key, however many rows a key has.

    The few keys that hold much of `rows` are sent to where their rows are; the rest is shuffled.
    """
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HOT_SHARE * rows.count()).select(key)
    hot = F.broadcast(cut_lineage(hot))  # at most 1 / HOT_SHARE rows
    here = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(here, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))
