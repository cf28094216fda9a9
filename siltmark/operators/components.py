"""Sessions, near-duplicate links of perceptual hashes and connected groups."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.session import cut_lineage

HASH_BITS = 64


def sessionize(df: DataFrame, key: list[str], ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """`df` with `session`, counted from 0 per key; a gap of exactly `gap_seconds` keeps the session.

    Rows without a time stand in no session.
    """
    order = Window.partitionBy(*key).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))
    opened = df.where(F.col(ts).isNotNull()).withColumn("__new", (gap > gap_seconds * 1_000_000).cast("int"))
    return opened.withColumn("session", F.sum(F.coalesce("__new", F.lit(0))).over(order)).drop("__new")


def sessions_across_days(df: DataFrame, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """`df` with `session`, counted from 0 over all rows; a gap of exactly `gap_seconds` keeps the session.

    The order is global: days are sessionized on their own, then joined where midnight falls into a
    session, so no task sees more than a day. Rows without a time are left out.
    """
    daily = sessionize(df.where(F.col(ts).isNotNull()).withColumn("__day", F.to_date(ts)), ["__day"], ts, tie, gap_seconds)
    ends = daily.groupBy("__day").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.max("session").alias("opened"))
    across = Window.orderBy("__day")  # one row per day
    apart = F.unix_micros(F.col("first").cast("timestamp")) - F.unix_micros(F.lag("last").over(across).cast("timestamp")) > gap_seconds * 1_000_000
    stepped = ends.withColumn("__step", F.coalesce(F.lag("opened").over(across), F.lit(0)) + F.when(apart, 1).otherwise(0))
    base = stepped.select("__day", F.sum("__step").over(across).alias("__base"))
    return daily.join(base, "__day").withColumn("session", F.col("session") + F.col("__base")).drop("__day", "__base")


def block_keys(h: Column, radius: int, agreeing: int) -> Column:
    """One key per choice of `agreeing` of radius + agreeing bit ranges.

    Bits that differ within the radius touch at most `radius` ranges, so near hashes share a key.
    """
    n = radius + agreeing
    cuts = [HASH_BITS * i // n for i in range(n + 1)]
    chosen = [sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in choice) for choice in combinations(range(n), agreeing)]
    signed = [m - (1 << HASH_BITS) if m >> (HASH_BITS - 1) else m for m in chosen]
    return F.array(*[F.struct(F.lit(i).alias("choice"), h.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])


def agreeing_blocks(hashes: int, radius: int) -> int:
    """Ranges per key, so that a hash meets about 32 others by chance: comparing those costs less than the rows of more keys."""
    wanted = math.log2(max(hashes, 2)) - 5
    return next((k for k in range(1, 5) if HASH_BITS * k / (radius + k) >= wanted), 4)


def near_hashes(df: DataFrame, h: str, radius: int) -> DataFrame:
    """(a, b, distance) of distinct hashes a < b within the Hamming radius; equal hashes count once."""
    hashes = df.select(F.col(h).alias("h")).where(F.col(h).isNotNull()).distinct()
    spread = hashes.select("h", F.explode(block_keys(F.col("h"), radius, agreeing_blocks(hashes.count(), radius))).alias("key"))
    a, b = spread.select(F.col("h").alias("a"), "key"), spread.select(F.col("h").alias("b"), "key")
    # one row per key: much more than the size of the hashes lets Spark expect, which may not be broadcast
    close = a.join(b.hint("merge"), "key").where(F.col("a") < F.col("b")).withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    return close.where(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def unseen_hashes(new: DataFrame, seen: DataFrame, h: str, radius: int) -> DataFrame:
    """Rows of `new` without a hash of `seen` within the radius; rows without a hash stay."""
    ours = new.select(F.col(h).alias("a")).where(F.col(h).isNotNull()).distinct()
    theirs = seen.select(F.col(h).alias("b")).where(F.col(h).isNotNull()).distinct()
    agreeing = agreeing_blocks(theirs.count(), radius)
    ours, theirs = ours.select("a", F.explode(block_keys(F.col("a"), radius, agreeing)).alias("key")), theirs.select("b", F.explode(block_keys(F.col("b"), radius, agreeing)).alias("key"))
    known = ours.join(theirs.hint("merge"), "key").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select(F.col("a").alias(h)).distinct()
    return new.join(known, h, "left_anti")


def smallest_labels(nodes: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of each node's component, by label passing with jumps.

    `nodes` has `node`, `edges` has u and v. Every round is checkpointed to the shared folder.
    """
    both = cut_lineage(edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select(F.col("e.u").alias("node"), F.col("e.v").alias("near")).where("node <> near").distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")).distinct())
    for _ in range(most_rounds):
        heard = both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("said")), "near").groupBy("node").agg(F.min("said").alias("said"))
        passed = labels.join(heard, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("said", "label")).alias("label"))
        jump = passed.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut_lineage(passed.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")))
        if new.where("old <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def capture_components(df: DataFrame, key: str, ts: str, h: str | None, gap_seconds: int, radius: int) -> DataFrame:
    """(key, component): rows of one session, or of near or equal hashes, directly or through others.

    `component` is the smallest key of it. Rows without a time and without a near hash stand alone; without a
    hash column sessions are the components.
    """
    rows = df.select(F.col(key).alias("node"), F.col(ts).alias("ts"), (F.col(h) if h else F.lit(None).cast("long")).alias("h"))
    timed = sessions_across_days(rows.select("node", "ts"), "ts", "node", gap_seconds)
    heads = timed.groupBy("session").agg(F.min("node").alias("head"))
    rows = cut_lineage(rows.join(timed.join(heads, "session").select("node", "head"), "node", "left").select("node", F.coalesce("head", "node").alias("head"), "h"))
    if h is None:
        return rows.select(F.col("node").alias(key), F.col("head").alias("component"))
    # one row per hash stands for its copies; every edge leads from a session's first row to that of another
    hashed = rows.where(F.col("h").isNotNull()).select("h", "head").distinct()
    first = hashed.groupBy("h").agg(F.min("head").alias("first"))
    same = hashed.join(first, "h").select(F.col("head").alias("u"), F.col("first").alias("v"))
    near = near_hashes(rows, "h", radius).join(first.select(F.col("h").alias("a"), F.col("first").alias("u")), "a").join(first.select(F.col("h").alias("b"), F.col("first").alias("v")), "b").select("u", "v")
    edges = same.unionByName(near).where("u <> v").distinct()
    labels = smallest_labels(edges.select(F.explode(F.array("u", "v")).alias("node")), edges)
    joined = rows.join(labels.select(F.col("node").alias("head"), "label"), "head", "left")
    return joined.select(F.col("node").alias(key), F.coalesce("label", "head").alias("component"))


def first_come(nodes: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node): what one pass in the order of `pos` keeps, if it keeps every node that touches none kept before.

    `nodes` has node and pos (ties by node), `edges` u and v. In rounds, a node that comes before all open nodes it
    touches is kept and closes them: the same nodes as one after the other. Every round is checkpointed.
    """
    open_ = cut_lineage(nodes.select("node", "pos"))
    a = edges.join(open_.select(F.col("node").alias("u"), F.struct("pos", F.col("node")).alias("at_u")), "u").join(open_.select(F.col("node").alias("v"), F.struct("pos", F.col("node")).alias("at_v")), "v")
    pairs = cut_lineage(a.select(F.least("at_u", "at_v")["node"].alias("early"), F.greatest("at_u", "at_v")["node"].alias("late")).where("early <> late").distinct())
    open_, kept = open_.select("node"), None
    for _ in range(most_rounds):
        new = cut_lineage(open_.join(pairs.select(F.col("late").alias("node")), "node", "left_anti"))
        kept = new if kept is None else kept.unionByName(new)
        if pairs.isEmpty():
            return kept
        closed = pairs.join(new.select(F.col("node").alias("early")), "early", "left_semi").select(F.col("late").alias("node"))
        open_ = cut_lineage(open_.join(new.unionByName(closed), "node", "left_anti"))
        pairs = cut_lineage(pairs.join(open_.select(F.col("node").alias("early")), "early", "left_semi").join(open_.select(F.col("node").alias("late")), "late", "left_semi").select("early", "late"))
    raise RuntimeError(f"nodes are still open after {most_rounds} rounds")


def greedy_hashes(df: DataFrame, key: str, h: str, radius: int, kept: DataFrame | None = None) -> DataFrame:
    """`df` with `kept`: in the order of `key`, a row is kept if no kept hash lies within the radius.

    `kept` (with the hash column) holds hashes kept before. Rows without a hash are kept.
    """
    fresh = df.where(F.col(h).isNotNull()).groupBy(h).agg(F.min(key).alias("pos"))
    if kept is not None:
        fresh = unseen_hashes(fresh, kept, h, radius)
    fresh = cut_lineage(fresh)
    pairs = near_hashes(fresh, h, radius).select(F.col("a").alias("u"), F.col("b").alias("v"))
    chosen = first_come(fresh.select(F.col(h).alias("node"), "pos"), pairs).select(F.col("node").alias(h))
    firsts = fresh.join(chosen, h, "left_semi").select(F.col("pos").alias(key), F.lit(True).alias("__first"))
    return df.join(firsts, key, "left").withColumn("kept", F.col(h).isNull() | F.coalesce("__first", F.lit(False))).drop("__first")
