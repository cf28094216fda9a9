"""Running totals, ranks and quantiles over an order, without a task that sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.session import cut_lineage

#: Rows of a range that a window task orders.
RANGE_ROWS = 500_000


def running_totals(df: DataFrame, key: str, totals: list[str], by: list[str] | None = None, descending: bool = False, tie: str | None = None) -> DataFrame:
    """`df` (one row per `by`, `key` and `tie`) with `run_<c>`: the sum of c up to and including the row.

    Rows are written once, cut into ranges of about RANGE_ROWS in their order; sums of whole ranges come from a
    small table, sums within a range from a window over it. Rows that fit one range are one window. Null
    keys are dropped; NaN keys come last as the largest.
    """
    by = by or []
    direction = F.desc if descending else F.asc
    order = [direction(c) for c in (key, *([tie] if tie else []))]
    rows = cut_lineage(df.where(F.col(key).isNotNull()))
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = math.ceil(rows.count() / RANGE_ROWS)
    if ranges <= 1:
        return rows.withColumns({f"run_{c}": F.sum(c).over(upto) for c in totals})
    # what lies where is settled by writing it: ranges follow the order of `by` and the key
    placed = cut_lineage(rows.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id()))
    sums = placed.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__sum_{c}") for c in totals])
    ahead = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__range", *[F.coalesce(F.sum(f"__sum_{c}").over(ahead), F.lit(0)).alias(f"__before_{c}") for c in totals])
    joined = placed.join(before, [*by, "__range"])
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumns({f"run_{c}": F.col(f"__before_{c}") + F.sum(c).over(inside) for c in totals}).drop("__range", *[f"__before_{c}" for c in totals])


def ranks(df: DataFrame, key: str, by: list[str], tie: str) -> DataFrame:
    """`df` with `rank`, from 1 in the order of key and tie (both not null, together unique within `by`)."""
    return running_totals(df.withColumn("one", F.lit(1)), key, ["one"], by, tie=tie).withColumnRenamed("run_one", "rank").drop("one")


def quantiles(df: DataFrame, column: str, points: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., n, q): exact linear quantiles of the values that are not null, `q` in the order of `points`.

    Equal values are counted first; a value answers for the positions its copies take.
    """
    by = by or []
    values = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("k"))
    run = running_totals(values, "__v", ["k"], by)
    total = run.groupBy(*by).agg(F.max("run_k").alias("n"))
    joined = run.join(F.broadcast(total), by) if by else run.crossJoin(F.broadcast(total))  # one row per group of a report
    first, last = F.col("run_k") - F.col("k"), F.col("run_k") - 1
    parts = []
    for i, p in enumerate(points):
        at = F.lit(p) * (F.col("n") - 1)
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            parts.append(F.max(F.when((place >= first) & (place <= last), F.col("__v"))).alias(f"{name}{i}"))
    ends = joined.groupBy(*by, "n").agg(*parts)
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    q = [F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * part(p) for i, p in enumerate(points)]
    return ends.select(*by, "n", F.array(*q).alias("q"))


def pick_first(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The one row that comes first in the order of `keys`, found by a map-side minimum."""
    return df.orderBy(*keys).limit(1)
