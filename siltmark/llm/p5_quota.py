"""Problem 5: a sample that matches target shares per category and form factor.

Divisor method: the record of random rank r in a cell has priority (r - 0.5) / target; the records
within a cell's floor go first, then the smallest priorities of all cells. Cells that run out leave
their seats to the others. Ranks come from hash buckets: totals per (cell, bucket) plus a rank within
the bucket, so that no task sorts a whole cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siltmark.llm.names import clean_split
from siltmark.session import cut_lineage, table

#: Rows of the sample as a part of all available records.
FRACTION = 0.2
BUCKETS = 1024

# The closed taxonomy of categories.
CATEGORIES = ("clean", "black_bars", "disordered_layout", "empty_space", "overlay")


def clean_category(category: Column) -> Column:
    """Taxonomy name whatever the spelling; blank and null are clean; null for anything else."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("")))), r"[\s_-]+", "_")
    return F.when(name == "", "clean").when(name.isin(*CATEGORIES), name)


def clean_form_factor(form: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(form, F.lit(""))))
    return F.when(name == "", "unknown").when(name.startswith("unidentif"), "unidentified").otherwise(name)


def available_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, path, category, form_factor): train records of a known category, one per path.

    Of repeated paths the smallest such sample_id stays; rows without a path count as one path.
    """
    labels = table(spark, sf_dir, "labels").select(
        "sample_id", "path", clean_split(F.col("split"), F.col("path")).alias("split"), clean_category(F.col("category")).alias("category"), clean_form_factor(F.col("form_factor")).alias("form_factor")
    )
    kept = labels.where((F.col("split") == "train") & F.col("category").isNotNull())
    return kept.groupBy("path").agg(F.min_by(F.struct("sample_id", "category", "form_factor"), "sample_id").alias("r")).select("r.sample_id", "path", "r.category", "r.form_factor")


def cells(spark: SparkSession, sf_dir: str, available: DataFrame) -> DataFrame:
    """Every row of quota_targets with what is available, what it needs and the size of the sample."""
    counts = available.groupBy("category", "form_factor").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    targets = table(spark, sf_dir, "quota_targets")
    joined = targets.join(counts, ["category", "form_factor"], "left").na.fill(0, ["n"]).crossJoin(F.broadcast(total))  # one row on the right
    need = F.greatest(F.col("target_share") * FRACTION * F.col("total"), F.col("min_rows"))
    return joined.withColumn("need", need)


def _seats(rows: list, size: int) -> dict[tuple[str, str], int]:
    """Seats of each cell: floors, then the smallest (rank - 0.5) / target, ties by cell name."""
    floor = {(r.category, r.form_factor): min(r.n, r.min_rows) for r in rows}
    share = {(r.category, r.form_factor): r.target_share for r in rows}
    have = {(r.category, r.form_factor): r.n for r in rows}
    left = size - sum(floor.values())
    if left <= 0:
        return floor

    def taken(limit: float) -> dict:
        return {c: max(floor[c], min(have[c], int(limit * share[c] + 0.5))) for c in have}

    low, high = 0.0, 1.0
    while sum(taken(high).values()) < min(size, sum(have.values())) and high < 1e15:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(taken(middle).values()) <= size else (low, middle)
    got = taken(low)
    open_cells = sorted((c for c in have if got[c] < have[c] and share[c] > 0), key=lambda c: ((got[c] + 0.5) / share[c], c))
    for c in open_cells[: max(0, size - sum(got.values()))]:
        got[c] += 1
    return got


def p5_seats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Report of the cells (seats, shares, short) and the available records."""
    available = cut_lineage(available_records(spark, sf_dir))
    found = cells(spark, sf_dir, available)
    rows = found.collect()  # quota_targets has 19 rows at every scale
    size = int(round(FRACTION * rows[0].total)) if rows else 0
    seats = _seats(rows, size)
    picked = sum(seats.values()) or 1
    data = [(r.category, r.form_factor, r.n, float(r.need), seats[r.category, r.form_factor], seats[r.category, r.form_factor] / picked, r.target_share, r.n < r.need) for r in rows]
    return spark.createDataFrame(data, "category string, form_factor string, available long, need double, seats long, share double, target_share double, short boolean"), available


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, _ = p5_seats(spark, sf_dir)
    return report.withColumns({"need": F.round("need", 6), "share": F.round("share", 6)})


def ranked_records(report: DataFrame, available: DataFrame) -> DataFrame:
    """The available records of the cells of the report with their random rank in the cell, from 1."""
    draw = F.xxhash64("sample_id", F.lit(5))
    wanted = available.join(F.broadcast(report.select("category", "form_factor", "seats", "target_share")), ["category", "form_factor"])  # rows of quota_targets
    wanted = wanted.withColumn("draw", draw).withColumn("bucket", F.shiftrightunsigned("draw", 54))
    per_bucket = wanted.groupBy("category", "form_factor", "bucket").agg(F.count(F.lit(1)).alias("n"))  # at most 19 x BUCKETS rows
    running = Window.partitionBy("category", "form_factor").orderBy("bucket")
    before = per_bucket.withColumn("before", F.sum("n").over(running) - F.col("n")).drop("n")
    inside = Window.partitionBy("category", "form_factor", "bucket").orderBy("draw", "sample_id")
    return wanted.join(F.broadcast(before), ["category", "form_factor", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(inside))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled records with their random rank in the cell and their priority."""
    ranked = ranked_records(*p5_seats(spark, sf_dir))
    return ranked.where(F.col("rank") <= F.col("seats")).select("sample_id", "path", "category", "form_factor", "rank", F.round((F.col("rank") - 0.5) / F.col("target_share"), 6).alias("priority"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that gave all their records and stay below their target or their floor.

    The ranks of a cell end at its last record: where they end before the need, every seat is filled
    and the target is not met. Cells without records end at 0.
    """
    report, available = p5_seats(spark, sf_dir)
    ends = ranked_records(report, available).groupBy("category", "form_factor").agg(F.max("rank").alias("last"))
    reached = report.join(ends, ["category", "form_factor"], "left").na.fill(0, ["last"])
    return reached.where(F.col("last") < F.col("need")).select("category", "form_factor")
