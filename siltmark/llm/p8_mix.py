"""Problem 8: mixing sources to target weights.

Tokens are summed by (source, hash bucket); the threshold under which a source's budget is spent is
found in the histogram and refined in its boundary bucket only, three times 12 bits of the hash. A
record is in the mix when its hash lies under the threshold of its source: a filter, no sort. Larger
budgets keep everything that smaller ones hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from siltmark.llm.tokens import source_key, token_count
from siltmark.session import cut_lineage, spread, table

BITS = 12
LEVELS = 3


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, key, tokens, draw): every document once; null texts have no tokens."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", source_key(F.col("source")).alias("key"), "text"))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(8)), 64 - BITS * LEVELS)
    return documents.select("doc_id", "key", token_count(spark)("text").alias("tokens"), draw.alias("draw"))


def budgets(spark: SparkSession, sf_dir: str, sized: DataFrame) -> DataFrame:
    """Per source of mix_targets: own tokens, tokens of all documents, wanted and reachable tokens."""
    own = sized.groupBy("key").agg(F.sum("tokens").alias("own"))
    total = own.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    targets = table(spark, sf_dir, "mix_targets").withColumn("key", source_key(F.col("source")))
    joined = targets.join(own, "key", "left").na.fill(0, ["own"]).crossJoin(F.broadcast(total))  # one row on the right
    return joined.withColumn("wanted", F.col("weight") * F.col("total")).withColumn("short", F.col("max_repeat") * F.col("own") < F.col("wanted"))


def _thresholds(spark: SparkSession, sized: DataFrame, parts: dict[str, float]) -> dict[str, int]:
    """For each key the draw under which its documents hold at most the given number of tokens."""
    at, left, width = dict.fromkeys(parts, 0), dict(parts), BITS * LEVELS
    open_keys = set(parts)
    for _ in range(LEVELS):
        width -= BITS
        bounds = spark.createDataFrame([(k, at[k]) for k in sorted(open_keys)], "key string, low long")
        inside = sized.join(F.broadcast(bounds), "key").where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("low") + (1 << (width + BITS))))
        bucket = F.shiftright(F.col("draw") - F.col("low"), width)
        # at most 2^12 rows per source of mix_targets, which has 13
        histogram = inside.groupBy("key", bucket.alias("bucket")).agg(F.sum("tokens").alias("n")).collect()
        for key in list(open_keys):
            edge = None
            for row in sorted((r for r in histogram if r.key == key), key=lambda r: r.bucket):
                if row.n > left[key]:
                    edge = row.bucket
                    break
                left[key] -= row.n
            if edge is None:  # the whole range fits
                at[key] += 1 << (width + BITS)
                open_keys.discard(key)
            else:
                at[key] += edge << width
        if not open_keys:
            break
    return at


def _plan(spark: SparkSession, sf_dir: str, sized: DataFrame) -> list[tuple[str, str, int, int]]:
    """(source, key, whole copies, threshold of the last part copy)."""
    rows = budgets(spark, sf_dir, sized).collect()  # mix_targets has 13 rows
    whole, part = {}, {}
    for r in rows:
        times = min(r.max_repeat, r.wanted / r.own) if r.own else 0
        whole[r.key] = int(times)
        part[r.key] = (times - int(times)) * r.own
    limits = _thresholds(spark, sized, {k: v for k, v in part.items() if v > 0})
    return [(r.source, r.key, whole[r.key], limits.get(r.key, 0)) for r in rows]


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mix and how often each is in it."""
    sized = cut_lineage(sized_documents(spark, sf_dir))
    return _mixed(spark, sf_dir, sized)


def _mixed(spark: SparkSession, sf_dir: str, sized: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL("source string, key string, whole int, threshold long")
    plan = spark.createDataFrame(_plan(spark, sf_dir, sized), schema)
    copies = F.col("whole") + (F.col("draw") < F.col("threshold")).cast("int")
    joined = sized.where("tokens > 0").join(F.broadcast(plan), "key").withColumn("copies", copies)
    return joined.where("copies > 0").select("doc_id", "source", "tokens", "copies")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of mix_targets: weight, actual share, own tokens, tokens in the mix, short."""
    sized = cut_lineage(sized_documents(spark, sf_dir))
    used = _mixed(spark, sf_dir, sized).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.max("copies").alias("most_copies"))
    total = used.agg(F.coalesce(F.sum("mixed"), F.lit(0)).alias("mix_total"))
    found = budgets(spark, sf_dir, sized).join(used, "source", "left").na.fill(0, ["mixed", "most_copies"]).crossJoin(F.broadcast(total))
    share = F.coalesce(F.try_divide(F.col("mixed"), F.col("mix_total")), F.lit(0.0))
    return found.select("source", "weight", F.round(share, 6).alias("share"), "own", "mixed", "most_copies", "max_repeat", "short")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents are all in the mix as often as allowed and still weigh too little."""
    sized = cut_lineage(sized_documents(spark, sf_dir))
    used = _mixed(spark, sf_dir, sized).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), F.min("copies").alias("least_copies"))
    found = budgets(spark, sf_dir, sized).join(used, "source", "left")
    spent = F.coalesce(F.col("least_copies") == F.col("max_repeat"), F.lit(True))
    return found.where(spent & (F.coalesce("mixed", F.lit(0)) < F.col("wanted"))).select("source")
