"""Catalogue: sessions, near-duplicate groups, group-atomic splits and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siltmark.functions import taxonomy
from siltmark.operators import components, curate, splits
from siltmark.plans.curation import tidy
from siltmark.plans.registry import TIDY, query
from siltmark.session import cut_lineage, ensure_checkpoint_dir, spread, table
from siltmark.streaming import ingest

GAP = 21600
SHRINK = 32


@query("sessionize", f"WITH a AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events), b AS (SELECT *, sum(CASE WHEN d > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM a) SELECT user_id, CAST(session AS BIGINT) AS session, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1, 2")
def sessionize(spark, sf):
    found = components.sessionize(table(spark, sf, "events"), ["user_id"], "ts", "event_id", GAP)
    return found.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


@query("session_window", f"WITH a AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS d FROM events), b AS (SELECT *, sum(CASE WHEN d > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a) SELECT user_id, min(ts) AS first_ts, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY user_id, session")
def session_window(spark, sf):
    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy(F.session_window("ts", f"{GAP} seconds"), "user_id").agg(F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.count(F.lit(1)).alias("n")).select("user_id", "first_ts", "n")


def near_sql(radius: int) -> str:
    return f"h AS (SELECT DISTINCT phash FROM pool_manifest WHERE phash IS NOT NULL), e AS (SELECT x.phash AS a, y.phash AS b, CAST(bit_count(xor(x.phash, y.phash)) AS INTEGER) AS distance FROM h x JOIN h y ON x.phash < y.phash WHERE bit_count(xor(x.phash, y.phash)) <= {radius})"


@query("near_dup_pairs", f"WITH {near_sql(4)} SELECT * FROM e")
def near_dup_pairs(spark, sf):
    return components.near_hashes(table(spark, sf, "pool_manifest"), "phash", 4)


@query("near_dup_pairs_wide", f"WITH {near_sql(6)} SELECT * FROM e")
def near_dup_pairs_wide(spark, sf):
    return components.near_hashes(table(spark, sf, "pool_manifest"), "phash", 6)


@query("components", f"WITH RECURSIVE {near_sql(6)}, s AS (SELECT a AS u, b AS v FROM e UNION ALL SELECT b, a FROM e), r(node, near) AS (SELECT u, v FROM s UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.near) SELECT node, least(node, min(near)) AS label FROM r GROUP BY 1")
def connected(spark, sf):
    edges = cut_lineage(components.near_hashes(table(spark, sf, "pool_manifest"), "phash", 6).select(F.col("a").alias("u"), F.col("b").alias("v")))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return components.smallest_labels(nodes, edges)


@query("mother_image", f"WITH {TIDY}, a AS (SELECT sample_id, try_strptime(regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 1) || regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 2), '%Y%m%d%H%M%S') AS ts FROM t WHERE source = 'real' AND category = 'clean'), b AS (SELECT sample_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, sample_id)) AS d FROM a WHERE ts IS NOT NULL) SELECT sample_id, CAST(sum(CASE WHEN d > 300000000 THEN 1 ELSE 0 END) OVER (ORDER BY ts, sample_id) AS BIGINT) AS session FROM b")
def mother_image(spark, sf):
    """Sessions of clean captures over all devices, 300 seconds apart at most."""
    from siltmark.functions import names

    rows = tidy(spark, sf).where("source = 'real' AND category = 'clean'").select("sample_id", names.shot_time(F.col("name")).alias("ts"))
    return components.sessions_across_days(rows, "ts", "sample_id", 300).select("sample_id", "session")


@query("session_components", f"""WITH RECURSIVE {near_sql(4)}, o AS (SELECT pool_id, epoch_us(shot_ts) - epoch_us(lag(shot_ts) OVER (ORDER BY shot_ts, pool_id)) AS d, lag(pool_id) OVER (ORDER BY shot_ts, pool_id) AS before FROM pool_manifest WHERE shot_ts IS NOT NULL),
l AS (SELECT pool_id AS u, before AS v FROM o WHERE d <= 300000000 UNION SELECT x.pool_id, y.pool_id FROM pool_manifest x JOIN pool_manifest y ON x.phash = y.phash AND x.pool_id > y.pool_id UNION SELECT x.pool_id, y.pool_id FROM e JOIN pool_manifest x ON x.phash = e.a JOIN pool_manifest y ON y.phash = e.b),
s AS (SELECT u, v FROM l UNION SELECT v, u FROM l), r(node, near) AS (SELECT u, v FROM s UNION SELECT r.node, s.v FROM r JOIN s ON s.u = r.near), c AS (SELECT node, least(node, min(near)) AS component FROM r GROUP BY 1)
SELECT pool_id, coalesce(component, pool_id) AS component FROM pool_manifest LEFT JOIN c ON node = pool_id""")
def session_components(spark, sf):
    """Sessions of the pool joined with its near duplicates."""
    return components.capture_components(table(spark, sf, "pool_manifest"), "pool_id", "shot_ts", "phash", 300, 4)


@query("grouped_split")
def grouped_split(spark, sf):
    rows = tidy(spark, sf).where("source = 'real'")
    placed = splits.grouped_stratified_split(rows, "group", "category", "sample_id")
    return placed.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("n_groups"))


@query("grouped_kfold")
def grouped_kfold(spark, sf):
    return splits.grouped_kfold(tidy(spark, sf), "group", 5, 0).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("n_groups"))


@query("grouped_holdout")
def grouped_holdout(spark, sf):
    return splits.grouped_holdout(tidy(spark, sf), "group", 0.2, 1).groupBy("held").agg(F.count(F.lit(1)).alias("n"))


@query("label_permutation", f"WITH {TIDY}, h AS (SELECT form_factor, label, row_number() OVER (PARTITION BY form_factor ORDER BY sample_id) AS i FROM t), d AS (SELECT form_factor, label AS placebo, row_number() OVER (PARTITION BY form_factor ORDER BY md5('3:' || sample_id), sample_id) AS i FROM t) SELECT form_factor, CAST(sum(label) AS BIGINT) AS errors, CAST(sum(placebo) AS BIGINT) AS placebo_errors, CAST(count(*) FILTER (WHERE label <> placebo) AS BIGINT) AS moved FROM h JOIN d USING (form_factor, i) GROUP BY 1")
def label_permutation(spark, sf):
    dealt = splits.permuted_labels(tidy(spark, sf).select("sample_id", "form_factor", "label"), "form_factor", "label", "sample_id", 3)
    return dealt.groupBy("form_factor").agg(F.sum("label").alias("errors"), F.sum("placebo").alias("placebo_errors"), F.count_if(F.col("label") != F.col("placebo")).alias("moved"))


@query("holdout_fill", "WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, n, sum(n) OVER (ORDER BY md5(CAST(user_id AS VARCHAR)), user_id) - n AS before, (SELECT count(*) FROM events) * 0.2 AS target FROM g) SELECT user_id, CAST(n AS BIGINT) AS n FROM r WHERE before < target")
def holdout_fill(spark, sf):
    from siltmark.operators.ordered import running_totals

    sizes = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    keyed = sizes.withColumn("at", F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 12), 16, 10).cast("bigint"))
    run = running_totals(keyed, "at", ["n"], tie="user_id")
    total = sizes.agg((F.sum("n") * 0.2).alias("target"))
    return run.crossJoin(F.broadcast(total)).where(F.col("run_n") - F.col("n") < F.col("target")).select("user_id", "n")  # one row of total


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if sf_is_file(spark, sf, name) else "*.parquet").parquet(sf if sf_is_file(spark, sf, name) else f"{sf}/{name}.parquet")


def sf_is_file(spark: SparkSession, sf: str, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def _work(spark: SparkSession) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    import uuid

    return f"{ensure_checkpoint_dir(spark)}/streams/{uuid.uuid4()}"


@query("stream_sessions", f"WITH a AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS d FROM events), b AS (SELECT *, sum(CASE WHEN d > {GAP}000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM a), c AS (SELECT user_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY user_id, session) SELECT user_id, CAST(n AS BIGINT) AS n, first_ts, last_ts FROM c WHERE last_ts + INTERVAL {GAP} SECOND <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark, sf):
    """Sessions that the watermark has closed, from an append-mode stream over the landed file."""
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = ingest.run_available(ingest.sessions(events, "user_id", "ts", f"{GAP} seconds", "1 hour"), _work(spark))
    return out.select("user_id", "n", F.col("first_ts").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedup(spark, sf):
    """One row per user, event type and day, kept by a stream with watermarked state."""
    events = _stream(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return ingest.run_available(ingest.exact_dedup(events, ["user_id", "event_type", "day"], "ts", "40 days"), _work(spark)).select("user_id", "event_type", "day")


@query("stream_perceptual")
def stream_perceptual(spark, sf):
    """Greedy perceptual deduplication of the pool against all kept hashes."""
    rows = _stream(spark, sf, "pool_manifest").select(F.col("pool_id").alias("id"), "phash")
    return ingest.perceptual_dedup(rows, 6, _work(spark))


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Screens drawn from the sizes of the pool: there are no image files in the test tables.

    They keep their aspect ratio and are smaller than the pool's, by SHRINK at most and only as far as `least_side` allows;
    what is drawn takes the same part of a screen at any scale.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from siltmark.functions.imaging import encode_png
    from siltmark.functions.layouts import least_side

    least = least_side()

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = []
            for i, w, h in zip(batch.pool_id, batch.w, batch.h):
                rng = np.random.default_rng(int(i))
                by = max(1, min(SHRINK, min(w, h) / least))
                image = np.full((max(least, int(h / by)), max(least, int(w / by)), 3), rng.integers(60, 230, 3), np.uint8)
                tall, wide = (int(n * min(image.shape[:2]) / max(24, min(w, h) // SHRINK)) for n in (9, 15))
                for _ in range(12):
                    y, x = int(rng.integers(0, image.shape[0])), int(rng.integers(0, image.shape[1]))
                    image[y : y + tall, x : x + wide] = rng.integers(0, 255, 3)
                drawn.append((f"pool/{i}.png", encode_png(image)))
            yield pd.DataFrame(drawn, columns=["path", "content"])

    rows = spread(table(spark, sf, "pool_manifest").where("w > 0 AND h > 0").select("pool_id", "w", "h"))
    return rows.mapInPandas(draw, "path string, content binary")


@query("image_hashes")
def image_hashes(spark, sf):
    from siltmark.functions.imaging import hash_images

    return hash_images(_drawn(spark, sf))


@query("image_variants")
def image_variants(spark, sf):
    """Number of different sizes and hashes of every injected and reflowed variant."""
    from siltmark.functions import imaging, layouts

    made = layouts.make_variants(_drawn(spark, sf), layouts.OPERATORS)
    hashed = imaging.hash_images(made.select(F.concat_ws("__", "parent", "applied").alias("path"), "content"))
    return hashed.groupBy(F.element_at(F.split("path", "__"), -1).alias("applied")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("w", "h").alias("n_sizes"), F.countDistinct("phash").alias("n_hashes"))


@query("image_regions")
def image_regions(spark, sf):
    """Dead regions found in screens with an injected black strip, by kind and sides."""
    from siltmark.functions import layouts, regions

    made = layouts.make_variants(_drawn(spark, sf), ("black_region",)).select(F.col("parent").alias("path"), "content")
    return regions.find_regions(made).groupBy("kind", "is_band").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 4).alias("score"))


@query("rebuild_dataset")
def rebuild_dataset(spark, sf):
    """Rows and groups of each split and category after the whole rebuild."""
    from siltmark import pipeline
    from siltmark.config import Config

    rows = pipeline.rebuild(table(spark, sf, "labels"), Config())
    return rows.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("n_groups"), F.sum("copies").alias("copies"))


@query("rebuild_leaks", "SELECT CAST(0 AS BIGINT) AS n_leaks")
def rebuild_leaks(spark, sf):
    """Groups, whatever their spelling, that the rebuilt splits divide: none."""
    from siltmark import pipeline
    from siltmark.config import Config

    rows = pipeline.rebuild(table(spark, sf, "labels"), Config())
    return curate.leaks(rows.withColumn("group", taxonomy.clean_group(F.col("group"))), "group", "split").agg(F.count(F.lit(1)).alias("n_leaks"))


@query("weighted_sample")
def weighted_sample(spark, sf):
    from siltmark.operators.localize import weighted_sample as draw

    return draw(table(spark, sf, "events").select("event_id", "value"), "value", "event_id", 50).select("event_id")


@query("merge_pool")
def merge_pool(spark, sf):
    """Rows and groups by origin and split after the pool has joined the rebuilt dataset."""
    from siltmark import pipeline
    from siltmark.config import Config

    merged = pipeline.merge_pool(pipeline.rebuild(table(spark, sf, "labels"), Config()), table(spark, sf, "pool_manifest"), Config())
    return merged.groupBy("origin", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("n_groups"))


@query("unseen_hashes", "WITH a AS (SELECT DISTINCT phash FROM pool_manifest WHERE batch_no < 3) SELECT pool_id FROM pool_manifest p WHERE batch_no >= 3 AND (phash IS NULL OR NOT EXISTS (SELECT 1 FROM a WHERE bit_count(xor(a.phash, p.phash)) <= 6))")
def unseen_hashes(spark, sf):
    rows = table(spark, sf, "pool_manifest").select("pool_id", "batch_no", "phash")
    return components.unseen_hashes(rows.where("batch_no >= 3"), rows.where("batch_no < 3"), "phash", 6).select("pool_id")
