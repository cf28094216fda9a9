"""Catalogue: projections, filters, joins and aggregates on the manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from siltmark.functions import names, taxonomy, vectors
from siltmark.operators import curate
from siltmark.operators.ordered import quantiles
from siltmark.plans.registry import FOLD, STEM, SUFFIX, TICKET, TIDY, query
from siltmark.session import table


def tidy(spark: SparkSession, sf: str) -> DataFrame:
    return curate.tidy_labels(table(spark, sf, "labels")).withColumn("name", names.base_name(F.col("path")))


def pool(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pool_manifest").withColumns({"name": names.base_name(F.col("path")), "group": taxonomy.clean_group(F.col("group"))})


POOL = "p AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM pool_manifest)"


@query("scan_filter_clean", f"WITH {TIDY} SELECT sample_id, path FROM t WHERE split = 'train' AND source = 'real' AND category = 'clean'")
def scan_filter_clean(spark, sf):
    return tidy(spark, sf).where("split = 'train' AND source = 'real' AND category = 'clean'").select("sample_id", "path")


@query("name_metadata", f"""WITH {TIDY}, a AS (SELECT sample_id, lower(name) AS n, regexp_extract(lower(name), '(unfold|fold|laptop|tent|desktop|unidentif[a-z0-9_]*)', 1) AS f,
 regexp_extract(lower(name), '(portrait|portrair|landscape)', 1) AS o, regexp_extract(lower(name), '(screenshot|screeshot|photo)', 1) AS k FROM t)
SELECT sample_id, CASE WHEN f = '' THEN 'unknown' WHEN f LIKE 'unidentif%' THEN 'unidentified' ELSE f END AS name_form, CASE WHEN o = '' THEN 'unknown' WHEN o = 'portrair' THEN 'portrait' ELSE o END AS name_orientation,
 CASE WHEN k = 'photo' THEN 'photo' ELSE 'screenshot' END AS name_kind, contains(n, 'competitor') AS name_competitor, contains(n, 'boundbox') OR contains(n, 'bound_box') AS name_boundbox FROM a""")
def name_metadata(spark, sf):
    return curate.name_metadata(tidy(spark, sf), F.col("name")).select("sample_id", "name_form", "name_orientation", "name_kind", "name_competitor", "name_boundbox")


@query("group_key", f"WITH {TIDY} SELECT sample_id, coalesce({TICKET.format('name')}, source || ':' || {STEM.format('name')}) AS group_key FROM t")
def group_key(spark, sf):
    return tidy(spark, sf).select("sample_id", names.group_key(F.col("name"), F.col("source")).alias("group_key"))


@query("ticket_or_session", f"""WITH {TIDY} SELECT sample_id, coalesce({TICKET.format('name')}, 'shot:' || nullif(regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 1) || regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 2), ''), 'file:' || {STEM.format('name')}) AS key FROM t""")
def ticket_or_session(spark, sf):
    return tidy(spark, sf).select("sample_id", names.ticket_or_session(F.col("name")).alias("key"))


@query("shot_time", f"""WITH {TIDY}, a AS (SELECT sample_id, regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 1) || regexp_extract(name, '([0-9]{{8}})[_-]([0-9]{{6}})', 2) AS x FROM t)
SELECT sample_id, try_strptime(x, '%Y%m%d%H%M%S') AS shot FROM a WHERE x <> ''""")
def shot_time(spark, sf):
    return tidy(spark, sf).where(names.shot_stamp(F.col("name")).isNotNull()).select("sample_id", names.shot_time(F.col("name")).cast("timestamp_ntz").alias("shot"))


ONE_EXT = r"regexp_replace(name, '\.(png|jpe?g)(\.(png|jpe?g))+$', '.\1', 'i')"


@query("name_normalize", f"WITH {TIDY}, a AS (SELECT sample_id, {ONE_EXT} AS n FROM t) SELECT sample_id, trim(regexp_replace({STEM.format('n')}, '\\s*\\([0-9]+\\)\\s*$', '')) || {SUFFIX.format('n')} AS name FROM a")
def name_normalize(spark, sf):
    return tidy(spark, sf).select("sample_id", names.normalize_name(F.col("name")).alias("name"))


@query("slug", "SELECT DISTINCT source, CASE WHEN trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'x' ELSE trim(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '-') END AS slug FROM documents WHERE source IS NOT NULL")
def slug(spark, sf):
    return table(spark, sf, "documents").where("source IS NOT NULL").select("source").distinct().withColumn("slug", names.slug(F.col("source")))


@query("app_key", f"WITH {TIDY} SELECT split_part(name, '_', 1) AS app, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def app_key(spark, sf):
    return tidy(spark, sf).groupBy(names.app_key(F.col("name")).alias("app")).agg(F.count(F.lit(1)).alias("n"))


SYNTH = f"regexp_extract({STEM.format('name')}, '^(.*)__([a-z_+]+)__v([0-9]+)$', {{0}})"


@query("synthetic_lineage", f"WITH {TIDY} SELECT sample_id, nullif({SYNTH.format(1)}, '') AS parent, nullif({SYNTH.format(2)}, '') AS operators FROM t WHERE source = 'synthetic'")
def synthetic_lineage(spark, sf):
    return tidy(spark, sf).where("source = 'synthetic'").select("sample_id", names.synthetic_parent(F.col("name")).alias("parent"), names.synthetic_operators(F.col("name")).alias("operators"))


COARSE = "CASE category WHEN 'clean' THEN 'clean' WHEN 'black_bars' THEN 'dead_region' WHEN 'empty_space' THEN 'dead_region' WHEN 'overlay' THEN 'displaced_content' WHEN 'disordered_layout' THEN 'displaced_content' END"
CATEGORY_ID = "CASE category WHEN 'clean' THEN 0 WHEN 'black_bars' THEN 1 WHEN 'disordered_layout' THEN 2 WHEN 'empty_space' THEN 3 WHEN 'overlay' THEN 4 ELSE -1 END"


@query("coarse_map", f"WITH {TIDY} SELECT category, {COARSE} AS coarse, {CATEGORY_ID} AS id, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1, 2, 3")
def coarse_map(spark, sf):
    return tidy(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", taxonomy.coarse_of(F.col("category")).alias("coarse"), taxonomy.category_id(F.col("category")).alias("id"), "n")


@query("one_hot", f"WITH {TIDY} SELECT sample_id, " + ", ".join(f"CAST(kind = '{k}' AS INTEGER) AS kind_{k}" for k in ("photo", "screenshot", "synthetic")) + " FROM t")
def one_hot(spark, sf):
    return tidy(spark, sf).select("sample_id", *[(F.col("kind") == k).cast("int").alias(f"kind_{k}") for k in ("photo", "screenshot", "synthetic")])


@query("numeric_confound", "SELECT pool_id, w, h, round(w / CAST(greatest(h, 1) AS DOUBLE), 6) AS aspect, round(greatest(w, h) / CAST(518 AS DOUBLE), 6) AS scale FROM pool_manifest")
def numeric_confound(spark, sf):
    w, h = F.col("w").cast("double"), F.col("h")
    return pool(spark, sf).select("pool_id", "w", "h", F.round(w / F.greatest(h, F.lit(1)), 6).alias("aspect"), F.round(F.greatest("w", "h") / F.lit(518.0), 6).alias("scale"))


@query("pad_fraction", "SELECT pool_id, round(1 - (CAST(w AS DOUBLE) * h) / (CAST(greatest(w, h) AS DOUBLE) * greatest(w, h)), 6) AS pad FROM pool_manifest WHERE w > 0 AND h > 0")
def pad_fraction(spark, sf):
    return pool(spark, sf).where("w > 0 AND h > 0").select("pool_id", F.round(vectors.pad_fraction(F.col("w"), F.col("h")), 6).alias("pad"))


@query("content_patches", """WITH p AS (SELECT DISTINCT w, h, CAST(greatest(w, h) AS DOUBLE) AS s FROM pool_manifest WHERE w > 0 AND h > 0), g AS (SELECT unnest(range(0, 37)) AS i)
SELECT w, h, CAST(count(*) AS BIGINT) AS n FROM p, g AS a, g AS b WHERE w = h OR ((a.i + 0.5) * 14 BETWEEN (518 - 518 * h / s) / 2 AND (518 - 518 * h / s) / 2 + 518 * h / s AND (b.i + 0.5) * 14 BETWEEN (518 - 518 * w / s) / 2 AND (518 - 518 * w / s) / 2 + 518 * w / s) GROUP BY 1, 2""")
def content_patches(spark, sf):
    sizes = pool(spark, sf).where("w > 0 AND h > 0").select("w", "h").distinct()
    return sizes.select("w", "h", F.size(F.filter(vectors.content_mask(F.col("w"), F.col("h")), lambda b: b)).cast("long").alias("n"))


@query("aspect_bucket", "SELECT CASE WHEN aspect < 0.5 THEN '<0.5' WHEN aspect < 0.8 THEN '0.5-0.8' WHEN aspect < 1.1 THEN '0.8-1.1' WHEN aspect < 1.5 THEN '1.1-1.5' WHEN aspect >= 1.5 THEN '>1.5' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM pool_manifest GROUP BY 1")
def aspect_bucket(spark, sf):
    return pool(spark, sf).groupBy(curate.aspect_bucket(F.col("aspect")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("controlled_subset", f"WITH {TIDY} SELECT label, CAST(count(*) AS BIGINT) AS n FROM t WHERE label = 0 OR (label = 1 AND form_factor = 'unfold' AND orientation = 'portrait' AND kind = 'screenshot') GROUP BY 1")
def controlled_subset(spark, sf):
    kept = tidy(spark, sf).where(curate.controlled(F.col("form_factor"), F.col("orientation"), F.col("kind"), F.col("label")))
    return kept.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("near_square_slice", "SELECT pool_id, aspect FROM pool_manifest WHERE aspect BETWEEN 0.85 AND 1.18")
def near_square_slice(spark, sf):
    return pool(spark, sf).where(curate.near_square(F.col("aspect"))).select("pool_id", "aspect")


@query("size_filter", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM pool_manifest WHERE least(w, h) >= 1200 AND aspect BETWEEN 0.4 AND 2.2 GROUP BY 1")
def size_filter(spark, sf):
    return pool(spark, sf).where((F.least("w", "h") >= 1200) & F.col("aspect").between(0.4, 2.2)).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("tiny_or_unread", "SELECT source, CAST(count(*) FILTER (WHERE w = -1 OR h = -1) AS BIGINT) AS unread, CAST(count(*) FILTER (WHERE w >= 0 AND least(w, h) < 64) AS BIGINT) AS tiny FROM pool_manifest GROUP BY 1")
def tiny_or_unread(spark, sf):
    return pool(spark, sf).groupBy("source").agg(F.count_if((F.col("w") == -1) | (F.col("h") == -1)).alias("unread"), F.count_if((F.col("w") >= 0) & (F.least("w", "h") < 64)).alias("tiny"))


@query("name_anomalies", f"""WITH {TIDY} SELECT split, CAST(count(*) FILTER (WHERE regexp_matches(name, '(?i)\\.(png|jpe?g)\\.(png|jpe?g)$')) AS BIGINT) AS double_ext, CAST(count(*) FILTER (WHERE contains(name, ' ')) AS BIGINT) AS spaces,
 CAST(count(*) FILTER (WHERE regexp_matches(name, '[^\\x00-\\x7F]')) AS BIGINT) AS non_ascii, CAST(count(*) FILTER (WHERE regexp_matches(name, 'bound[bB]ox')) AS BIGINT) AS boundbox, CAST(count(*) FILTER (WHERE contains(lower(name), 'competitor')) AS BIGINT) AS competitor FROM t GROUP BY 1""")
def name_anomalies(spark, sf):
    n = F.col("name")
    return tidy(spark, sf).groupBy("split").agg(
        F.count_if(n.rlike(names.DOUBLE_EXTENSION)).alias("double_ext"), F.count_if(n.contains(" ")).alias("spaces"), F.count_if(n.rlike(r"[^\x00-\x7F]")).alias("non_ascii"),
        F.count_if(n.rlike("bound[bB]ox")).alias("boundbox"), F.count_if(F.lower(n).contains("competitor")).alias("competitor"))


MAJORITY = """cnt AS (SELECT {key} AS key, category, count(*) AS n, min(sample_id) AS f FROM {src} WHERE {key} IS NOT NULL GROUP BY 1, 2),
maj AS (SELECT key, category AS majority, n AS votes FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, f) AS r FROM cnt) WHERE r = 1)"""


@query("label_recovery", f"""WITH {TIDY}, {POOL}, real AS (SELECT *, {TICKET.format('name')} AS ticket FROM t WHERE source = 'real'), {MAJORITY.format(key='ticket', src='real')},
byname AS (SELECT name, arg_min(category, sample_id) AS named FROM real GROUP BY 1)
SELECT pool_id, coalesce(named, majority) AS recovered, CASE WHEN named IS NOT NULL THEN 'name' WHEN majority IS NOT NULL THEN 'ticket' ELSE 'none' END AS label_src
FROM p LEFT JOIN byname USING (name) LEFT JOIN maj ON maj.key = {TICKET.format('p.name')}""")
def label_recovery(spark, sf):
    real = tidy(spark, sf).where("source = 'real'").withColumn("ticket", names.ticket(F.col("name")))
    by_name = real.groupBy("name").agg(F.min_by("category", "sample_id").alias("named"))
    by_ticket = curate.majority(real, "ticket", "category", "sample_id").select("ticket", "majority")
    rows = pool(spark, sf).withColumn("ticket", names.ticket(F.col("name")))
    return curate.recover_labels(rows, by_name, by_ticket).select("pool_id", "recovered", "label_src")


@query("label_coverage", f"""WITH {TIDY}, {POOL}, real AS (SELECT *, {TICKET.format('name')} AS ticket FROM t WHERE source = 'real'), tick AS (SELECT DISTINCT ticket FROM real WHERE ticket IS NOT NULL), nm AS (SELECT DISTINCT name FROM real)
SELECT source, CASE WHEN nm.name IS NOT NULL THEN 'name' WHEN tick.ticket IS NOT NULL THEN 'ticket' ELSE 'none' END AS label_src, CAST(count(*) AS BIGINT) AS n FROM p LEFT JOIN nm ON nm.name = p.name LEFT JOIN tick ON tick.ticket = {TICKET.format('p.name')} GROUP BY 1, 2""")
def label_coverage(spark, sf):
    return label_recovery(spark, sf).join(pool(spark, sf).select("pool_id", "source"), "pool_id").groupBy("source", "label_src").agg(F.count(F.lit(1)).alias("n"))


@query("orphan_default_join", f"""WITH {TIDY}, parents AS (SELECT {STEM.format('name')} AS parent, min(grp) AS pg FROM t WHERE source = 'real' GROUP BY 1), m AS (SELECT sample_id, parent FROM export_manifest WHERE source = 'synthetic')
SELECT sample_id, coalesce(pg, 'synthorphan:' || CAST(sample_id AS VARCHAR)) AS grp FROM m LEFT JOIN parents USING (parent)""")
def orphan_default_join(spark, sf):
    parents = tidy(spark, sf).where("source = 'real'").groupBy(names.stem(F.col("name")).alias("parent")).agg(F.min("group").alias("pg"))
    rows = table(spark, sf, "export_manifest").where("source = 'synthetic'").select("sample_id", "parent")
    return rows.join(parents, "parent", "left").select("sample_id", F.coalesce("pg", F.concat(F.lit("synthorphan:"), F.col("sample_id").cast("string"))).alias("grp"))


@query("slice_semi", f"WITH {TIDY} SELECT sample_id, split FROM t WHERE path IN (SELECT path FROM emb_cache WHERE path IS NOT NULL)")
def slice_semi(spark, sf):
    return tidy(spark, sf).join(table(spark, sf, "emb_cache").select("path"), "path", "left_semi").select("sample_id", "split")


@query("manifest_anti", """SELECT DISTINCT sample_id, 'manifest' AS only_in FROM export_manifest WHERE sample_id NOT IN (SELECT sample_id FROM labels WHERE source = 'synthetic')
UNION ALL SELECT DISTINCT sample_id, 'files' FROM labels WHERE source = 'synthetic' AND sample_id NOT IN (SELECT sample_id FROM export_manifest)""")
def manifest_anti(spark, sf):
    from siltmark.sources.readers import reconcile

    return reconcile(table(spark, sf, "export_manifest"), table(spark, sf, "labels").where("source = 'synthetic'"), "sample_id")


@query("parent_leak_semi", f"WITH {TIDY}, held AS (SELECT DISTINCT {STEM.format('name')} AS parent FROM t WHERE source = 'real' AND split IN ('val', 'test')) SELECT sample_id FROM t WHERE source = 'synthetic' AND split = 'train' AND {SYNTH.format(1)} IN (SELECT parent FROM held)")
def parent_leak_semi(spark, sf):
    rows = tidy(spark, sf)
    held = rows.where("source = 'real' AND split IN ('val', 'test')").select(names.stem(F.col("name")).alias("parent"))
    train = rows.where("source = 'synthetic' AND split = 'train'").withColumn("parent", names.synthetic_parent(F.col("name")))
    return train.join(held, "parent", "left_semi").select("sample_id")


@query("class_full_outer", f"""WITH {TIDY}, a AS (SELECT category, count(*) AS n FROM t WHERE split = 'test' GROUP BY 1), b AS (SELECT category, count(*) AS n FROM export_manifest GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, CAST(coalesce(a.n, 0) AS BIGINT) AS in_labels, CAST(coalesce(b.n, 0) AS BIGINT) AS in_export FROM a FULL OUTER JOIN b ON a.category = b.category""")
def class_full_outer(spark, sf):
    a = tidy(spark, sf).where("split = 'test'").groupBy("category").agg(F.count(F.lit(1)).alias("in_labels"))
    b = table(spark, sf, "export_manifest").groupBy("category").agg(F.count(F.lit(1)).alias("in_export"))
    return a.join(b, "category", "full_outer").na.fill(0, ["in_labels", "in_export"])


@query("param_cross", "SELECT loss, k, lr FROM (VALUES ('supcon'), ('triplet')) a(loss), (VALUES (1), (5)) b(k), (VALUES (0.001::DOUBLE), (0.01::DOUBLE)) c(lr)")
def param_cross(spark, sf):
    from itertools import product

    return spark.createDataFrame(list(product(("supcon", "triplet"), (1, 5), (0.001, 0.01))), "loss string, k int, lr double")


@query("split_label_counts", f"WITH {TIDY} SELECT label, " + ", ".join(f"CAST(count(*) FILTER (WHERE split = '{s}') AS BIGINT) AS {s}" for s in taxonomy.SPLITS) + " FROM t GROUP BY 1")
def split_label_counts(spark, sf):
    return tidy(spark, sf).groupBy("label").agg(*[F.count_if(F.col("split") == s).alias(s) for s in taxonomy.SPLITS])


@query("confound_crosstab", f"WITH {TIDY} " + " UNION ALL ".join(f"SELECT '{a}' AS attribute, coalesce({a}, '') AS value, label, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 2, 3" for a in ("kind", "form_factor", "orientation", "category")))
def confound_crosstab(spark, sf):
    return curate.crosstab(tidy(spark, sf), "label", ["kind", "form_factor", "orientation", "category"])


@query("resolution_top5", "SELECT source, w, h, n FROM (SELECT source, w, h, CAST(count(*) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, w, h) AS r FROM pool_manifest GROUP BY 1, 2, 3) WHERE r <= 5")
def resolution_top5(spark, sf):
    counted = pool(spark, sf).groupBy("source", "w", "h").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w", "h"))).where("r <= 5").drop("r")


@query("exact_dup_sets", f"WITH {TIDY} SELECT name, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT split) AS BIGINT) AS n_splits, count(DISTINCT split) > 1 AS crosses FROM t GROUP BY 1 HAVING count(*) > 1")
def exact_dup_sets(spark, sf):
    return curate.duplicate_sets(tidy(spark, sf), "name", "split")


@query("dup_representative", f"""WITH {POOL} SELECT phash, pool_id, name, n FROM (SELECT phash, pool_id, name, CAST(count(*) OVER (PARTITION BY phash) AS BIGINT) AS n,
 row_number() OVER (PARTITION BY phash ORDER BY CAST(regexp_matches(name, '(?i)\\.(png|jpe?g)\\.(png|jpe?g)$') AS INTEGER), CAST(regexp_matches(name, '\\([0-9]+\\)') AS INTEGER), length(name), name, pool_id) AS r FROM p) WHERE r = 1""")
def dup_representative(spark, sf):
    return curate.representatives(pool(spark, sf), "phash", F.col("name"), ["pool_id", "name"])


@query("majority_category", f"WITH {TIDY}, {MAJORITY.format(key='grp', src='t')} SELECT key AS grp, majority, CAST(votes AS BIGINT) AS votes FROM maj")
def majority_category(spark, sf):
    return curate.majority(tidy(spark, sf), "group", "category", "sample_id").withColumnRenamed("group", "grp")


@query("leak_check", f"WITH {TIDY} SELECT grp, CAST(count(DISTINCT split) AS BIGINT) AS n_splits, CAST(count(*) AS BIGINT) AS n FROM t WHERE grp IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def leak_check(spark, sf):
    return curate.leaks(tidy(spark, sf), "group", "split").withColumnRenamed("group", "grp")


@query("category_coverage", f"WITH {TIDY}, s AS (SELECT * FROM (VALUES (1, 'train'), (2, 'val'), (3, 'test')) x(i, sp)), c AS (SELECT DISTINCT category FROM t) SELECT category, coalesce(string_agg(sp, ',' ORDER BY i) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.category = c.category AND t.split = s.sp)), '') AS missing FROM c, s GROUP BY 1")
def category_coverage(spark, sf):
    return curate.missing_splits(tidy(spark, sf), "category", "split")


@query("balance_rollup", f"WITH {TIDY} SELECT coalesce(split, 'all') AS split, coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY ROLLUP (split, category)")
def balance_rollup(spark, sf):
    return tidy(spark, sf).rollup("split", "category").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("category", F.lit("all")).alias("category"), "n")


@query("balance_cube", f"WITH {TIDY} SELECT coalesce(source, 'all') AS source, coalesce(category, 'all') AS category, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY CUBE (source, category)")
def balance_cube(spark, sf):
    return tidy(spark, sf).cube("source", "category").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("category", F.lit("all")).alias("category"), "n")


@query("inventory", f"WITH {TIDY} SELECT coalesce(split, 'all') AS split, coalesce(source, 'all') AS source, coalesce(ext, 'all') AS ext, CAST(count(*) AS BIGINT) AS n FROM (SELECT split, source, {SUFFIX.format('name')} AS ext FROM t) GROUP BY ROLLUP (split, source, ext)")
def inventory(spark, sf):
    rows = tidy(spark, sf).withColumn("ext", names.suffix(F.col("name")))
    return rows.rollup("split", "source", "ext").agg(F.count(F.lit(1)).alias("n")).select(*[F.coalesce(c, F.lit("all")).alias(c) for c in ("split", "source", "ext")], "n")


@query("numeric_profile", "SELECT source, min(w) AS min_w, median(w) AS med_w, max(w) AS max_w, min(h) AS min_h, median(h) AS med_h, max(h) AS max_h, round(median(aspect), 6) AS med_aspect FROM pool_manifest WHERE w > 0 GROUP BY 1")
def numeric_profile(spark, sf):
    rows = pool(spark, sf).where("w > 0")
    out = rows.groupBy("source").agg(F.min("w").alias("min_w"), F.max("w").alias("max_w"), F.min("h").alias("min_h"), F.max("h").alias("max_h"))
    for column in ("w", "h", "aspect"):
        out = out.join(quantiles(rows, column, [0.5], ["source"]).select("source", F.col("q")[0].alias(f"med_{column}")), "source", "left")
    return out.withColumn("med_aspect", F.round("med_aspect", 6))


@query("pool_audit", f"""WITH p AS (SELECT source, device, form_factor, {FOLD.format('"group"')} AS grp FROM pool_manifest), g AS (SELECT source, grp, count(DISTINCT form_factor) AS postures FROM p GROUP BY 1, 2)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT grp) AS BIGINT) AS n_groups, CAST(count(DISTINCT device) AS BIGINT) AS n_devices, CAST((SELECT count(*) FROM g WHERE g.source = p.source AND postures > 1 AND grp IS NOT NULL) AS BIGINT) AS multi_posture FROM p GROUP BY 1""")
def pool_audit(spark, sf):
    rows = pool(spark, sf)
    per = rows.where(F.col("group").isNotNull()).groupBy("source", "group").agg(F.countDistinct("form_factor").alias("postures")).groupBy("source").agg(F.count_if(F.col("postures") > 1).alias("multi_posture"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("n_groups"), F.countDistinct("device").alias("n_devices")).join(per, "source", "left").na.fill(0, ["multi_posture"])


@query("capture_todo", f"""WITH p AS (SELECT form_factor, orientation, {FOLD.format('"group"')} AS grp FROM pool_manifest) SELECT app, screen, form_factor, orientation FROM capture_plan c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.grp = {FOLD.format("'fold:' || c.app || ':' || c.screen")} AND p.form_factor = c.form_factor AND p.orientation = c.orientation)""")
def capture_todo(spark, sf):
    done = pool(spark, sf).select("group", "form_factor", "orientation")
    plan = table(spark, sf, "capture_plan").withColumn("group", taxonomy.clean_group(F.concat(F.lit("fold:"), "app", F.lit(":"), "screen")))
    return plan.join(done, ["group", "form_factor", "orientation"], "left_anti").select("app", "screen", "form_factor", "orientation")


@query("operator_breakdown", "SELECT op, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT split) AS BIGINT) AS n_splits FROM (SELECT split, unnest(string_split(tipos_erro, '+')) AS op FROM export_manifest WHERE tipos_erro IS NOT NULL) GROUP BY 1")
def operator_breakdown(spark, sf):
    rows = table(spark, sf, "export_manifest").where("tipos_erro IS NOT NULL").select("split", F.explode(F.split("tipos_erro", r"\+")).alias("op"))
    return rows.groupBy("op").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split").alias("n_splits"))


@query("unique_names", f"""WITH {TIDY}, a AS (SELECT sample_id, name, row_number() OVER (PARTITION BY category, name ORDER BY sample_id) - 1 AS i FROM t WHERE source = 'real')
SELECT sample_id, CASE WHEN i = 0 THEN name ELSE {STEM.format('name')} || '_' || CAST(i AS VARCHAR) || regexp_extract(name, '.(\\.[^.]*)$', 1) END AS unique_name FROM a""")
def unique_names(spark, sf):
    return curate.unique_names(tidy(spark, sf).where("source = 'real'").select("sample_id", "category", "name"), "category", F.col("name"), "sample_id").select("sample_id", "unique_name")


@query("variants", "SELECT vec_id AS parent, 'v' || CAST(i AS VARCHAR) AS variant FROM emb_cache, (SELECT unnest(range(0, 4)) AS i) WHERE label = 0 AND source = 'real'")
def variants(spark, sf):
    rows = table(spark, sf, "emb_cache").where("label = 0 AND source = 'real'")
    return rows.select(F.col("vec_id").alias("parent"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select("parent", F.concat(F.lit("v"), F.col("i").cast("string")).alias("variant"))


@query("source_limit", "SELECT source, pool_id FROM (SELECT source, pool_id, row_number() OVER (PARTITION BY source ORDER BY pool_id) AS r FROM pool_manifest) WHERE r <= 20")
def source_limit(spark, sf):
    return pool(spark, sf).select("source", "pool_id").withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("pool_id"))).where("r <= 20").drop("r")


@query("largest_dup_sets", f"WITH {TIDY} SELECT name, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, name LIMIT 25")
def largest_dup_sets(spark, sf):
    return curate.duplicate_sets(tidy(spark, sf), "name", "split").select("name", "n").orderBy(F.desc("n"), "name").limit(25)


@query("training_union", f"WITH {TIDY} SELECT src, label, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'real' AS src, label FROM t WHERE source = 'real' AND split = 'train' UNION ALL SELECT 'synth', label FROM t WHERE source = 'synthetic' AND split = 'train' UNION ALL SELECT 'reflow', 0 FROM pool_manifest WHERE w > 0) GROUP BY 1, 2")
def training_union(spark, sf):
    rows = tidy(spark, sf).where("split = 'train'")
    real = rows.where("source = 'real'").select(F.lit("real").alias("src"), "label")
    synth = rows.where("source = 'synthetic'").select(F.lit("synth").alias("src"), "label")
    reflow = pool(spark, sf).where("w > 0").select(F.lit("reflow").alias("src"), F.lit(0).alias("label"))
    return real.unionByName(synth).unionByName(reflow).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))


@query("calibration_union", f"WITH {TIDY} SELECT y, src, CAST(count(*) AS BIGINT) AS n FROM (SELECT 0 AS y, 'val_clean' AS src FROM t WHERE split = 'val' AND source = 'real' AND category = 'clean' UNION ALL SELECT 1, 'val_synth' FROM t WHERE split = 'val' AND source = 'synthetic') GROUP BY 1, 2")
def calibration_union(spark, sf):
    rows = tidy(spark, sf).where("split = 'val'")
    clean = rows.where("source = 'real' AND category = 'clean'").select(F.lit(0).alias("y"), F.lit("val_clean").alias("src"))
    synth = rows.where("source = 'synthetic'").select(F.lit(1).alias("y"), F.lit("val_synth").alias("src"))
    return clean.unionByName(synth).groupBy("y", "src").agg(F.count(F.lit(1)).alias("n"))


@query("disjoint_check", f"WITH {TIDY} SELECT app FROM (SELECT DISTINCT split_part(name, '_', 2) AS app FROM t WHERE split = 'train' AND source = 'real' INTERSECT SELECT DISTINCT split_part(name, '_', 2) FROM t WHERE split = 'test' AND source = 'real')")
def disjoint_check(spark, sf):
    app = F.split_part("name", F.lit("_"), F.lit(2)).alias("app")
    rows = tidy(spark, sf).where("source = 'real'")
    return rows.where("split = 'train'").select(app).intersect(rows.where("split = 'test'").select(app))


@query("label_set_union", f"WITH {TIDY} SELECT category FROM t WHERE split = 'val' UNION SELECT category FROM export_manifest WHERE category IS NOT NULL")
def label_set_union(spark, sf):
    return tidy(spark, sf).where("split = 'val'").select("category").union(table(spark, sf, "export_manifest").where("category IS NOT NULL").select("category")).distinct()


@query("manifest_agreement", f"WITH {TIDY}, m AS (SELECT DISTINCT sample_id, category_id AS mc, label AS ml FROM export_manifest) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE mc = category_id) AS BIGINT) AS same_category, CAST(count(*) FILTER (WHERE ml = label) AS BIGINT) AS same_label FROM t JOIN m USING (sample_id)")
def manifest_agreement(spark, sf):
    m = table(spark, sf, "export_manifest").select("sample_id", F.col("category_id").alias("mc"), F.col("label").alias("ml")).distinct()
    return tidy(spark, sf).join(m, "sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mc") == F.col("category_id")).alias("same_category"), F.count_if(F.col("ml") == F.col("label")).alias("same_label"))


@query("applied_check", f"""WITH {TIDY}, n AS (SELECT sample_id, {SYNTH.format(2)} AS ops FROM t WHERE source = 'synthetic'), a AS (SELECT sample_id, i, string_split(ops, '+')[i] AS named FROM (SELECT sample_id, ops, unnest(range(1, len(string_split(ops, '+')) + 1)) AS i FROM n WHERE ops <> '')),
b AS (SELECT DISTINCT sample_id, i, string_split(tipos_erro, '+')[i] AS applied FROM (SELECT sample_id, tipos_erro, unnest(range(1, len(string_split(tipos_erro, '+')) + 1)) AS i FROM export_manifest WHERE tipos_erro IS NOT NULL))
SELECT CAST(i - 1 AS INTEGER) AS position, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE named = applied) AS BIGINT) AS agree FROM a JOIN b USING (sample_id, i) GROUP BY 1""")
def applied_check(spark, sf):
    """Operators in the file name against the manifest, position by position."""
    named = tidy(spark, sf).where("source = 'synthetic'").select("sample_id", F.posexplode(F.split(names.synthetic_operators(F.col("name")), r"\+")).alias("position", "named"))
    applied = table(spark, sf, "export_manifest").select("sample_id", F.posexplode(F.split("tipos_erro", r"\+")).alias("position", "applied")).distinct()
    return named.join(applied, ["sample_id", "position"]).groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("named") == F.col("applied")).alias("agree"))
