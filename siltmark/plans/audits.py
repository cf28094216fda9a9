"""Catalogue: pools, probes, fixed-label metrics, audits and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltmark.functions import names, taxonomy
from siltmark.operators import curate, decide, metrics, report, similarity, splits
from siltmark.plans.curation import CATEGORY_ID, SYNTH, tidy
from siltmark.plans.evaluation import CLASSED, classed, midrank, rounded, scored
from siltmark.plans.registry import SCORED, STEM, TIDY, query
from siltmark.plans.similarity import EMB, asked, embedded
from siltmark.session import table

LABELS = list(range(1, 7))


@query("fixed_label_metrics", f"""WITH {CLASSED}, c AS (SELECT CAST(i AS INTEGER) AS class FROM range(1, 7) r(i)), k AS (SELECT class, count(*) FILTER (WHERE t = class) AS support, count(*) FILTER (WHERE p = class) AS n_pred, count(*) FILTER (WHERE t = class AND p = class) AS tp, count(*) AS n FROM c, q GROUP BY 1)
SELECT class, CAST(support AS BIGINT) AS support, round(coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(support, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(support + n_pred, 0)::DOUBLE, 0), 6) AS f1, round((n - support - n_pred + 2 * tp) / n::DOUBLE, 6) AS accuracy FROM k""")
def fixed_label_metrics(spark, sf):
    """Six labels, one of which no row has."""
    return rounded(metrics.fixed_labels(classed(spark, sf), "t", "p", LABELS), "precision", "recall", "f1", "accuracy")


@query("fixed_label_summary", f"""WITH {CLASSED}, c AS (SELECT CAST(i AS INTEGER) AS class FROM range(1, 7) r(i)), k AS (SELECT class, count(*) FILTER (WHERE t = class) AS support, count(*) FILTER (WHERE p = class) AS n_pred, count(*) FILTER (WHERE t = class AND p = class) AS tp, count(*) AS n FROM c, q GROUP BY 1)
SELECT round(sum(tp) / max(n)::DOUBLE, 6) AS accuracy, round(avg(coalesce(2 * tp / nullif(support + n_pred, 0)::DOUBLE, 0)), 6) AS macro_f1 FROM k""")
def fixed_label_summary(spark, sf):
    rows = metrics.fixed_labels(classed(spark, sf), "t", "p", LABELS)
    return rounded(metrics.label_summary(rows), "accuracy", "macro_f1")


@query("auroc_macro", f"WITH {SCORED}, o AS (" + " UNION ALL ".join(f"SELECT '{t}' AS class, CAST(cat = '{t}' AS INTEGER) AS y, s * {i + 1} - k AS s FROM v" for i, t in enumerate(("click", "error", "none"))) + f"), a AS ({midrank('o', 'class')}) SELECT round(avg(auroc) FILTER (WHERE isfinite(auroc)), 6) AS auroc_macro, CAST(count(*) FILTER (WHERE isfinite(auroc)) AS BIGINT) AS n_classes FROM a")
def auroc_macro(spark, sf):
    """Mean over the classes that both have and lack rows; `none` has none."""
    arms = {t: F.col("s") * (i + 1) - F.col("k") for i, t in enumerate(("click", "error", "none"))}
    return rounded(metrics.macro_auroc(metrics.one_vs_rest_auroc(scored(spark, sf), "cat", arms)), "auroc_macro")


@query("reflow_false_positives", f"WITH {SCORED}, o AS (SELECT s, CAST(k >= 50 AS INTEGER) AS y FROM v WHERE v.y = 0), a AS ({midrank('o')}) SELECT CAST(count(*) FILTER (WHERE y = 0) AS BIGINT) AS n_clean, CAST(count(*) FILTER (WHERE y = 1) AS BIGINT) AS n_reflow, (SELECT auroc FROM a) AS auroc, round(avg(CAST(s > 0.5 AS INTEGER)) FILTER (WHERE y = 1), 6) AS fp_rate, CAST(count(*) FILTER (WHERE y = 1 AND s > 0.5) AS BIGINT) AS n_fp, round(avg(s) FILTER (WHERE y = 1), 6) AS mean_reflow, round(avg(s) FILTER (WHERE y = 0), 6) AS mean_clean FROM o")
def reflow_false_positives(spark, sf):
    clean = scored(spark, sf).where("y = 0")
    return rounded(metrics.reflow_false_positives(clean.where("k < 50"), clean.where("k >= 50"), 0.5), "auroc", "fp_rate", "mean_reflow", "mean_clean")


@query("same_resolution", f"""WITH {TIDY}, c AS (SELECT w, h FROM pool_manifest WHERE w > 0 AND source = 'foldable' GROUP BY 1, 2 ORDER BY count(*) DESC, w, h LIMIT 1), p AS (SELECT regexp_extract(path, '[^/]*$') AS name, w, h, pool_id FROM pool_manifest)
SELECT pool_id, name, NOT starts_with(name, 'Screenshot_') AS independent FROM p JOIN c USING (w, h) WHERE name IN (SELECT name FROM t WHERE label = 1)""")
def same_resolution(spark, sf):
    """Screens of a known error that have the most frequent foldable size, and whether they stand outside capture sessions."""
    pool = table(spark, sf, "pool_manifest").withColumn("name", names.base_name(F.col("path")))
    sizes = pool.where("w > 0 AND source = 'foldable'").groupBy("w", "h").agg(F.count(F.lit(1)).alias("n"))
    clean = sizes.agg(F.max_by(F.struct("w", "h"), F.struct(F.col("n"), -F.col("w"), -F.col("h"))).alias("c")).select("c.w", "c.h")
    errors = pool.join(tidy(spark, sf).where("label = 1").select("name"), "name", "left_semi")
    return curate.same_resolution(errors, clean, "name").select("pool_id", "name", "independent")


@query("even_folds", f"WITH {TIDY}, f AS (SELECT category, CAST((row_number() OVER (PARTITION BY category ORDER BY md5('0:' || sample_id), sample_id) - 1) % 5 AS INTEGER) AS fold FROM t) SELECT category, fold, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY 1, 2")
def even_folds(spark, sf):
    folded = splits.even_folds(tidy(spark, sf).select("sample_id", "category"), "sample_id", "category", 5)
    return folded.groupBy("category", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("oof_complete", f"WITH {TIDY} SELECT category, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def oof_complete(spark, sf):
    """Rows of every category after the folds are put together and checked to be all rows, once each."""
    rows = tidy(spark, sf).select("sample_id", "category")
    folded = splits.even_folds(rows, "sample_id", "category", 3)
    parts = folded.where("fold = 0").unionByName(folded.where("fold = 1")).unionByName(folded.where("fold = 2"))
    return splits.complete_folds(rows, parts, "sample_id").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("app_partition", f"WITH {TIDY}, a AS (SELECT app, row_number() OVER (ORDER BY md5('7:' || app), app) AS r FROM (SELECT DISTINCT split_part(name, '_', 2) AS app FROM t WHERE source = 'real')) SELECT app, CASE WHEN r <= 3 THEN 'val' WHEN r <= 7 THEN 'test' ELSE 'train' END AS split, CAST(count(*) AS BIGINT) AS n FROM t JOIN a ON a.app = split_part(name, '_', 2) WHERE source = 'real' GROUP BY 1, 2")
def app_partition(spark, sf):
    rows = tidy(spark, sf).where("source = 'real'").withColumn("app", F.split_part("name", F.lit("_"), F.lit(2)))
    return splits.app_partition(rows, "app", 3, 4, 7).groupBy("app", "split").agg(F.count(F.lit(1)).alias("n"))


@query("category_prototypes", f"WITH {EMB} SELECT proto AS label, 0 AS proto, round(vec[1], 6) AS first, round(vec[64], 6) AS last FROM c WHERE proto <> 0")
def category_prototypes(spark, sf):
    made = similarity.category_prototypes(embedded(spark, sf).where("label <> 0"), "label", "embedding")
    return made.select("label", "proto", F.round(F.col("vec")[0], 6).alias("first"), F.round(F.col("vec")[63], 6).alias("last"))


@query("category_kmeans")
def category_kmeans(spark, sf):
    """Rows of every error category, and how many are nearest to a prototype of their own category."""
    errors = embedded(spark, sf).where("label <> 0")
    made = similarity.category_prototypes(errors, "label", "embedding", 2)
    numbered = made.select((F.col("label") * 100 + F.col("proto")).alias("proto"), "vec")
    best = similarity.nearest_prototype(similarity.cosine_join(errors, numbered, "embedding"), "id", "proto", ["label"])
    return best.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.floor(F.col("proto") / 100) == F.col("label")).alias("own"))


@query("multinomial_category")
def multinomial_category(spark, sf):
    """Rows of every class, and how many a balanced multinomial regression names so."""
    rows = embedded(spark, sf)
    coefficients, bias = decide.multinomial_fit(rows, "embedding", "label")
    named = rows.select("label", decide.multinomial_class(F.col("embedding"), coefficients, bias).alias("predicted"))
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("predicted")).alias("hits"))


PARENTS = f"parents AS (SELECT {STEM.format('name')} AS parent, min(grp) AS pg FROM t WHERE source = 'real' AND split IN ('train', 'val') AND label = 0 GROUP BY 1)"


@query("development_pool", f"""WITH {TIDY}, {PARENTS}, s AS (SELECT sample_id, category, label, nullif({SYNTH.format(1)}, '') AS parent FROM t WHERE source = 'synthetic' AND split = 'train')
SELECT sample_id, {CATEGORY_ID} AS category_id, label, grp AS "group", true AS is_real FROM t WHERE source = 'real' AND split IN ('train', 'val') UNION ALL SELECT sample_id, {CATEGORY_ID}, label, coalesce(pg, 'synthorphan:' || sample_id), false FROM s LEFT JOIN parents USING (parent)""")
def development_pool(spark, sf):
    return curate.development_pool(tidy(spark, sf)).withColumn("category_id", taxonomy.category_id(F.col("category"))).select("sample_id", "category_id", "label", "group", "is_real")


@query("probe_union", f"WITH {TIDY} SELECT sample_id, 0 AS y, 'clean' AS src FROM t WHERE source = 'real' AND split = 'test' AND label = 0 UNION ALL SELECT sample_id, 1, 'synth' FROM t WHERE source = 'synthetic' AND split = 'test'")
def probe_union(spark, sf):
    return curate.probe_union(tidy(spark, sf), "test").select("sample_id", "y", "src")


@query("calibration_set", f"WITH {TIDY} SELECT 'confound_free' AS method, y, CAST(count(*) AS BIGINT) AS n FROM (SELECT 0 AS y FROM t WHERE split = 'val' AND source = 'real' AND label = 0 UNION ALL SELECT 1 FROM t WHERE split = 'val' AND source = 'synthetic' UNION ALL SELECT 0 FROM pool_manifest WHERE w > 0) GROUP BY 2 UNION ALL SELECT 'real_val', label, CAST(count(*) AS BIGINT) FROM t WHERE split = 'val' AND source = 'real' GROUP BY 2")
def calibration_set(spark, sf):
    """With synthetic rows clean, synthetic and reflowed rows calibrate; without any, the real rows do."""
    rows = tidy(spark, sf).where("split = 'val'").select("source", "label")
    reflow = table(spark, sf, "pool_manifest").where("w > 0").select(F.lit("pool").alias("source"))
    real, synth = rows.where("source = 'real'"), rows.where("source = 'synthetic'")
    both = curate.calibration_set(real, synth, reflow).unionByName(curate.calibration_set(real, synth.where("false"), reflow))
    return both.groupBy("method", "y").agg(F.count(F.lit(1)).alias("n"))


@query("slice_parents", f"""WITH {TIDY}, c AS (SELECT {STEM.format('name')} AS parent, min(sample_id) AS id, min(form_factor) = 'fold' AS inside FROM t WHERE source = 'real' AND split = 'test' AND label = 0 GROUP BY 1),
n AS (SELECT parent, row_number() OVER (ORDER BY id) - 1 AS new_parent FROM c WHERE inside), s AS (SELECT sample_id, nullif({SYNTH.format(1)}, '') AS parent FROM t WHERE source = 'synthetic')
SELECT sample_id, CAST(new_parent AS BIGINT) AS new_parent FROM s JOIN n USING (parent)""")
def slice_parents(spark, sf):
    """Synthetic rows whose clean parent lies in the slice of folded screens, with the parent's number in the slice."""
    rows = tidy(spark, sf)
    clean = rows.where("source = 'real' AND split = 'test' AND label = 0").groupBy(names.stem(F.col("name")).alias("parent")).agg(F.min("sample_id").alias("id"), (F.min("form_factor") == "fold").alias("inside"))
    probes = rows.where("source = 'synthetic'").select("sample_id", names.synthetic_parent(F.col("name")).alias("parent"))
    return curate.remapped_parents(probes, clean.where("inside"), "parent", "id").select("sample_id", "new_parent")


@query("confound_matrix", "SELECT pool_id, w, h, round(w / CAST(greatest(h, 1) AS DOUBLE), 6) AS aspect, CAST(regexp_extract(lower(regexp_extract(path, '[^/]*$')), '(screenshot|screeshot|photo)', 1) = 'photo' AS INTEGER) AS is_photo FROM pool_manifest")
def confound_matrix(spark, sf):
    kind = names.kind(names.base_name(F.col("path")))
    return table(spark, sf, "pool_manifest").select("pool_id", "w", "h", F.round(F.col("w").cast("double") / F.greatest("h", F.lit(1)), 6).alias("aspect"), (kind == "photo").cast("int").alias("is_photo"))


@query("ranked_predictions", f"WITH {SCORED} SELECT id, round(s, 6) AS p_error FROM v ORDER BY s DESC, id LIMIT 50")
def ranked_predictions(spark, sf):
    """The fifty rows most likely to be errors."""
    return scored(spark, sf).orderBy(F.desc("s"), "id").limit(50).select("id", F.round("s", 6).alias("p_error"))


@query("contrastive_loss", "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), u AS (SELECT id, label, list_transform(x, lambda q: q / sqrt(list_dot_product(x, x))) AS z FROM e), p AS (SELECT a.label = b.label AS same, list_distance(a.z, b.z) AS d FROM u a JOIN u b ON b.id = a.id + 1) SELECT round(avg(CASE WHEN same THEN d * d ELSE power(greatest(1.5 - d, 0), 2) END), 6) AS contrastive FROM p")
def contrastive_loss(spark, sf):
    a = embedded(spark, sf).select("id", F.col("embedding").alias("a"), F.col("label").alias("la"))
    b = embedded(spark, sf).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"), F.col("label").alias("lb"))
    pairs = a.join(b, "id").withColumn("same", F.col("la") == F.col("lb"))
    return rounded(similarity.contrastive_loss(pairs, "a", "b", "same", 1.5), "contrastive")


@query("detection_interval", f"""WITH {SCORED}, o AS (SELECT e.cat AS slice, v.g, v.s, CAST(v.cat <> 'view' AS INTEGER) AS y FROM v, (SELECT DISTINCT cat FROM v WHERE cat <> 'view') e WHERE v.cat = e.cat OR v.cat = 'view'), d AS (SELECT rep, g, (g * 7 + rep * 13) % 4 AS m FROM (SELECT DISTINCT g FROM v), range(0, 20) r(rep)),
c AS (SELECT slice, rep, s, CAST(sum(m * y) AS DOUBLE) AS wp, CAST(sum(m * (1 - y)) AS DOUBLE) AS wn FROM o JOIN d USING (g) GROUP BY ALL), b AS (SELECT *, sum(wn) OVER (PARTITION BY slice, rep ORDER BY s) - wn AS below FROM c), a AS (SELECT slice, rep, sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)) AS auroc FROM b GROUP BY 1, 2 HAVING sum(wp) * sum(wn) > 0)
SELECT slice, CAST(count(*) AS BIGINT) AS n_reps, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS ci_lo, round(quantile_cont(auroc, 0.975), 6) AS ci_hi FROM a GROUP BY 1""")
def detection_interval(spark, sf):
    """Interval of each category's AUROC against the clean rows, from fixed draws of the groups."""
    rows = scored(spark, sf)
    draws = rows.select("g").distinct().withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda rep: ((F.col("g") * 7 + rep * 13) % 4).cast("int")))
    return rounded(report.detection_intervals(rows, "cat", "view", "g", draws, 20), "mean", "ci_lo", "ci_hi")


@query("nearest_category_prototype", f"WITH {EMB} SELECT id, proto AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, proto) AS r FROM j WHERE proto <> 0 AND id % 100 = 0) WHERE r = 1")
def nearest_category_prototype(spark, sf):
    """The error category of the nearest prototype, for the query set of searches."""
    made = similarity.category_prototypes(embedded(spark, sf).where("label <> 0"), "label", "embedding").select(F.col("label").alias("proto"), "vec")
    return similarity.nearest_prototype(similarity.cosine_join(asked(spark, sf), made, "embedding"), "id", "proto", []).select("id", F.col("proto").alias("predicted"))
