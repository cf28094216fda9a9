"""Catalogue: metrics, thresholds, calibration and resampling over scored rows.

Scored rows are the events: error and purchase events are positive, the score is value / (value + 60),
the group is the user, and the number in props gives a predicted class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siltmark.functions import vectors
from siltmark.operators import bootstrap, decide, metrics, report
from siltmark.plans.registry import SCORED, SWEEP, query
from siltmark.session import table

TYPES = ("click", "error", "purchase", "signup", "view")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("g"), F.col("event_type").alias("cat"), F.col("event_type").isin("error", "purchase").cast("int").alias("y"),
        "value", "ts", (F.col("value") / (F.col("value") + F.lit(60.0))).alias("s"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"))


def classed(spark: SparkSession, sf: str) -> DataFrame:
    types = F.array(*[F.lit(t) for t in TYPES])
    return scored(spark, sf).select("id", "g", "s", F.array_position(types, F.col("cat")).cast("int").alias("t"), (F.col("k") % 5 + 1).alias("p"))


CLASSED = SCORED + ", q AS (SELECT id, g, s, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], cat) AS INTEGER) AS t, k % 5 + 1 AS p FROM v)"
CONF = "CAST(count(*) FILTER (WHERE y = 1 AND {0}) AS BIGINT) AS tp, CAST(count(*) FILTER (WHERE y = 0 AND NOT ({0})) AS BIGINT) AS tn, CAST(count(*) FILTER (WHERE y = 0 AND {0}) AS BIGINT) AS fp, CAST(count(*) FILTER (WHERE y = 1 AND NOT ({0})) AS BIGINT) AS fn"
RATES = """round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
 round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity, round(coalesce(fp / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS fpr, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1,
 round((coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) + coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0)) / 2, 6) AS balanced_accuracy,
 round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""
MIDRANK = "SELECT {by}round((sum(r) FILTER (WHERE y = 1) - P * (P + 1) / 2) / (P * N), 6) AS auroc FROM (SELECT *, rank() OVER ({part}ORDER BY s) + (count(*) OVER ({part2}) - 1) / 2::DOUBLE AS r, sum(y) OVER ({pp})::DOUBLE AS P, (count(*) OVER ({pp}) - sum(y) OVER ({pp}))::DOUBLE AS N FROM {src}) GROUP BY {by}P, N"


def midrank(src: str, by: str = "") -> str:
    p = f"PARTITION BY {by} " if by else ""
    return MIDRANK.format(by=f"{by}, " if by else "", part=p, part2=f"PARTITION BY {by}, s" if by else "PARTITION BY s", pp=p, src=src)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("outcome_tag", f"WITH {SCORED} SELECT id, CASE WHEN y = 1 AND s > 0.5 THEN 'TP' WHEN y = 0 AND NOT s > 0.5 THEN 'TN' WHEN y = 0 THEN 'FP' ELSE 'FN' END AS outcome FROM v")
def outcome_tag(spark, sf):
    return scored(spark, sf).select("id", decide.outcome(F.col("y"), F.col("s") > 0.5).alias("outcome"))


@query("confusion_binary", f"WITH {SCORED} SELECT {CONF.format('s > 0.5')} FROM v")
def confusion_binary(spark, sf):
    return metrics.confusion(scored(spark, sf), F.col("s") > 0.5)


@query("gate_metrics", f"WITH {SCORED}, c AS (SELECT cat, {CONF.format('s > 0.4')} FROM (SELECT * REPLACE (CAST(k >= 50 AS INTEGER) AS y) FROM v) GROUP BY 1) SELECT cat, {RATES} FROM c")
def gate_metrics(spark, sf):
    rows = scored(spark, sf).withColumn("y", (F.col("k") >= 50).cast("int"))
    rated = metrics.rates(metrics.confusion(rows, F.col("s") > 0.4, ["cat"]))
    names = ["accuracy", "precision", "recall", "specificity", "fpr", "f1", "balanced_accuracy", "mcc"]
    return rounded(rated.select("cat", *names), *names)


@query("auroc", f"WITH {SCORED} {midrank('v')}")
def auroc(spark, sf):
    return rounded(metrics.auroc(scored(spark, sf)).select("auroc"), "auroc")


@query("average_precision", f"WITH {SCORED}, {SWEEP} SELECT round(sum(p1 * tp / np) / max(P), 6) AS ap FROM w, tt")
def average_precision(spark, sf):
    return rounded(metrics.average_precision(scored(spark, sf)), "ap")


@query("pr_curve", f"WITH {SCORED}, {SWEEP} SELECT round(s, 9) AS s, round(tp / P, 6) AS recall, round(tp / np, 6) AS precision FROM w, tt")
def pr_curve(spark, sf):
    return rounded(metrics.pr_curve(scored(spark, sf)), "recall", "precision").withColumn("s", F.round("s", 9))


@query("thr_max_f1", f"WITH {SCORED}, {SWEEP} SELECT round(s - 1e-9, 8) AS threshold, round(2 * (tp / np) * (tp / P) / (tp / np + tp / P + 1e-12), 6) AS f1, CAST(tp AS BIGINT) AS tp, CAST(np AS BIGINT) AS np FROM w, tt ORDER BY 2 * (tp / np) * (tp / P) / (tp / np + tp / P + 1e-12) DESC, s DESC LIMIT 1")
def thr_max_f1(spark, sf):
    return rounded(metrics.threshold_max_f1(scored(spark, sf)), "f1").withColumn("threshold", F.round("threshold", 8))


@query("thr_specificity", f"WITH {SCORED}, {SWEEP}, z AS (SELECT s, tp / P AS r, (N - (np - tp)) / N AS sp FROM w, tt) SELECT round(s - 1e-9, 8) AS threshold, round(r, 6) AS recall, round(sp, 6) AS specificity, sp >= 0.9 AS met FROM z ORDER BY sp >= 0.9 DESC, CASE WHEN sp >= 0.9 THEN r ELSE sp END DESC, s DESC LIMIT 1")
def thr_specificity(spark, sf):
    return rounded(metrics.threshold_for_specificity(scored(spark, sf), 0.9), "recall", "specificity").withColumn("threshold", F.round("threshold", 8))


@query("thr_precision", f"WITH {SCORED}, {SWEEP}, z AS (SELECT s, tp / np AS p, tp / P AS r FROM w, tt) SELECT round(s - 1e-9, 8) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, p >= 0.41 AS met FROM z ORDER BY p >= 0.41 DESC, CASE WHEN p >= 0.41 THEN r ELSE p END DESC, s DESC LIMIT 1")
def thr_precision(spark, sf):
    return rounded(metrics.threshold_for_precision(scored(spark, sf), 0.41), "precision", "recall").withColumn("threshold", F.round("threshold", 8))


@query("thr_precision_unreachable", f"WITH {SCORED}, {SWEEP}, z AS (SELECT s, tp / np AS p, tp / P AS r FROM w, tt) SELECT round(s - 1e-9, 8) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, p >= 1.01 AS met FROM z ORDER BY p DESC, s DESC LIMIT 1")
def thr_precision_unreachable(spark, sf):
    return rounded(metrics.threshold_for_precision(scored(spark, sf), 1.01), "precision", "recall").withColumn("threshold", F.round("threshold", 8))


THRESHOLDS = (0.2, 0.35, 0.5, 0.65)


@query("threshold_list", f"WITH {SCORED}, h AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in THRESHOLDS)}]) AS thr), c AS (SELECT thr, {CONF.format('s > thr')} FROM v, h GROUP BY 1) SELECT thr, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0), 6) AS specificity FROM c")
def threshold_list(spark, sf):
    rows = scored(spark, sf).withColumn("thr", F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])))
    return rounded(metrics.rates(metrics.confusion(rows, F.col("s") > F.col("thr"), ["thr"])).select("thr", "recall", "specificity"), "recall", "specificity")


@query("brier", f"WITH {SCORED} SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM v")
def brier(spark, sf):
    return rounded(metrics.brier(scored(spark, sf)), "brier")


BINS = "e AS (SELECT i AS bin, i / 10::DOUBLE AS lo, (i + 1) / 10::DOUBLE AS hi FROM range(0, 10) r(i)), b AS (SELECT bin, count(*) AS n, sum(s) AS ss, sum(y) AS sy FROM v JOIN e ON (bin = 0 AND s >= lo AND s <= hi) OR (bin > 0 AND s > lo AND s <= hi) GROUP BY 1)"


@query("calibration_bins", f"WITH {SCORED}, {BINS} SELECT CAST(bin AS INTEGER) AS bin, CAST(n AS BIGINT) AS n, round(ss / n, 6) AS mean_s, round(sy / n::DOUBLE, 6) AS rate FROM b")
def calibration_bins(spark, sf):
    return metrics.calibration_bins(scored(spark, sf)).select("bin", "n", F.round(F.col("sum_s") / F.col("n"), 6).alias("mean_s"), F.round(F.col("sum_y") / F.col("n"), 6).alias("rate"))


@query("ece", f"WITH {SCORED}, {BINS} SELECT round(sum(abs(sy - ss)) / (SELECT count(*) FROM v), 6) AS ece FROM b")
def ece(spark, sf):
    return rounded(metrics.expected_calibration_error(scored(spark, sf)), "ece")


@query("calibration_methods", f"WITH {SCORED}, m AS (SELECT 'all' AS method, s, y FROM v UNION ALL SELECT 'low_k', s, y FROM v WHERE k < 50) SELECT method, round(avg((s - y) * (s - y)), 6) AS brier FROM m GROUP BY 1")
def calibration_methods(spark, sf):
    rows = scored(spark, sf)
    return rounded(metrics.compare_methods({"all": rows, "low_k": rows.where("k < 50")}, metrics.brier), "brier")


@query("precision_at_k", f"WITH {SCORED}, r AS (SELECT y, row_number() OVER (ORDER BY s DESC, id) AS r FROM v) SELECT k, round(avg(y), 6) AS precision FROM r, (VALUES (5), (10), (20)) x(k) WHERE r <= k GROUP BY 1")
def precision_at_k(spark, sf):
    return rounded(metrics.precision_at(scored(spark, sf), [5, 10, 20]), "precision")


PER = "a AS (SELECT t AS class, count(*) AS support FROM q GROUP BY 1), b AS (SELECT p AS class, count(*) AS n_pred, count(*) FILTER (WHERE t = p) AS tp FROM q GROUP BY 1), f AS (SELECT class, support, tp / n_pred::DOUBLE AS pr, tp / support::DOUBLE AS re FROM a JOIN b USING (class))"


@query("per_class", f"WITH {CLASSED}, {PER} SELECT class, CAST(support AS BIGINT) AS support, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1 FROM f")
def per_class(spark, sf):
    return rounded(metrics.per_class(classed(spark, sf), "t", "p").select("class", "support", "precision", "recall", "f1"), "precision", "recall", "f1")


@query("macro_f1", f"WITH {CLASSED}, {PER} SELECT round(avg(2 * pr * re / (pr + re)), 6) AS macro_f1, CAST(count(*) AS BIGINT) AS n_classes FROM f")
def macro_f1(spark, sf):
    return rounded(metrics.macro_f1(classed(spark, sf), "t", "p"), "macro_f1")


@query("confusion_multi", f"WITH {CLASSED}, g AS (SELECT CAST(a AS INTEGER) AS truth, CAST(b AS INTEGER) AS predicted FROM range(1, 7) x(a), range(1, 7) y(b)) SELECT truth, predicted, CAST((SELECT count(*) FROM q WHERE t = truth AND p = predicted) AS BIGINT) AS n FROM g")
def confusion_multi(spark, sf):
    return metrics.confusion_matrix(classed(spark, sf), "t", "p", list(range(1, 7)))


@query("ovr_auroc", f"WITH {SCORED}, o AS (" + " UNION ALL ".join(f"SELECT '{t}' AS class, CAST(cat = '{t}' AS INTEGER) AS y, s * {i + 1} - k AS s FROM v" for i, t in enumerate(TYPES)) + f") {midrank('o', 'class')}")
def ovr_auroc(spark, sf):
    arms = {t: F.col("s") * (i + 1) - F.col("k") for i, t in enumerate(TYPES)}
    return rounded(metrics.one_vs_rest_auroc(scored(spark, sf), "cat", arms).select("class", "auroc"), "auroc")


@query("detection_by_category", f"WITH {SCORED}, o AS (SELECT e.cat AS slice, v.s, CAST(v.cat <> 'view' AS INTEGER) AS y FROM v, (SELECT DISTINCT cat FROM v WHERE cat <> 'view') e WHERE v.cat = e.cat OR v.cat = 'view'), a AS ({midrank('o', 'slice')}) SELECT slice, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(s > 0.5 AS INTEGER)), 6) AS recall, round(avg(s), 6) AS mean_s, max(auroc) AS auroc FROM o JOIN a USING (slice) WHERE y = 1 GROUP BY 1")
def detection_by_category(spark, sf):
    return rounded(metrics.detection_by_category(scored(spark, sf), "cat", "view", 0.5), "recall", "mean_s", "auroc")


@query("histogram", f"WITH {SCORED} SELECT y, CAST(least(floor((s - 0.0) / 1.0 * 20), 19) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n FROM v WHERE s BETWEEN 0 AND 1 GROUP BY 1, 2")
def histogram(spark, sf):
    return metrics.histogram(scored(spark, sf), "s", 20, 0.0, 1.0)


@query("falsifiability", f"WITH {SCORED}, o AS (SELECT 'error' AS target, s, y FROM v UNION ALL SELECT 'resolution', s, CAST(k >= 50 AS INTEGER) FROM v) {midrank('o', 'target')}")
def falsifiability(spark, sf):
    arms = F.array(F.struct(F.lit("error").alias("target"), F.col("y").alias("y")), F.struct(F.lit("resolution").alias("target"), (F.col("k") >= 50).cast("int").alias("y")))
    rows = scored(spark, sf).select("s", F.explode(arms).alias("a")).select("s", "a.*")
    return rounded(metrics.auroc(rows, ["target"]).select("target", "auroc"), "auroc")


@query("weighted_auroc", f"""WITH {SCORED}, d AS (SELECT rep, g, (g * 7 + rep * 13) % 4 AS m FROM (SELECT DISTINCT g FROM v), range(0, 20) r(rep)), c AS (SELECT CAST(rep AS INTEGER) AS rep, s, CAST(sum(m * y) AS DOUBLE) AS wp, CAST(sum(m * (1 - y)) AS DOUBLE) AS wn FROM v JOIN d USING (g) GROUP BY 1, 2),
b AS (SELECT rep, wp, wn, sum(wn) OVER (PARTITION BY rep ORDER BY s) - wn AS below FROM c) SELECT rep, round(sum(wp * (below + wn / 2)) / (sum(wp) * sum(wn)), 6) AS auroc FROM b GROUP BY 1""")
def weighted_auroc(spark, sf):
    rows = scored(spark, sf)
    draws = rows.select("g").distinct().withColumn("m", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda rep: ((F.col("g") * 7 + rep * 13) % 4).cast("int")))
    return rounded(bootstrap.replicates(rows, "g", draws, 20).select("rep", "auroc"), "auroc")


@query("bootstrap_ci")
def bootstrap_ci(spark, sf):
    rows = scored(spark, sf)
    values = bootstrap.replicates(rows, "g", bootstrap.multiplicities(rows, "g", 50), 50)
    return rounded(bootstrap.interval(values, "auroc"), "mean", "ci_lo", "ci_hi")


@query("interval", f"WITH {SCORED}, a AS (SELECT g, avg(s) AS m FROM v GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS n_reps, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi FROM a")
def interval(spark, sf):
    return rounded(bootstrap.interval(scored(spark, sf).groupBy("g").agg(F.avg("s").alias("m")), "m"), "mean", "ci_lo", "ci_hi")


@query("fold_threshold", "SELECT CASE WHEN count(*) >= 8 THEN round(quantile_cont(h / CAST(3200 AS DOUBLE), 0.95), 6) END AS threshold, CAST(count(*) AS BIGINT) AS n FROM pool_manifest WHERE aspect BETWEEN 0.85 AND 1.18")
def fold_threshold(spark, sf):
    rows = table(spark, sf, "pool_manifest").select("aspect", F.lit(0).alias("y"), (F.col("h") / F.lit(3200.0)).alias("s"))
    return rounded(decide.fold_threshold(rows, 0.95), "threshold")


@query("seed_stats", f"WITH {SCORED}, a AS (SELECT k % 10 AS seed, cat, avg(s) AS m FROM v GROUP BY 1, 2) SELECT cat, CAST(count(*) AS BIGINT) AS n, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, round(min(m), 6) AS lo, round(max(m), 6) AS hi FROM a GROUP BY 1")
def seed_stats(spark, sf):
    runs = scored(spark, sf).groupBy((F.col("k") % 10).alias("seed"), "cat").agg(F.avg("s").alias("m"))
    stats = runs.groupBy("cat").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("std"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    return rounded(stats, "mean", "std", "se", "lo", "hi")


@query("one_se_rule", f"WITH {SCORED}, a AS (SELECT k % 10 AS seed, length(cat) AS size, cat, avg(s) AS m FROM v GROUP BY ALL), b AS (SELECT cat, size, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS se FROM a GROUP BY 1, 2), c AS (SELECT mean - se AS bound FROM b ORDER BY mean DESC, size, cat LIMIT 1) SELECT cat, size, round(mean, 6) AS mean FROM b, c WHERE mean >= bound ORDER BY size, cat LIMIT 1")
def one_se_rule(spark, sf):
    runs = scored(spark, sf).groupBy((F.col("k") % 10).alias("seed"), "cat").agg(F.avg("s").alias("m"))
    per = runs.groupBy("cat").agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count(F.lit(1)))).alias("se")).withColumn("size", F.length("cat"))
    bound = per.agg(F.max_by(F.col("mean") - F.col("se"), F.struct(F.col("mean"), -F.col("size"))).alias("bound"))
    return per.crossJoin(F.broadcast(bound)).where("mean >= bound").orderBy("size", "cat").limit(1).select("cat", "size", F.round("mean", 6).alias("mean"))  # one row of bound


@query("masked_stats", f"WITH {SCORED} SELECT cat, round(avg(s) FILTER (WHERE k >= 20), 6) AS masked_mean, round(stddev_pop(s) FILTER (WHERE k >= 20), 6) AS masked_std, round(stddev_samp(s), 6) AS std FROM v GROUP BY 1")
def masked_stats(spark, sf):
    kept = F.when(F.col("k") >= 20, F.col("s"))
    return rounded(scored(spark, sf).groupBy("cat").agg(F.avg(kept).alias("masked_mean"), F.stddev_pop(kept).alias("masked_std"), F.stddev_samp("s").alias("std")), "masked_mean", "masked_std", "std")


@query("top_fraction_mean", f"WITH {SCORED}, r AS (SELECT g, s, row_number() OVER (PARTITION BY g ORDER BY s DESC, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM v) SELECT g, round(avg(s), 6) AS m FROM r WHERE r <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) GROUP BY 1")
def top_fraction_mean(spark, sf):
    from pyspark.sql.window import Window

    ranked = scored(spark, sf).select("g", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "id")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"), "s")
    return rounded(ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))).groupBy("g").agg(F.avg("s").alias("m")), "m")


@query("fusion_score", f"WITH {SCORED} SELECT id, round(1 / (1 + exp(-(2.5 * s + (-1.25) * (k / CAST(100 AS DOUBLE)) + 0.3))), 6) AS p FROM v")
def fusion_score(spark, sf):
    return scored(spark, sf).select("id", F.round(decide.fused(F.col("s"), F.col("k") / F.lit(100.0), 2.5, -1.25, 0.3), 6).alias("p"))


@query("softmax_aux", f"WITH {SCORED} SELECT id, round(1 - exp(s) / (exp(s) + exp(k / CAST(100 AS DOUBLE)) + exp(CAST(0.5 AS DOUBLE))), 6) AS aux_err FROM v")
def softmax_aux(spark, sf):
    logits = F.array(F.col("s"), F.col("k") / F.lit(100.0), F.lit(0.5))
    return scored(spark, sf).select("id", F.round(1 - vectors.softmax(logits)[0], 6).alias("aux_err"))


@query("gate_routing", "SELECT pool_id, CASE WHEN coalesce(aspect, 0) BETWEEN 0.85 AND 1.18 THEN h / CAST(4000 AS DOUBLE) >= 0.5 ELSE w / CAST(3000 AS DOUBLE) > 0.6 END AS passed FROM pool_manifest")
def gate_routing(spark, sf):
    rows = table(spark, sf, "pool_manifest")
    passed = decide.gate(F.col("aspect"), F.col("h") / F.lit(4000.0), F.col("w") / F.lit(3000.0), F.lit(0.6), F.lit(0.5))
    return rows.select("pool_id", passed.alias("passed"))


@query("early_stop", f"""WITH RECURSIVE {SCORED}, h AS (SELECT k AS epoch, avg(s) AS m FROM v GROUP BY 1), o AS (SELECT epoch, m, row_number() OVER (ORDER BY epoch) AS i FROM h),
st(i, epoch, best, best_epoch, wait, stopped) AS (SELECT 1::BIGINT, epoch, m, epoch, 0, false FROM o WHERE i = 1 UNION ALL
 SELECT o.i, o.epoch, CASE WHEN o.m > best + 1e-4 THEN o.m ELSE best END, CASE WHEN o.m > best + 1e-4 THEN o.epoch ELSE best_epoch END, CASE WHEN o.m > best + 1e-4 THEN 0 ELSE wait + 1 END, (CASE WHEN o.m > best + 1e-4 THEN 0 ELSE wait + 1 END) >= 10 FROM st JOIN o ON o.i = st.i + 1 WHERE NOT stopped)
SELECT best_epoch, round(best, 6) AS best, epoch AS last_epoch FROM st ORDER BY i DESC LIMIT 1""")
def early_stop(spark, sf):
    """Running best with a margin of 1e-4 and a patience of 10 over the history of one run."""
    history = scored(spark, sf).groupBy(F.col("k").alias("epoch")).agg(F.avg("s").alias("m"))
    rows = history.agg(F.array_sort(F.collect_list(F.struct("epoch", "m"))).alias("h"))  # one run's epochs
    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("int").alias("best_epoch"), F.lit(0).alias("wait"), F.lit(None).cast("int").alias("last"), F.lit(False).alias("stopped"))

    def step(a, e):
        better = a["best"].isNull() | (e["m"] > a["best"] + 1e-4)
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        moved = F.struct(F.when(better, e["m"]).otherwise(a["best"]).alias("best"), F.when(better, e["epoch"]).otherwise(a["best_epoch"]).alias("best_epoch"), wait.alias("wait"), e["epoch"].alias("last"), (wait >= 10).alias("stopped"))
        return F.when(a["stopped"], a).otherwise(moved)

    return rows.select(F.aggregate("h", start, step).alias("a")).select("a.best_epoch", F.round("a.best", 6).alias("best"), F.col("a.last").alias("last_epoch"))


@query("leaderboard", f"WITH {SCORED}, a AS (SELECT g, CASE WHEN sum(y) = 0 THEN CAST('nan' AS DOUBLE) ELSE avg(s) END AS score FROM v GROUP BY 1) SELECT g, CASE WHEN isnan(score) THEN -1 ELSE round(score, 6) END AS score FROM a ORDER BY CASE WHEN isnan(score) THEN -1 ELSE score END DESC, g LIMIT 10")
def leaderboard(spark, sf):
    runs = scored(spark, sf).groupBy("g").agg(F.when(F.sum("y") == 0, F.lit(float("nan"))).otherwise(F.avg("s")).alias("score"))
    ranked = runs.withColumn("score", F.nanvl(F.coalesce("score", F.lit(float("nan"))), F.lit(-1.0)))
    return ranked.orderBy(F.desc("score"), "g").limit(10).select("g", F.round("score", 6).alias("score"))


@query("score_map", f"WITH {SCORED}, a AS (SELECT g, cat, round(max(s), 4) AS m FROM v GROUP BY 1, 2) SELECT g, string_agg(cat, '>' ORDER BY m DESC, cat) AS ranking FROM a GROUP BY 1")
def score_map(spark, sf):
    best = scored(spark, sf).groupBy("g", "cat").agg(F.round(F.max("s"), 4).alias("m"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("m"), "cat")))
    return best.groupBy("g").agg(F.concat_ws(">", F.transform(ordered, lambda e: e["cat"])).alias("ranking"))


@query("support_filter", f"WITH {CLASSED} SELECT t AS class, CAST(count(*) AS BIGINT) AS support, round(avg(CAST(t = p AS INTEGER)), 6) AS hit_rate FROM q GROUP BY 1 HAVING count(*) >= 5")
def support_filter(spark, sf):
    per = classed(spark, sf).groupBy(F.col("t").alias("class")).agg(F.count(F.lit(1)).alias("support"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("hit_rate"))
    return rounded(per.where("support >= 5"), "hit_rate")


@query("slice_specificity", f"WITH {SCORED} SELECT coalesce(CAST(k < 30 AS VARCHAR), 'all') AS in_slice, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(s <= 0.5 AS INTEGER)), 6) AS specificity FROM v WHERE y = 0 GROUP BY GROUPING SETS ((k < 30), ())")
def slice_specificity(spark, sf):
    rows = scored(spark, sf).where("y = 0").withColumn("in_slice", (F.col("k") < 30).cast("string"))
    per = rows.rollup("in_slice").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s") <= 0.5).cast("double")).alias("specificity"))
    return rounded(per.select(F.coalesce("in_slice", F.lit("all")).alias("in_slice"), "n", "specificity"), "specificity")


@query("verdict", f"WITH {SCORED}, a AS (SELECT cat, avg(s) AS c FROM v GROUP BY 1) SELECT cat, CASE WHEN c > 0.85 THEN 'confound' WHEN c > 0.65 THEN 'breaking' ELSE 'broken' END AS verdict FROM a")
def verdict(spark, sf):
    per = scored(spark, sf).groupBy("cat").agg(F.avg("s").alias("c"))
    return per.select("cat", F.when(F.col("c") > 0.85, "confound").when(F.col("c") > 0.65, "breaking").otherwise("broken").alias("verdict"))


REPORT = " UNION ALL ".join([
    "SELECT 'ranking' AS block, 'ap' AS metric, round(sum(p1 * tp / np) / max(P), 6) AS value FROM w, tt",
    "SELECT 'calibration', 'brier', round(avg((s - y) * (s - y)), 6) FROM v",
    "SELECT 'calibration', 'ece', round(sum(abs(sy - ss)) / (SELECT count(*) FROM v), 6) FROM b",
    f"SELECT 'ranking', 'auroc', auroc FROM ({midrank('v')})",
    "SELECT 'ranking', 'n_pos', CAST(sum(y) AS DOUBLE) FROM v",
    "SELECT 'ranking', 'n_neg', CAST(sum(1 - y) AS DOUBLE) FROM v",
])


@query("evaluation_report", f"WITH {SCORED}, {SWEEP}, {BINS} {REPORT}")
def evaluation_report(spark, sf):
    rows = report.evaluate(scored(spark, sf), 0.5)
    return rows.where("block IN ('ranking', 'calibration')").select("block", "metric", F.round("value", 6).alias("value"))


@query("evaluation_full")
def evaluation_full(spark, sf):
    """Every block of the report, with detection per category and the bootstrap interval."""
    rows = scored(spark, sf)
    return report.evaluate(rows, 0.5, "cat", "view").unionByName(report.with_interval(rows, "g", 20))


@query("confound_baselines", f"""WITH o AS (SELECT 'resolution' AS rule, w + h AS s, CAST(source = 'foldable' AS INTEGER) AS y FROM pool_manifest WHERE w > 0 UNION ALL SELECT 'aspect', w / CAST(h AS DOUBLE), CAST(source = 'foldable' AS INTEGER) FROM pool_manifest WHERE w > 0 AND h > 0
 UNION ALL SELECT 'padding', 1 - (CAST(w AS DOUBLE) * h) / (CAST(greatest(w, h) AS DOUBLE) * greatest(w, h)), CAST(source = 'foldable' AS INTEGER) FROM pool_manifest WHERE w > 0 AND h > 0) {midrank('o', 'rule')}""")
def confound_baselines(spark, sf):
    rows = table(spark, sf, "pool_manifest").where("w > 0").withColumn("y", (F.col("source") == "foldable").cast("int"))
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    arms = F.array(F.struct(F.lit("resolution").alias("rule"), (w + h).alias("s")), F.struct(F.lit("aspect").alias("rule"), F.when(h > 0, F.try_divide(w, h)).alias("s")), F.struct(F.lit("padding").alias("rule"), F.when(h > 0, vectors.pad_fraction(F.col("w"), F.col("h"))).alias("s")))
    return rounded(metrics.auroc(rows.select("y", F.explode(arms).alias("a")).select("y", "a.*"), ["rule"]).select("rule", "auroc"), "auroc")


@query("report_extract", "SELECT event_type, CAST(max(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)) AS INTEGER) AS most, round(avg(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)), 6) AS mean FROM events GROUP BY 1")
def report_extract(spark, sf):
    """Nested values out of JSON reports, with null for what is missing."""
    parsed = table(spark, sf, "events").select("event_type", F.from_json("props", "k int").alias("r"))
    return rounded(parsed.groupBy("event_type").agg(F.max("r.k").alias("most"), F.avg("r.k").alias("mean")), "mean")
