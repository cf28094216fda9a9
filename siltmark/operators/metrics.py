"""Ranking, threshold and calibration metrics of binary and multi-class decisions.

Inputs are scored rows: `y` 0 or 1, `s` a score where larger means more likely 1. Metrics that a slice
cannot have (one class only, no rows) are null. Rows with a null or NaN score are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from siltmark.operators.ordered import running_totals


def usable(df: DataFrame) -> DataFrame:
    return df.where(F.col("s").isNotNull() & ~F.isnan("s") & F.col("y").isNotNull())


def ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(otherwise).cast("double"))


def confusion(df: DataFrame, predicted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, tn, fp, fn of a boolean prediction against y."""
    y = F.col("y") == 1
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(n) for n, c in (("tp", y & predicted), ("tn", ~y & ~predicted), ("fp", ~y & predicted), ("fn", y & ~predicted))])


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity, FPR, F1, balanced accuracy and MCC of tp, tn, fp, fn.

    A rate whose denominator is 0 is 0; MCC is null where one class of y is missing.
    """
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    root = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    both = (tp + fn > 0) & (tn + fp > 0)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "specificity": specificity,
        "fpr": ratio(fp, tn + fp),
        "f1": ratio(2 * precision * recall, precision + recall),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": F.when(both, ratio(tp * tn - fp * fn, root)),
    })


def _steps(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per distinct score with weighted positives wp and negatives wn."""
    weight = F.col("m") if "m" in df.columns else F.lit(1)
    return usable(df).groupBy(*by, "s").agg(F.sum(weight * F.col("y")).cast("double").alias("wp"), F.sum(weight * (1 - F.col("y"))).cast("double").alias("wn"))


def auroc(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by mid-ranks; column m, where present, weights the rows."""
    by = by or []
    steps = running_totals(_steps(df, by), "s", ["wn"], by)
    below = F.col("run_wn") - F.col("wn")
    parts = steps.groupBy(*by).agg(F.sum(F.col("wp") * (below + F.col("wn") / 2)).alias("u"), F.sum("wp").alias("p"), F.sum("wn").alias("n"))
    return parts.select(*by, F.try_divide(F.col("u"), F.col("p") * F.col("n")).alias("auroc"), F.col("p").cast("long").alias("n_pos"), F.col("n").cast("long").alias("n_neg"))


def sweep(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Every cut with the true positives tp and all rows np at or above it, and the totals P and N."""
    by = by or []
    steps = _steps(df, by).withColumn("k", F.col("wp") + F.col("wn"))
    run = running_totals(steps, "s", ["wp", "k"], by, descending=True)
    totals = run.groupBy(*by).agg(F.sum("wp").alias("P"), F.sum("wn").alias("N"))  # from the written steps
    joined = run.join(F.broadcast(totals), by) if by else run.crossJoin(F.broadcast(totals))  # one row of totals
    return joined.select(*by, "s", "wp", "k", F.col("run_wp").alias("tp"), F.col("run_k").alias("np"), "P", "N")


def average_precision(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return sweep(df, by).groupBy(*by).agg(F.try_divide(F.sum(F.col("wp") * F.col("tp") / F.col("np")), F.max("P")).alias("ap"))


def threshold_max_f1(df: DataFrame) -> DataFrame:
    """Highest cut of the largest F1; the threshold lies 1e-9 below it and is applied with `>`."""
    p, r = F.col("tp") / F.col("np"), ratio(F.col("tp"), F.col("P"))
    cuts = sweep(df).withColumn("f1", 2 * p * r / (p + r + 1e-12))
    best = cuts.agg(F.max_by(F.struct("s", "f1", "tp", "np"), F.struct("f1", "s")).alias("b"))
    return best.select((F.col("b.s") - 1e-9).alias("threshold"), F.col("b.f1").alias("f1"), F.col("b.tp").cast("long").alias("tp"), F.col("b.np").cast("long").alias("np"))


def threshold_for_specificity(df: DataFrame, target: float) -> DataFrame:
    """Largest recall among cuts of at least the target specificity, else the largest specificity.

    Without negatives the specificity is 1, without positives the recall is 0.
    """
    cuts = sweep(df).withColumns({"recall": ratio(F.col("tp"), F.col("P")), "specificity": ratio(F.col("N") - (F.col("np") - F.col("tp")), F.col("N"), 1.0)})
    met = (F.col("specificity") >= target).cast("int")
    order = F.struct(met, F.when(met == 1, F.col("recall")).otherwise(F.col("specificity")), F.col("s"))
    best = cuts.agg(F.max_by(F.struct("s", "recall", "specificity", met.alias("met")), order).alias("b"))
    return best.select((F.col("b.s") - 1e-9).alias("threshold"), "b.recall", "b.specificity", (F.col("b.met") == 1).alias("met"))


def threshold_for_precision(df: DataFrame, target: float) -> DataFrame:
    """Largest recall among cuts of at least the target precision, else the largest precision."""
    cuts = sweep(df).withColumns({"precision": F.col("tp") / F.col("np"), "recall": ratio(F.col("tp"), F.col("P"))})
    met = (F.col("precision") >= target).cast("int")
    order = F.struct(met, F.when(met == 1, F.col("recall")).otherwise(F.col("precision")), F.col("s"))
    best = cuts.agg(F.max_by(F.struct("s", "precision", "recall", met.alias("met")), order).alias("b"))
    return best.select((F.col("b.s") - 1e-9).alias("threshold"), "b.precision", "b.recall", (F.col("b.met") == 1).alias("met"))


def brier(df: DataFrame) -> DataFrame:
    return usable(df).agg(F.avg((F.col("s") - F.col("y")) * (F.col("s") - F.col("y"))).alias("brier"))


def _edges(df: DataFrame, bins: int) -> DataFrame:
    spark = df.sparkSession
    return F.broadcast(spark.createDataFrame([(i, i / bins, (i + 1) / bins) for i in range(bins)], "bin int, lo double, hi double"))  # `bins` rows


def calibration_bins(df: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, mean score and positive rate of each bin; the first is closed, the others left-open."""
    inside = ((F.col("bin") == 0) & (F.col("s") >= F.col("lo")) & (F.col("s") <= F.col("hi"))) | ((F.col("bin") > 0) & (F.col("s") > F.col("lo")) & (F.col("s") <= F.col("hi")))
    joined = usable(df).join(_edges(df, bins), inside)
    return joined.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("sum_s"), F.sum("y").alias("sum_y"))


def expected_calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    total = usable(df).agg(F.count(F.lit(1)).alias("rows"))
    gaps = calibration_bins(df, bins).agg(F.sum(F.abs(F.col("sum_y") - F.col("sum_s"))).alias("gap"))
    return gaps.crossJoin(total).select(F.try_divide(F.col("gap"), F.col("rows")).alias("ece"))  # one row each


def precision_at(df: DataFrame, ks: list[int], tie: str = "id") -> DataFrame:
    """Part of positives among the k largest scores, ties by id; a k beyond the rows is left out."""
    top = usable(df).orderBy(F.desc("s"), tie).limit(max(ks)).select("y", "s", tie)
    from pyspark.sql.window import Window

    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("s"), tie)))  # max(ks) rows
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    return ranked.join(wanted, F.col("r") <= F.col("k")).groupBy("k").agg(F.avg("y").alias("precision"), F.count(F.lit(1)).alias("n")).where("n = k").select("k", "precision")


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen in truth or prediction."""
    votes = df.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("v")).select("v.*")
    counted = votes.where(F.col("class").isNotNull()).groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("n_pred"), F.sum("hit").alias("tp"))
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("support"))
    return counted.withColumns({"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)})


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return per_class(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"), F.count(F.lit(1)).alias("n_classes"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, classes: list) -> DataFrame:
    """Counts of every pair of classes, zeros included."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in classes for b in classes], f"truth {dict(df.dtypes)[truth]}, predicted {dict(df.dtypes)[predicted]}")
    counted = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counted, ["truth", "predicted"], "left").na.fill(0, ["n"])


def one_vs_rest_auroc(df: DataFrame, truth: str, scores: dict[object, Column]) -> DataFrame:
    """AUROC of each class's own score against all other classes."""
    arms = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(truth) == F.lit(c)).cast("int").alias("y"), s.cast("double").alias("s")) for c, s in scores.items()])
    return auroc(df.select(F.explode(arms).alias("a")).select("a.*"), ["class"])


def detection_by_category(df: DataFrame, category: str, clean: object, threshold: float) -> DataFrame:
    """Per error category: recall at a threshold, mean score and AUROC against all clean rows."""
    errors = [r[0] for r in df.where((F.col(category) != clean) & F.col(category).isNotNull()).select(category).distinct().orderBy(category).collect()]  # the taxonomy's few categories
    arms = df.withColumn("slice", F.when(F.col(category) == clean, F.array(*[F.lit(c) for c in errors])).otherwise(F.array(category))) if errors else df.withColumn("slice", F.array(F.col(category)))
    rows = arms.select(F.explode("slice").alias("slice"), (F.col(category) != clean).cast("int").alias("y"), "s")
    own = rows.where("y = 1").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("s") > threshold).cast("double")).alias("recall"), F.avg("s").alias("mean_s"))
    return own.join(auroc(rows, ["slice"]).select("slice", "auroc"), "slice", "left")


def pr_curve(df: DataFrame) -> DataFrame:
    return sweep(df).select("s", ratio(F.col("tp"), F.col("P")).alias("recall"), (F.col("tp") / F.col("np")).alias("precision"))


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """Rows per label in equal bins of [low, high]; the last bin is closed, values outside are left out."""
    inside = df.where(F.col(column).between(low, high))
    at = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy("y", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def compare_methods(frames: dict[str, DataFrame], metric: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One metric over several frames, with the name of each in `method`."""
    out = None
    for name, frame in frames.items():
        part = metric(frame).withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def fixed_labels(df: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """Support, precision, recall, F1 and one-versus-rest accuracy of every given label, whether or not a row has it."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(v,) for v in labels], f"class {dict(df.dtypes)[truth]}")  # the closed list
    per = per_class(df, truth, predicted).select("class", "support", "n_pred", "tp")
    total = df.agg(F.count(F.lit(1)).alias("n"))
    joined = wanted.join(per, "class", "left").na.fill(0, ["support", "n_pred", "tp"]).crossJoin(F.broadcast(total))  # one row of total
    right = F.col("n") - F.col("support") - F.col("n_pred") + 2 * F.col("tp")
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("support"))
    return joined.select("class", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"), ratio(right, F.col("n")).alias("accuracy"))


def label_summary(fixed: DataFrame) -> DataFrame:
    """Accuracy over all rows and the mean F1 over the labels of `fixed_labels`."""
    hits = F.sum(F.col("recall") * F.col("support"))
    return fixed.agg(ratio(hits, F.sum("support"), None).alias("accuracy"), F.avg("f1").alias("macro_f1"))


def macro_auroc(per: DataFrame) -> DataFrame:
    """Mean AUROC over the classes that have one, and their number."""
    return per.agg(F.avg("auroc").alias("auroc_macro"), F.count("auroc").alias("n_classes"))


def reflow_false_positives(clean: DataFrame, reflow: DataFrame, threshold: float) -> DataFrame:
    """How harmless layout changes score beside real clean rows: AUROC (near 0.5 is wanted), rate above the threshold, means."""
    rows = clean.select("s", F.lit(0).alias("y")).unionByName(reflow.select("s", F.lit(1).alias("y")))
    of = lambda y, c: F.when(F.col("y") == y, c)
    above = (F.col("s") > threshold).cast("double")
    counts = usable(rows).agg(F.count(of(0, F.col("s"))).alias("n_clean"), F.count(of(1, F.col("s"))).alias("n_reflow"), F.avg(of(1, above)).alias("fp_rate"), F.count_if((F.col("y") == 1) & (F.col("s") > threshold)).alias("n_fp"), F.avg(of(1, F.col("s"))).alias("mean_reflow"), F.avg(of(0, F.col("s"))).alias("mean_clean"))
    return counts.crossJoin(auroc(rows).select("auroc"))  # one row each
