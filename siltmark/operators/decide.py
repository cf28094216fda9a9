"""Two-stage decisions: fusion of scores, routing by aspect, gate, category."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from siltmark.functions.vectors import dot, sigmoid
from siltmark.operators.curate import near_square
from siltmark.operators.ordered import quantiles


def fused(score: Column, aux: Column, c0: float, c1: float, bias: float) -> Column:
    return sigmoid(c0 * score + c1 * aux + bias)


def gate(aspect: Column, score: Column, p: Column, threshold: Column, fold_threshold: Column) -> Column:
    """Near-square screens pass from the fold threshold on (`>=`), others above the threshold (`>`).

    A null or NaN fold threshold never routes.
    """
    routed = near_square(F.coalesce(aspect, F.lit(0.0))) & fold_threshold.isNotNull() & ~F.isnan(fold_threshold)
    return F.when(routed, score >= fold_threshold).otherwise(p > threshold)


def outcome(y: Column, passed: Column) -> Column:
    return F.when((y == 1) & passed, "TP").when((y == 0) & ~passed, "TN").when(y == 0, "FP").otherwise("FN")


def fold_threshold(df: DataFrame, quantile: float, least_rows: int = 8) -> DataFrame:
    """Linear quantile of the clean scores of near-square rows; null below `least_rows` rows."""
    clean = df.where((F.col("y") == 0) & near_square(F.col("aspect")) & F.col("s").isNotNull())
    found = quantiles(clean, "s", [quantile])
    return found.agg(F.max(F.when(F.col("n") >= least_rows, F.col("q")[0])).alias("threshold"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def multinomial_fit(df: DataFrame, vector: str, label: str) -> tuple[dict[int, list[float]], dict[int, float]]:
    """(coefficients, bias) per class of a multinomial logistic regression, every class weighing the same.

    A class weighs the number of rows over classes and rows of the class; the penalty is half the squared weights.
    """
    data = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    counts = data.groupBy("label").agg(F.count(F.lit(1)).alias("k"))
    rows = counts.collect()  # one row per class of the taxonomy
    n = sum(r.k for r in rows)
    weighted = data.join(F.broadcast(counts), "label").withColumn("weight", F.lit(float(n)) / (len(rows) * F.col("k")))
    model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=1e-8, maxIter=300).fit(weighted)
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    classes = sorted(int(r.label) for r in rows)
    return {c: matrix[c].tolist() for c in classes}, {c: float(bias[c]) for c in classes}


def multinomial_class(vector: Column, coefficients: dict[int, list[float]], bias: dict[int, float]) -> Column:
    """The class of the largest logit, ties to the smaller class."""
    logit = lambda c: dot(vector, F.array(*[F.lit(v) for v in coefficients[c]])) + F.lit(bias[c])
    options = F.array(*[F.struct(logit(c).alias("s"), F.lit(-c).alias("c")) for c in coefficients])
    return -F.array_max(options)["c"]


def logistic_fit(df: DataFrame, features: list[str], y: str, balanced: bool = False) -> tuple[list[float], float]:
    """Coefficients and bias that minimise the summed loss plus half the squared weights.

    `balanced` weights both classes alike. The bias is not penalised.
    """
    n, positive = df.agg(F.count(F.lit(1)), F.sum(y)).first()
    data = VectorAssembler(inputCols=features, outputCol="features").transform(df.select(*features, F.col(y).cast("double").alias("label")))
    weight = {}
    if balanced:
        data = data.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * max(positive, 1))).otherwise(n / (2.0 * max(n - positive, 1))))
        weight = {"weightCol": "weight"}
    model = LogisticRegression(regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False, tol=1e-9, maxIter=300, **weight).fit(data)
    return list(model.coefficients), float(model.intercept)


__all__ = ["fold_threshold", "fused", "gate", "logistic_fit", "multinomial_class", "multinomial_fit", "outcome"]
