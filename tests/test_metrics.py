import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltmark.operators import bootstrap, decide, metrics
from siltmark.operators.ordered import running_totals


def frame(spark, rows):
    return spark.createDataFrame([(i, y, s) for i, (y, s) in enumerate(rows)], "id long, y int, s double")


def cases():
    r = random.Random(2)
    yield "ties", [(r.randrange(2), r.randrange(8) / 8) for _ in range(300)]
    yield "distinct", [(r.randrange(2), r.random()) for _ in range(300)]
    yield "all tied", [(i % 2, 0.5) for i in range(20)]
    yield "one class", [(1, r.random()) for _ in range(10)]


@pytest.mark.parametrize("name,rows", list(cases()), ids=[n for n, _ in cases()])
def test_against_loops(spark, name, rows):
    df = frame(spark, rows)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auroc = metrics.auroc(df).first().auroc
    if not neg:
        assert auroc is None
    else:
        assert auroc == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))
    cuts = sorted({s for _, s in rows}, reverse=True)
    ap, before, best = 0.0, 0.0, (-1.0, 0.0)
    for cut in cuts:
        tp, n = sum(s >= cut for s in pos), sum(s >= cut for _, s in rows)
        p, r = tp / n, tp / len(pos)
        ap += (r - before) * p
        before = r
        f1 = 2 * p * r / (p + r + 1e-12)
        best = max(best, (f1, cut))
    assert metrics.average_precision(df).first().ap == pytest.approx(ap)
    found = metrics.threshold_max_f1(df).first()
    assert (found.f1, found.threshold) == (pytest.approx(best[0]), pytest.approx(best[1] - 1e-9))


def test_targets_and_fallbacks(spark):
    df = frame(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.2)])
    assert metrics.threshold_for_specificity(df, 0.5).first().asDict() == {"threshold": pytest.approx(0.7 - 1e-9), "recall": 1.0, "specificity": 0.5, "met": True}
    assert not metrics.threshold_for_precision(df, 1.5).first().met
    assert metrics.threshold_for_specificity(frame(spark, [(1, 0.4)]), 0.9).first().specificity == 1.0
    assert metrics.threshold_for_specificity(frame(spark, [(0, 0.4)]), 0.0).first().recall == 0.0


def test_rates_without_rows_of_a_kind(spark):
    none = metrics.rates(metrics.confusion(frame(spark, [(0, 0.1), (0, 0.2)]), F.col("s") > 0.5)).first()
    assert (none.precision, none.recall, none.f1, none.specificity, none.mcc) == (0, 0, 0, 1, None)


def test_missing_scores_are_left_out(spark):
    df = frame(spark, [(1, 0.9), (0, 0.1), (1, None), (0, float("nan"))])
    assert metrics.auroc(df).first().auroc == 1.0
    assert metrics.auroc(frame(spark, [])).first().auroc is None


def test_bins_and_precision_at(spark):
    df = frame(spark, [(0, 0.0), (1, 0.1), (1, 0.3), (0, 0.7), (1, 1.0)])
    bins = {r.bin: r.n for r in metrics.calibration_bins(df).collect()}
    assert bins == {0: 2, 2: 1, 6: 1, 9: 1}
    assert {r.k: r.precision for r in metrics.precision_at(df, [2, 4, 9]).collect()} == {2: 0.5, 4: 0.75}


def test_classes_of_truth_or_prediction(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "d"), (None, "a")], "t string, p string")
    assert {r["class"]: r.f1 for r in metrics.per_class(df, "t", "p").collect()} == {"a": 0.5, "b": 0.0, "c": 0.0, "d": 0.0}


def test_bootstrap_is_resampling(spark):
    r = random.Random(5)
    rows = [(f"g{r.randrange(9)}", r.randrange(2), r.randrange(12) / 12) for _ in range(150)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {x.rep: x.auroc for x in bootstrap.replicates(df, "g", bootstrap.multiplicities(df, "g", 12), 12).collect()}
    names, rng = sorted({g for g, *_ in rows}), np.random.default_rng(0)
    for rep in range(12):
        drawn = [names[i] for i in rng.choice(len(names), size=len(names), replace=True)]
        own = [(y, s) for g in drawn for h, y, s in rows if g == h]
        pos, neg = [s for y, s in own if y], [s for y, s in own if not y]
        assert got[rep] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)))


def test_routing_truth_table(spark):
    nan = float("nan")
    rows = [(1.0, 0.6, 0.1, 0.6, True), (1.0, 0.59, 0.9, 0.6, False), (0.85, 0.6, 0.0, 0.6, True), (1.18, 0.1, 0.9, 0.6, False), (1.19, 0.1, 0.9, 0.6, True), (1.0, 0.9, 0.5, nan, False), (None, 0.9, 0.51, 0.6, True), (1.0, 0.1, 0.51, None, True)]
    df = spark.createDataFrame(rows, "a double, s double, p double, f double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", decide.gate(F.col("a"), F.col("s"), F.col("p"), F.lit(0.5), F.col("f"))).collect())


def test_logistic_fit_minimises_its_objective(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 2))
    y = (x @ [1.5, -0.5] + r.normal(size=80) > 0).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, y int")
    w, b = decide.logistic_fit(df, ["a", "b"], "y")
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-2 and abs((p - y).sum()) < 1e-2


def test_running_totals(spark):
    r = random.Random(3)
    rows = {(g, k): r.randrange(5) for g in "ab" for k in r.sample(range(1000), 200)}
    df = spark.createDataFrame([(g, float(k), n) for (g, k), n in rows.items()], "g string, k double, n long")
    for descending in (False, True):
        for x in running_totals(df, "k", ["n"], ["g"], descending).collect():
            assert x.run_n == sum(n for (g, k), n in rows.items() if g == x.g and (k >= x.k if descending else k <= x.k))
    assert running_totals(df.where("false"), "k", ["n"]).count() == 0


def test_fold_threshold_needs_rows(spark):
    df = spark.createDataFrame([(0, 1.0, i / 10) for i in range(7)], "y int, aspect double, s double")
    assert decide.fold_threshold(df, 0.9).first().threshold is None
    assert math.isclose(decide.fold_threshold(df.union(df), 0.5).first().threshold, 0.3)
