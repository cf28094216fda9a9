"""Evaluation of scored rows as one long table, and its Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siltmark.operators import bootstrap, metrics

LONG = ("block", "metric", "slice", "value")


def long_rows(df: DataFrame, block: str, names: list[str], slice_: Column | None = None) -> DataFrame:
    """One row per metric column of `df`."""
    cells = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return df.select(F.lit(block).alias("block"), (slice_ if slice_ is not None else F.lit("all")).cast("string").alias("slice"), F.explode(cells).alias("c")).select("block", "c.metric", "slice", "c.value")


def evaluate(scored: DataFrame, threshold: float, category: str | None = None, clean: object = None, bins: int = 10) -> DataFrame:
    """Ranking, calibration, operating point and, where a category is given, detection per category."""
    blocks = [
        long_rows(metrics.auroc(scored), "ranking", ["auroc", "n_pos", "n_neg"]),
        long_rows(metrics.average_precision(scored), "ranking", ["ap"]),
        long_rows(metrics.brier(scored), "calibration", ["brier"]),
        long_rows(metrics.expected_calibration_error(scored, bins), "calibration", ["ece"]),
        long_rows(metrics.rates(metrics.confusion(metrics.usable(scored), F.col("s") > threshold)), "operating_point", ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy", "mcc"]),
        long_rows(metrics.threshold_max_f1(scored), "threshold_max_f1", ["threshold", "f1"]),
    ]
    if category:
        blocks.append(long_rows(metrics.detection_by_category(scored, category, clean, threshold), "detection", ["n", "recall", "mean_s", "auroc"], F.col("slice")))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.select(*LONG)


def with_interval(scored: DataFrame, group: str, reps: int, seed: int = 0) -> DataFrame:
    """The grouped bootstrap interval of the AUROC as long rows."""
    values = bootstrap.replicates(scored, group, bootstrap.multiplicities(scored, group, reps, seed), reps)
    return long_rows(bootstrap.interval(values, "auroc"), "bootstrap_auroc", ["mean", "ci_lo", "ci_hi"]).select(*LONG)


def detection_intervals(scored: DataFrame, category: str, clean: object, group: str, draws: DataFrame, reps: int) -> DataFrame:
    """(slice, n_reps, mean, ci_lo, ci_hi) of the AUROC of every error category against all clean rows."""
    errors = [r[0] for r in scored.where((F.col(category) != clean) & F.col(category).isNotNull()).select(category).distinct().orderBy(category).collect()]  # the taxonomy's few categories
    out = None
    for name in errors:
        rows = scored.where(F.col(category).isin(name, clean)).withColumn("y", (F.col(category) != clean).cast("int"))
        part = bootstrap.interval(bootstrap.replicates(rows, group, draws, reps), "auroc").withColumn("slice", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else scored.sparkSession.createDataFrame([], "n_reps long, mean double, ci_lo double, ci_hi double, slice string")


def dataset_card(rows: DataFrame, title: str) -> str:
    """Markdown of a dataset: rows by split and source, and categories by split."""
    counts = rows.groupBy("split", "source", "category").agg(F.count(F.lit(1)).alias("n"))
    table = [r.asDict() for r in counts.orderBy("split", "source", "category").collect()]  # splits x sources x categories
    splits = sorted({r["split"] for r in table}, key=lambda s: ({"train": 0, "val": 1, "test": 2}.get(s, 3), str(s)))
    total = lambda **by: sum(r["n"] for r in table if all(r[k] == v for k, v in by.items()))
    lines = [f"# {title}", "", f"{total()} records.", "", "| split | real | synthetic | all |", "|-|-:|-:|-:|"]
    lines += [f"| {s} | {total(split=s, source='real')} | {total(split=s, source='synthetic')} | {total(split=s)} |" for s in splits]
    lines += ["", "| category | " + " | ".join(map(str, splits)) + " |", "|-|" + "-:|" * len(splits)]
    lines += [f"| {c} | " + " | ".join(str(total(category=c, split=s)) for s in splits) + " |" for c in sorted({r["category"] for r in table}, key=str)]
    return "\n".join(lines) + "\n"


def console(rows: DataFrame, digits: int = 3) -> list[str]:
    """Long rows as aligned lines for a terminal."""
    found = rows.orderBy("block", "slice", "metric").collect()  # a report: tens of rows
    width = max((len(f"{r.block}.{r.metric}[{r.slice}]") for r in found), default=0)
    return [f"{r.block}.{r.metric}[{r.slice}]".ljust(width) + ("  –" if r.value is None else f"  {r.value:.{digits}f}") for r in found]


def markdown(rows: DataFrame, title: str, digits: int = 3) -> str:
    """A table per block; metrics that do not exist are shown as a dash."""
    lines = [f"# {title}"]
    seen = None
    for r in rows.orderBy("block", "slice", "metric").toLocalIterator():  # a report: tens of rows
        if r.block != seen:
            seen = r.block
            lines += ["", f"## {r.block}", "", "| slice | metric | value |", "|-|-|-:|"]
        lines.append(f"| {r.slice} | {r.metric} | {'–' if r.value is None else f'{r.value:.{digits}f}'} |")
    return "\n".join(lines) + "\n"


def confound_verdict(controlled: Column, confound: Column, synthetic: Column) -> Column:
    """Signal where the controlled score beats the confound and the synthetic one reaches 0.65."""
    return F.when((controlled > confound) & (synthetic >= 0.65), "signal").when(F.abs(controlled - confound) < 0.05, "undecided").otherwise("confounded")
