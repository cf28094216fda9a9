"""Group-atomic splits, folds and holdouts.

The fills are sequential over groups by definition, so the table of groups (never the rows) comes to
the driver, behind a check of its size; the assignment is joined back.
"""

from __future__ import annotations

import random
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.operators.curate import majority
from siltmark.operators.ordered import ranks

MOST_GROUPS = 1_000_000


def _groups(df: DataFrame, limit: int = MOST_GROUPS) -> list:
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} groups")
    return rows


def _back(df: DataFrame, group: str, placed: dict, column: str, kind: str) -> DataFrame:
    spark = df.sparkSession
    table = spark.createDataFrame(list(placed.items()), f"`{group}` {dict(df.dtypes)[group]}, `{column}` {kind}")
    return df.drop(column).join(table, group)


def stratified_assignment(groups: list[tuple[object, object, int]], val_frac: float, test_frac: float, seed: int) -> dict:
    """group -> split for (group, stratum, size): per stratum the largest group to the largest deficit.

    One random stream serves all strata in the order of their names; ties go to train, val, test.
    """
    rng = random.Random(seed)
    strata = defaultdict(dict)
    for group, stratum, size in groups:
        strata[stratum][group] = size
    shares = {"train": max(0.0, 1.0 - val_frac - test_frac), "val": val_frac, "test": test_frac}
    placed = {}
    for stratum in sorted(strata, key=str):
        sizes = strata[stratum]
        order = sorted(sizes)
        rng.shuffle(order)
        total = sum(sizes.values())
        lacking = {split: share * total for split, share in shares.items()}
        for group in sorted(order, key=lambda g: -sizes[g]):
            split = max(("train", "val", "test"), key=lacking.__getitem__)
            lacking[split] -= sizes[group]
            placed[group] = split
    return placed


def grouped_stratified_split(df: DataFrame, group: str, stratum: str, position: str, val_frac: float = 0.15, test_frac: float = 0.24, seed: int = 42) -> DataFrame:
    """`df` with `split`; rows without a group are left out."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    table = sizes.join(majority(df, group, stratum, position), group)
    placed = stratified_assignment([(r[group], r.majority, r.n) for r in _groups(table.select(group, "majority", "n"))], val_frac, test_frac, seed)
    return _back(df, group, placed, "split", "string")


def deficit_assignment(groups: list[tuple[object, int]], shares: dict[str, float], seed: int) -> dict:
    """group -> split in a seeded order, whatever the sizes: each to the split that lacks most."""
    sizes = dict(groups)
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    lacking = {split: share * sum(sizes.values()) for split, share in shares.items()}
    placed = {}
    for group in order:
        split = max(lacking, key=lacking.__getitem__)
        lacking[split] -= sizes[group]
        placed[group] = split
    return placed


def grouped_deficit_fill(df: DataFrame, group: str, shares: dict[str, float], seed: int) -> DataFrame:
    sizes = _groups(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    return _back(df, group, deficit_assignment([(r[group], r.n) for r in sizes], shares, seed), "split", "string")


def kfold_assignment(groups: list[tuple[object, int]], folds: int, seed: int) -> dict:
    """group -> fold: the largest group to the emptiest fold, ties by a seeded shuffle."""
    sizes = dict(groups)
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    load, placed = [0] * folds, {}
    for group in sorted(order, key=lambda g: -sizes[g]):
        fold = load.index(min(load))
        placed[group] = fold
        load[fold] += sizes[group]
    return placed


def grouped_kfold(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    sizes = _groups(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    return _back(df, group, kfold_assignment([(r[group], r.n) for r in sizes], folds, seed), "fold", "int")


def grouped_holdout(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """`df` with `held`: whole groups in a seeded order until the fraction of rows is reached."""
    sizes = {r[group]: r.n for r in _groups(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))}
    order = sorted(sizes)
    random.Random(seed).shuffle(order)
    target, count, placed = int(round(sum(sizes.values()) * fraction)), 0, {}
    for g in order:
        placed[g] = count < target
        count += sizes[g] if placed[g] else 0
    return _back(df, group, placed, "held", "boolean")


def app_partition(df: DataFrame, app: str, val_apps: int, test_apps: int, seed: int) -> DataFrame:
    """`df` with `split`: in a seeded order of the applications the first are val, the next test, the rest train.

    Rows without an application are left out.
    """
    apps = df.where(F.col(app).isNotNull()).select(app).distinct()
    order = Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(app))), app)
    # the first applications only: the limit comes before the window
    first = apps.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(app))), app).limit(val_apps + test_apps).withColumn("__r", F.row_number().over(order))
    named = first.select(app, F.when(F.col("__r") <= val_apps, "val").otherwise("test").alias("__split"))
    joined = df.where(F.col(app).isNotNull()).drop("split").join(F.broadcast(named), app, "left")
    return joined.withColumn("split", F.coalesce("__split", F.lit("train"))).drop("__split")


def even_folds(df: DataFrame, key: str, stratum: str, folds: int, seed: int = 0) -> DataFrame:
    """`df` with `fold`: in the order of a hash the rows of each stratum are dealt out in turn, so folds differ by one row at most."""
    drawn = df.withColumn("__draw", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return ranks(drawn, "__draw", [stratum], key).withColumn("fold", ((F.col("rank") - 1) % folds).cast("int")).drop("rank", "__draw")


def complete_folds(df: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    """`scored`, checked: every key of `df` once and no other; a row that is missing or repeated fails the query."""
    counted = df.select(key).withColumn("__want", F.lit(1)).unionByName(scored.select(key).withColumn("__want", F.lit(-1))).groupBy(key).agg(F.sum("__want").alias("__off")).where("__off <> 0")
    wrong = counted.agg(F.count(F.lit(1)).alias("__wrong"))
    checked = wrong.select(F.assert_true(F.col("__wrong") == 0, F.lit("out-of-fold rows are not complete")).alias("__ok"))
    return scored.crossJoin(F.broadcast(checked)).where(F.col("__ok").isNull()).drop("__ok")  # one row


def permuted_labels(df: DataFrame, stratum: str, label: str, key: str, seed: int) -> DataFrame:
    """`df` with `placebo`: the labels of each stratum dealt out again in hash order."""
    here = ranks(df, key, [stratum], key).withColumnRenamed("rank", "__at")
    drawn = df.select(F.col(key), F.col(stratum), F.col(label).alias("placebo"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("__draw"))
    there = ranks(drawn, "__draw", [stratum], key).select(stratum, "placebo", F.col("rank").alias("__at"))
    return here.join(there, [stratum, "__at"]).drop("__at")
