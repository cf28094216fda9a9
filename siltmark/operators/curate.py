"""Audit and curation of labelled records: cross-tabs, duplicates, leaks, label recovery, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from siltmark.functions import names, taxonomy
from siltmark.operators.ordered import ranks
from siltmark.session import cut_lineage


def tidy_labels(labels: DataFrame) -> DataFrame:
    """Records with split, category, group, form factor and flags in one spelling."""
    return labels.withColumns({
        "split": taxonomy.clean_split(F.col("split"), F.col("path")),
        "category": taxonomy.clean_category(F.col("category")),
        "group": taxonomy.clean_group(F.col("group")),
        "form_factor": taxonomy.clean_form_factor(F.col("form_factor")),
        "orientation": F.coalesce(F.nullif(F.lower(F.trim("orientation")), F.lit("")), F.lit("unknown")),
        "is_competitor": taxonomy.loose_bool(F.col("is_competitor")),
        "has_boundbox": taxonomy.loose_bool(F.col("has_boundbox")),
    })


def name_metadata(df: DataFrame, name: Column) -> DataFrame:
    return df.withColumns({
        "name_form": names.form_factor(name), "name_orientation": names.orientation(name), "name_kind": names.kind(name),
        "name_competitor": names.is_competitor(name), "name_boundbox": names.has_boundbox(name),
    })


def crosstab(df: DataFrame, label: str, attributes: list[str]) -> DataFrame:
    """(attribute, value, label, n) for every attribute, in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.coalesce(F.col(a).cast("string"), F.lit("")).alias("value")) for a in attributes])
    return df.select(F.col(label).alias("label"), F.explode(cells).alias("c")).groupBy("c.attribute", "c.value", "label").agg(F.count(F.lit(1)).alias("n"))


def duplicate_sets(df: DataFrame, key: str, split: str) -> DataFrame:
    """Sets of rows with one key: size, splits it lies in, and whether it crosses splits."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(split).alias("n_splits"))
    return sets.where("n > 1").withColumn("crosses", F.col("n_splits") > 1)


def representatives(df: DataFrame, key: str, name: Column, keep: list[str]) -> DataFrame:
    """Of the rows of one key the one with the cleanest name."""
    return df.groupBy(key).agg(F.min_by(F.struct(*keep), F.struct(names.clean_score(name), *keep)).alias("r"), F.count(F.lit(1)).alias("n")).select(key, "r.*", "n")


def majority(df: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """Most frequent value of each key; ties go to the one seen first."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counted.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first"))).alias("m")).select(key, F.col(f"m.{value}").alias("majority"), F.col("m.n").alias("votes"))


def leaks(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that lie in more than one split."""
    found = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.countDistinct(split).alias("n_splits"), F.count(F.lit(1)).alias("n"))
    return found.where("n_splits > 1")


def recover_labels(rows: DataFrame, by_name: DataFrame, by_ticket: DataFrame) -> DataFrame:
    """Category by name, else by the majority of the ticket; `label_src` tells which."""
    joined = rows.join(by_name, "name", "left").join(by_ticket, "ticket", "left")
    source = F.when(F.col("named").isNotNull(), "name").when(F.col("majority").isNotNull(), "ticket").otherwise("none")
    return joined.withColumns({"recovered": F.coalesce("named", "majority"), "label_src": source})


def missing_splits(df: DataFrame, category: str, split: str) -> DataFrame:
    """Per category the splits that hold none of its records, in their usual order."""
    have = df.groupBy(category).agg(F.collect_set(split).alias("have"))
    return have.select(category, F.concat_ws(",", F.array_except(F.array(*[F.lit(s) for s in taxonomy.SPLITS]), "have")).alias("missing"))


def unique_names(df: DataFrame, folder: str, name: Column, tie: str, most_rounds: int = 20) -> DataFrame:
    """`df` with `unique_name`: repeated names of a folder get _1, _2, ... before the suffix.

    A name made like that may be another file's own: the later of the two, in the order of own names first
    and then `tie`, is numbered again, until no two names of a folder are equal.
    """
    def numbered(rows: DataFrame) -> DataFrame:
        at = F.row_number().over(Window.partitionBy(folder, "unique_name").orderBy("__made", tie)) - 1
        rows = rows.withColumn("__n", at)
        made = F.concat(names.stem(F.col("unique_name")), F.lit("_"), F.col("__n").cast("string"), F.regexp_extract("unique_name", r".(\.[^.]*)$", 1))
        return rows.withColumns({"unique_name": F.when(F.col("__n") == 0, F.col("unique_name")).otherwise(made), "__made": F.col("__made") + (F.col("__n") > 0).cast("int")}).drop("__n")

    rows = numbered(df.withColumns({"unique_name": name, "__made": F.lit(0)}))
    for _ in range(most_rounds):
        rows = cut_lineage(rows)
        if rows.groupBy(folder, "unique_name").count().where("count > 1").isEmpty():
            return rows.drop("__made")
        rows = numbered(rows)
    raise RuntimeError(f"names still repeat after {most_rounds} rounds")


def controlled(form: Column, orientation: Column, kind: Column, y: Column) -> Column:
    """Clean rows, and errors that are unfolded portrait screenshots."""
    return (y == 0) | ((y == 1) & (form == "unfold") & (orientation == "portrait") & (kind == "screenshot"))


def near_square(aspect: Column) -> Column:
    return aspect.between(0.85, 1.18)


def aspect_bucket(aspect: Column) -> Column:
    return F.when(aspect < 0.5, "<0.5").when(aspect < 0.8, "0.5-0.8").when(aspect < 1.1, "0.8-1.1").when(aspect < 1.5, "1.1-1.5").when(aspect >= 1.5, ">1.5")


def same_resolution(errors: DataFrame, clean: DataFrame, name: str) -> DataFrame:
    """Errors of the clean class's own size (one row of w and h), with `independent`: not named like a capture of a session."""
    return errors.join(F.broadcast(clean), ["w", "h"]).withColumn("independent", ~F.col(name).startswith("Screenshot_"))


def development_pool(rows: DataFrame) -> DataFrame:
    """Real rows of train and val and synthetic rows of train, with `is_real`; a synthetic row has its clean parent's group.

    Synthetic rows without a known parent are groups of their own.
    """
    real = rows.where("source = 'real' AND split IN ('train', 'val')")
    parents = real.where("label = 0").groupBy(names.stem(F.col("name")).alias("parent")).agg(F.min("group").alias("pg"))
    synthetic = rows.where("source = 'synthetic' AND split = 'train'").withColumn("parent", names.synthetic_parent(F.col("name"))).join(parents, "parent", "left")
    grouped = F.coalesce("pg", F.concat(F.lit("synthorphan:"), F.col("sample_id").cast("string")))
    columns = ["sample_id", "name", "category", "label", "group", "is_real"]
    return real.withColumn("is_real", F.lit(True)).select(*columns).unionByName(synthetic.withColumns({"group": grouped, "is_real": F.lit(False)}).select(*columns))


def probe_union(rows: DataFrame, split: str) -> DataFrame:
    """Clean real rows (y = 0) and synthetic errors (y = 1) of one split: a probe whose classes share their sizes."""
    held = rows.where(F.col("split") == split)
    clean = held.where("source = 'real' AND label = 0").withColumns({"y": F.lit(0), "src": F.lit("clean")})
    return clean.unionByName(held.where("source = 'synthetic'").withColumns({"y": F.lit(1), "src": F.lit("synth")}))


def calibration_set(real: DataFrame, synthetic: DataFrame, reflow: DataFrame) -> DataFrame:
    """(method, y): clean real rows, synthetic errors and reflowed clean rows; without any synthetic row the real rows by their label."""
    if synthetic.isEmpty():
        return real.select(F.lit("real_val").alias("method"), F.col("label").alias("y"))
    parts = ((real.where("label = 0"), 0), (synthetic, 1), (reflow, 0))
    first, *rest = [df.select(F.lit("confound_free").alias("method"), F.lit(y).alias("y")) for df, y in parts]
    for part in rest:
        first = first.unionByName(part)
    return first


def remapped_parents(probes: DataFrame, kept: DataFrame, parent: str, order: str) -> DataFrame:
    """Probes whose parent is kept, with `new_parent`: the parent's place among the kept ones, from 0."""
    numbered = ranks(kept.select(parent, order), order, [], parent).select(parent, (F.col("rank") - 1).alias("new_parent"))
    return probes.join(numbered, parent)
