"""The closed taxonomy of categories, coarse classes, splits and sources."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Categories in the order of their ids, coarse classes, operators and their categories.
CATEGORIES = ("clean", "black_bars", "disordered_layout", "empty_space", "overlay")
COARSE = {"clean": "clean", "black_bars": "dead_region", "empty_space": "dead_region", "overlay": "displaced_content", "disordered_layout": "displaced_content"}
COARSE_ORDER = ("clean", "dead_region", "displaced_content")
OPERATOR_CATEGORY = {"black_region": "black_bars", "empty_space": "empty_space", "overlay": "overlay", "disorder": "disordered_layout", "cropped": None}
SPLITS = ("train", "val", "test")
ABSTAIN = -1


def lookup(key: Column, table: dict) -> Column:
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def clean_category(category: Column) -> Column:
    """Category name whatever its case, blanks and separators; blank and null are `clean`."""
    name = F.regexp_replace(F.lower(F.trim(F.coalesce(category, F.lit("")))), "[ -]", "_")
    return F.when(name == "", "clean").otherwise(name)


def category_id(category: Column, strict: bool = False) -> Column:
    """Id of a category; unknown names are ABSTAIN, never clean, or an error if strict."""
    known = lookup(category, {c: i for i, c in enumerate(CATEGORIES)})
    unknown = F.raise_error(F.concat(F.lit("unknown category: "), category)).cast("int") if strict else F.lit(ABSTAIN)
    return F.when(known.isNull(), unknown).otherwise(known)


def coarse_of(category: Column) -> Column:
    return lookup(category, COARSE)


def clean_split(split: Column, path: Column) -> Column:
    own = F.lower(F.trim(split))
    return F.coalesce(F.nullif(own, F.lit("")), F.lower(F.split_part(path, F.lit("/"), F.lit(1))))


def clean_form_factor(form: Column) -> Column:
    name = F.lower(F.trim(F.coalesce(form, F.lit(""))))
    return F.when(name == "", "unknown").when(name.startswith("unidentif"), "unidentified").otherwise(name)


def clean_group(group: Column) -> Column:
    """Group name without case, blanks, invisible characters and the separator in a ticket; blank and null name none."""
    bare = F.regexp_replace(F.lower(group), r"[\s\u00a0\u200b\ufeff]+", "")
    return F.nullif(F.regexp_replace(bare, r"^iksww[-_]*(?=[0-9])", "iksww-"), F.lit(""))


def loose_bool(flag: Column) -> Column:
    """`true` in any case is true; everything else, null and blank included, is false."""
    return F.coalesce(F.lower(F.trim(flag)) == "true", F.lit(False))
