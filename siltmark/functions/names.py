"""Column expressions on file names and paths of captures (metadata, keys, normal forms)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Extensions of image files and the words that names carry, typing errors included.
EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp")
FORM_FACTOR = r"(unfold|fold|laptop|tent|desktop|unidentif[a-z0-9_]*)"
ORIENTATION = r"(portrait|portrair|landscape)"
KIND = r"(screenshot|screeshot|photo)"
TICKET = r"(?i)(IKSWW[-_][0-9]+)"
DOUBLE_EXTENSION = r"(?i)\.(png|jpe?g)\.(png|jpe?g)$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """The name without its last suffix; names like `.png` keep all."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)$", 1))


def is_image(name: Column) -> Column:
    return F.substring(suffix(name), 2, 10).isin(*EXTENSIONS)


def form_factor(name: Column) -> Column:
    found = F.regexp_extract(F.lower(name), FORM_FACTOR, 1)
    return F.when(found == "", "unknown").when(found.startswith("unidentif"), "unidentified").otherwise(found)


def orientation(name: Column) -> Column:
    found = F.regexp_extract(F.lower(name), ORIENTATION, 1)
    return F.when(found == "", "unknown").when(found == "portrair", "portrait").otherwise(found)


def kind(name: Column) -> Column:
    return F.when(F.regexp_extract(F.lower(name), KIND, 1) == "photo", "photo").otherwise("screenshot")


def is_competitor(name: Column) -> Column:
    return F.lower(name).contains("competitor")


def has_boundbox(name: Column) -> Column:
    return F.lower(name).contains("boundbox") | F.lower(name).contains("bound_box")


def ticket(name: Column) -> Column:
    """`IKSWW-<number>` in upper case, null where the name has none."""
    found = F.upper(F.regexp_replace(F.regexp_extract(name, TICKET, 1), "_", "-"))
    return F.nullif(found, F.lit(""))


def group_key(name: Column, source: Column) -> Column:
    return F.coalesce(ticket(name), F.concat(source, F.lit(":"), stem(name)))


def shot_stamp(name: Column) -> Column:
    """`YYYYMMDDHHMMSS` of the capture, null where the name has none."""
    return F.nullif(F.concat(F.regexp_extract(name, r"([0-9]{8})[_-]([0-9]{6})", 1), F.regexp_extract(name, r"([0-9]{8})[_-]([0-9]{6})", 2)), F.lit(""))


def shot_time(name: Column) -> Column:
    """Capture time, null where there is none or it is no valid time."""
    return F.try_to_timestamp(shot_stamp(name), F.lit("yyyyMMddHHmmss"))


def ticket_or_session(name: Column) -> Column:
    return F.coalesce(ticket(name), F.concat(F.lit("shot:"), shot_stamp(name)), F.concat(F.lit("file:"), stem(name)))


def normalize_name(name: Column) -> Column:
    """One extension in lower case, no copy mark such as ` (1)`."""
    one = F.regexp_replace(name, r"(?i)\.(png|jpe?g)(\.(png|jpe?g))+$", ".$1")
    return F.concat(F.trim(F.regexp_replace(stem(one), r"\s*\([0-9]+\)\s*$", "")), suffix(one))


def clean_score(name: Column) -> Column:
    """Orders the names of equal files: the smallest is the best representative."""
    return F.struct(name.rlike(DOUBLE_EXTENSION).cast("int").alias("double_ext"), name.rlike(r"\([0-9]+\)").cast("int").alias("copy"), F.length(name).alias("length"), name.alias("name"))


def app_key(name: Column) -> Column:
    return F.split_part(name, F.lit("_"), F.lit(1))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by `-`; `x` for texts without any."""
    body = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(body == "", "x").otherwise(body)


def synthetic_parent(name: Column) -> Column:
    """Stem of the parent in `<parent>__<operators>__v<n>`; stems may hold `__` themselves."""
    return F.nullif(F.regexp_extract(stem(name), r"^(.*)__([a-z_+]+)__v([0-9]+)$", 1), F.lit(""))


def synthetic_operators(name: Column) -> Column:
    return F.nullif(F.regexp_extract(stem(name), r"^(.*)__([a-z_+]+)__v([0-9]+)$", 2), F.lit(""))
