"""Vector arithmetic on array columns, accumulated in double precision inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    # the length is bound by an outer lambda: in the inner one it would be computed for every number
    scaled = F.transform(F.array(norm(a)), lambda length: F.transform(a, lambda x: x.cast("double") / F.when(length > 0, length).otherwise(F.lit(1.0))))
    return scaled[0]


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    shifted = F.transform(a, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda x: x / total)


def pair_features(a: Column, b: Column) -> Column:
    """`[a, b, |a - b|, a * b]` of a pair of vectors."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: x * y))


def pad_fraction(w: Column, h: Column) -> Column:
    side = F.greatest(w, h).cast("double")
    return 1 - F.try_divide(w.cast("double") * h.cast("double"), side * side)


def content_mask(w: Column, h: Column, size: int = 518, patch: int = 14) -> Column:
    """Row-major mask of the patches whose centre lies in the content of a padded square."""
    n = size // patch
    side = F.greatest(w, h).cast("double")
    cw, ch = size * w.cast("double") / side, size * h.cast("double") / side
    x0, y0 = (size - cw) / 2, (size - ch) / 2
    centre = lambda k: (k.cast("double") + 0.5) * patch
    inside = lambda k: centre(F.floor(k / n)).between(y0, y0 + ch) & centre(k % n).between(x0, x0 + cw)
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda k: F.when(w == h, F.lit(True)).otherwise(inside(k)))
