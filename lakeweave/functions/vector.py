"""Dense vectors as arrays: dot product, norm, cosine, padding, hashed bag of words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length and for those without length."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (lengths == 0), 0.0).otherwise(dot(a, b) / lengths)


def resized(a: Column, n: int) -> Column:
    """Cut, or filled up with zeros."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0).cast("float"), n)), 1, n)


def from_text(text: Column) -> Column:
    return F.from_json(text, "array<float>")


def hashed_words(words: Column, dimensions: int) -> Column:
    """Signed hashed bag of words with length 1: of each word's SHA-256, four bytes choose the place, one the sign, one the weight."""
    digest = lambda w: F.sha2(F.lower(w), 256)
    number = lambda w, at, n: F.conv(F.substring(digest(w), at, n), 16, 10).cast("long")
    signed = lambda w: F.when(number(w, 9, 2) % 2 == 0, 1.0).otherwise(-1.0) * (1.0 + number(w, 11, 2) / 255.0)
    placed = F.transform(words, lambda w: F.struct((number(w, 1, 8) % dimensions).alias("k"), signed(w).alias("x")))
    raw = let(placed, lambda ps: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.aggregate(F.filter(ps, lambda p: p["k"] == k), F.lit(0.0), lambda s, p: s + p["x"])))
    return let(raw, lambda v: let(norm(v), lambda length: F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(0.0))))
