"""Vector expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scaled(similarity: Column) -> Column:
    """From -1..1 to 0..1, the scale of all thresholds."""
    return (1 + similarity) / 2


def hashed_embedding(words: Column, dimensions: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: counts of words by hash, made to length 1."""
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(F.lower(w)), F.lit(dimensions)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0).cast("float"))
