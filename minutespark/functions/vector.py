"""Vectors as arrays of numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    """The norm, or 1 for a zero vector."""
    n = F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def l2_normalize(v: Column) -> Column:
    n = l2_norm(v)
    return F.transform(as_double(v), lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null where a vector is zero."""
    norms = F.sqrt(F.aggregate(as_double(a), F.lit(0.0), lambda s, x: s + x * x)) * F.sqrt(F.aggregate(as_double(b), F.lit(0.0), lambda s, x: s + x * x))
    return dot(a, b) / F.nullif(norms, F.lit(0.0))


def literal(v: Sequence[float]) -> Column:
    """A constant vector, folded into the plan."""
    return F.from_json(F.lit("[" + ",".join(repr(float(x)) for x in v) + "]"), "array<double>")


def to_text(v: Column) -> Column:
    """``[0.12345678, ...]``: eight decimals, halves to even as in C (%.8f is Java's here and rounds them up)."""
    finite = lambda x: F.abs(x) < F.lit(float("inf"))
    digits = lambda x: F.when(finite(x), F.call_function("format_number", x, F.lit("0.00000000"))).otherwise(F.format_string("%.8f", x))
    return F.concat(F.lit("["), F.array_join(F.transform(as_double(v), digits), ", "), F.lit("]"))


def from_text(x: Column) -> Column:
    return F.from_json(x, "array<float>")


def has_dim(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))


def trigrams(x: Column) -> Column:
    """Distinct groups of three characters of the lower-case words, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(F.lit(0.0))
