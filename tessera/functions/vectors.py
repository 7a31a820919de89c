"""Vector expressions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.functions.text import clean

DIGEST_BYTES = 32


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Deterministic vector: bytes of successive SHA-256 digests scaled to [-1, 1].

    Blank text gives null, so a missing vector stays visible.
    """
    if dim < 1:
        raise ValueError("dim must be positive")
    blocks = -(-dim // DIGEST_BYTES)

    def vector(value: Column) -> Column:
        digests = F.concat(*[F.sha2(F.concat(value, F.lit(f"|{i}")), 256) for i in range(blocks)])
        hexes = F.slice(F.regexp_extract_all(digests, F.lit(".."), F.lit(0)), 1, dim)
        scaled = F.transform(
            hexes, lambda h: F.conv(h, 16, 10).cast("double") / F.lit(255.0) * F.lit(2.0) - F.lit(1.0)
        )
        return F.when(value != "", scaled)

    return let(clean(text), vector)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 for missing, empty, zero or differently sized vectors."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    length = norm(a) * norm(b)
    return F.when(usable & (length > 0), dot(a, b) / length).otherwise(F.lit(0.0))


def is_embedded(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def to_double(value: Column, default: float) -> Column:
    """Cast that yields the default instead of failing."""
    return F.coalesce(value.try_cast("double"), F.lit(float(default)))
