"""Column functions on vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def signed_cosine(a: Column, b: Column) -> Column:
    d = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (d > 0), dot(a, b) / d).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Clipped to 0 … 1; 0 for vectors that can't be compared."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), signed_cosine(a, b)))


def centred(a: Column) -> Column:
    # The mean is handed in as an array, or it would be computed anew for each component.
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    return F.zip_with(a, F.array_repeat(mean, F.size(a)), lambda x, m: x.cast("double") - m)


def hist_corr(a: Column, b: Column) -> Column:
    """Pearson's correlation clipped at 0; 0 for constant vectors."""
    return F.greatest(F.lit(0.0), signed_cosine(centred(a), centred(b)))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two pairs of 32-bit words; 64 when one is missing."""
    word = lambda i: F.bit_count((F.get(a, i).cast("bigint").bitwiseXOR(F.get(b, i).cast("bigint"))).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.coalesce(word(0) + word(1), F.lit(64))


def half_up(c: Column) -> Column:
    return F.floor(c + F.lit(0.5)).cast("int")


def degrees_apart(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def dhash_sim(distance: Column) -> Column:
    """1 up to 6 differing bits, 0 from 22 on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (22 - distance) / F.lit(16.0)))
