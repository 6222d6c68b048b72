"""Vector functions over arrays, inside the JVM; sums run from the first component on, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many components a product is written out, which generated code runs faster than a fold.
UNROLLED = 128


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    """Inner product; 0 where lengths differ. dim: a known common length lets it be written out."""
    if dim is not None and dim <= UNROLLED:
        total = F.lit(0.0)
        for i in range(dim):
            total = total + F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double")
        return F.when((F.size(a) == dim) & (F.size(b) == dim), total).otherwise(0.0)
    folded = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), folded).otherwise(0.0)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector is unchanged."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length == 0, v).otherwise(F.transform(v, lambda x: (x / length).cast("float")))


def is_finite(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))


def hash_encode(text: Column, dim: int) -> Column:
    """Unit vector of word counts: words (lower case, split at white space) by FNV-1a over code points, modulo dim."""
    words = F.filter(F.split(F.lower(text), r"\p{IsWhite_Space}+"), lambda w: w != "")
    chars = lambda w: F.filter(F.split(w, ""), lambda c: c != "")
    # Offset basis and prime of 32-bit FNV-1a.
    fnv = lambda w: F.aggregate(chars(w), F.lit(2166136261), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619) % 4294967296)
    slots = F.transform(words, lambda w: (fnv(w) % dim).cast("int"))
    none = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.aggregate(slots, none, lambda a, s: F.transform(a, lambda x, i: F.when(i == s, x + F.lit(1.0).cast("float")).otherwise(x)), normalize)
