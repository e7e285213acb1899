"""Vector functions on arrays of numbers, as column expressions; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for vectors of different length or without length, null if either is null."""
    scale = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)
    return F.when(a.isNotNull() & b.isNotNull(), value)


def normalize(v: Column) -> Column:
    """The unit vector; a vector without length stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(x))


def quantize(v: Column) -> Column:
    """8-bit affine code: struct(dims, scale, min, data). Equal components give scale 0 and zeros."""
    d = doubles(v)
    low, high = F.array_min(d), F.array_max(d)
    span = high - low
    data = F.transform(d, lambda x: F.when(span > 0, F.round((x - low) * 255 / F.nullif(span, F.lit(0.0)))).otherwise(0.0).cast("smallint"))
    return F.when(v.isNotNull() & (F.size(v) > 0), F.struct(F.size(v).alias("dims"), (span / 255).alias("scale"), low.alias("min"), data.alias("data")))


def dequantize(q: Column) -> Column:
    return F.transform(q["data"], lambda x: x * q["scale"] + q["min"])


def quantized_dot(q: Column, v: Column) -> Column:
    """The dot product of a code and a plain vector, without decoding: scale * sum(d v) + min * sum(v)."""
    d = doubles(v)
    return q["scale"] * total(F.zip_with(q["data"].cast("array<double>"), d, lambda x, y: x * y)) + q["min"] * total(d)


def quantized_cosine(q: Column, v: Column) -> Column:
    """Cosine of a code and a plain vector; 0 for different lengths or no length."""
    data = q["data"].cast("array<double>")
    squares = q["scale"] * q["scale"] * total(F.transform(data, lambda x: x * x)) + 2 * q["scale"] * q["min"] * total(data) + q["dims"] * q["min"] * q["min"]
    scale = F.sqrt(F.greatest(squares, F.lit(0.0))) * norm(v)
    return F.when((q["dims"] == F.size(v)) & (scale > 0), quantized_dot(q, v) / F.nullif(scale, F.lit(0.0))).otherwise(0.0)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of those vectors whose mask is 1; null if none is."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    first = F.transform(F.element_at(kept, 1)["v"].cast("array<double>"), lambda x: F.lit(0.0))
    summed = F.aggregate(kept, first, lambda a, x: F.zip_with(a, x["v"].cast("array<double>"), lambda p, q: p + q))
    return F.when(F.size(kept) > 0, F.transform(summed, lambda x: x / F.size(kept)))
