"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Of unit vectors, their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """P20: divided by its length; a zero vector stays.

    The length is put beside each component, so that it is worked out once and not in the function for each of them.
    """
    n = F.coalesce(F.nullif(norm(v), F.lit(0.0)), F.lit(1.0))
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x / m)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def truncated(v: Column, dim: int) -> Column:
    """The first components, of length one again."""
    return unit(F.slice(v, 1, dim))


def dim_ranges(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(dim, low, high) of each component."""
    return vectors.select(F.posexplode(doubles(F.col(vec))).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def range_arrays(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """One row: arrays of lows and of ranges (1 where a component is constant), as many entries as components."""
    one = dim_ranges(vectors, vec).agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("d"))
    width = lambda x: x["high"] - x["low"]
    return one.select(F.transform("d", lambda x: x["low"]).alias("low"), F.transform("d", lambda x: F.when(width(x) > 0, width(x)).otherwise(F.lit(1.0))).alias("range"))


def quantize(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Adds ``q``, bytes from -128 to 127 over each component's range, rounded half to even."""
    ranges = F.broadcast(range_arrays(vectors, vec))  # one row
    scaled = F.zip_with(F.zip_with(doubles(F.col(vec)), "low", lambda x, lo: x - lo), "range", lambda x, r: F.bround(x / r * 255.0 - 128.0))
    return vectors.crossJoin(ranges).withColumn("q", F.transform(scaled, lambda x: F.least(F.greatest(x, F.lit(-128.0)), F.lit(127.0)).cast("byte")))


def dequantize(q: Column, low: Column, width: Column) -> Column:
    """Back to components, of length one again."""
    return unit(F.zip_with(F.zip_with(q.cast("array<double>"), width, lambda x, r: (x + 128.0) / 255.0 * r), low, lambda x, lo: x + lo))
