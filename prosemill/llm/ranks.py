"""Exact ranks and prefix sums inside large groups without sorting a group in one task.

A group's rows are spread over hash ranges of a uniform 64-bit key. Sums per
range are a small aggregate with map-side combine; a window over the ranges
gives each range its offset; rows are ranked only within their range. No task
ever holds a whole group, and the order is that of the hash key, so equal
inputs give equal ranks on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 256


def hash_key(seed: Column, *cols: Column) -> Column:
    """A uniform non-negative 63-bit order key."""
    return F.shiftrightunsigned(F.xxhash64(seed, *cols), 1)


def hash_range(key: Column, ranges: int = RANGES) -> Column:
    """The range (0..ranges-1, a power of two) of a key of hash_key; ascending with the key."""
    return F.shiftrightunsigned(key, 63 - (ranges.bit_length() - 1)).cast("int")


def spread_sums(df: DataFrame, group: list[str], key: str, order: list[str], weight: str, ranges: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """(rows with __before and __range, ranges with __offset).

    A row's exclusive prefix sum of ``weight`` in hash order in its group is
    __offset + __before.
    """
    rows = df.withColumn("__range", hash_range(F.col(key), ranges))
    sums = rows.groupBy(*group, "__range").agg(F.sum(weight).alias("__sum"))
    by = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "__range", F.coalesce(F.sum("__sum").over(by), F.lit(0)).cast("long").alias("__offset"))
    inside = Window.partitionBy(*group, "__range").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum(weight).over(inside), F.lit(0)).cast("long"))
    return rows, offsets


def prefix_sums(df: DataFrame, group: list[str], key: str, order: list[str], weight: str, out: str, ranges: int = RANGES) -> DataFrame:
    """df with ``out``: the exclusive prefix sum of ``weight`` within ``group`` in hash order."""
    rows, offsets = spread_sums(df, group, key, order, weight, ranges)
    joined = rows.join(offsets, [*group, "__range"])
    return joined.withColumn(out, F.col("__offset") + F.col("__before")).drop("__offset", "__before", "__range")
