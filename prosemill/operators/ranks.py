"""Exact ranks and prefix aggregates inside large groups without sorting a group in one task.

A group's rows are spread over ranges that ascend with their order: ranges of a
uniform hash key, or ranges of a score whose bounds are approximate quantiles of
the whole table. Aggregates per range are small and combined in the map stage; a
window over the ranges gives each range its offset; rows are ordered only within
their range. The bounds are literals of the plan, so a task that is run again
finds the same ranges, and they only spread the work: results are exact whatever
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def hex_range(digest: Column) -> Column:
    """The range (0..255) of a hexadecimal digest, ascending with it."""
    return F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")


def _bounds(df: DataFrame, cols: list[Column], ranges: int) -> list[list[float]]:
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(*[F.percentile_approx(c.cast("double"), at, 100 * ranges).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted({x for x in q or [] if x == x}) for q in found]


def _place(c: Column, bounds: list[float]) -> Column:
    """2i between bounds i-1 and i, 2i+1 on bound i; nulls come first."""
    if not bounds:
        return F.when(c.isNull(), -1).otherwise(0)
    # rows fall into few ranges, so the number of bounds below is one codegen'd search through a literal array
    array = F.array(*[F.lit(x) for x in bounds])
    v = c.cast("double")
    below = F.size(F.filter(array, lambda b: b < v))
    return F.when(c.isNull(), -1).otherwise(2 * below + F.array_contains(array, v).cast("int"))


def score_ranges(df: DataFrame, score: Column, key: str | None = None, ranges: int = RANGES) -> DataFrame:
    """df with __range, ascending with (score nulls first, key); key is numeric.

    A score that many rows share is a bound and has a range of its own, which is
    spread further over ranges of the key.
    """
    bounds = _bounds(df, [score, *([F.col(key)] if key else [])], ranges)
    first = _place(score, bounds[0])
    alone = F.when((first < 0) | (first % 2 == 1), _place(F.col(key), bounds[1])).otherwise(0) if key else F.lit(0)
    return df.withColumn("__range", F.struct(first.alias("s"), alone.alias("k")))


def prefix(df: DataFrame, group: list[str], order: list[Column | str], value: Column, out: str, least: bool = False) -> DataFrame:
    """df, which has __range, with ``out``: the sum (or least) of value over the rows before each in its group.

    0 (or null) for a group's first row. A null group is a group.
    """
    how = F.min if least else F.sum
    rows = df.withColumn("__ranks_v", value)
    inside = Window.partitionBy(*group, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "__range").agg(how("__ranks_v").alias("__ranks_t"))
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    names = [*group, "__range"]
    offsets = totals.select(*[F.col(c).alias(f"__ranks_o{i}") for i, c in enumerate(names)], how("__ranks_t").over(across).alias("__ranks_o"))
    on = None
    for i, c in enumerate(names):
        same = F.col(c).eqNullSafe(F.col(f"__ranks_o{i}"))
        on = same if on is None else on & same
    d = rows.withColumn("__ranks_b", how("__ranks_v").over(inside)).join(offsets, on)
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.least("__ranks_o", "__ranks_b") if least else zero(F.col("__ranks_o")) + zero(F.col("__ranks_b"))
    return d.withColumn(out, total).drop("__ranks_v", "__ranks_b", "__ranks_o", *[f"__ranks_o{i}" for i in range(len(names))])


def ranks(df: DataFrame, group: list[str], score: Column, key: str, out: str) -> DataFrame:
    """df with ``out``: the 1-based rank in its group by (score nulls first, key)."""
    d = score_ranges(df.withColumn("__ranks_s", score), F.col("__ranks_s"), key)
    return prefix(d, group, [F.col("__ranks_s").asc_nulls_first(), key], F.lit(1), out).withColumn(out, (F.col(out) + 1).cast("long")).drop("__ranks_s", "__range")


def with_sizes(df: DataFrame, group: str, out: str) -> DataFrame:
    """df with the number of rows of its group, from an aggregate joined back."""
    sizes = df.groupBy(F.col(group).alias("__ranks_g")).agg(F.count(F.lit(1)).alias(out))
    return df.join(sizes, F.col(group).eqNullSafe(F.col("__ranks_g"))).drop("__ranks_g")
