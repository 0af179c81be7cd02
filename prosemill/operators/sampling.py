"""Seeded samples, splits, curricula and ordered analyses of logs.

Random choices order rows by md5(seed|key), which any engine reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.operators import ranks


def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """df ordered by its hash; a limit behind it becomes a top-k without a full sort."""
    return df.withColumn("__h", hash_order(seed, key)).orderBy("__h", key)


def ranked(df: DataFrame, order: str, out: str, then: list[str] | None = None) -> DataFrame:
    """df with its 1-based position in the order.

    Meant for results of a bounded size or one row per group: rows are numbered
    over range partitions, with the partitions' sizes added up in a second,
    small step, so no task holds all rows.
    """
    by = [order, *(then or [])]
    parts = df.repartitionByRange(*[F.col(c) for c in by]).withColumn("__p", F.spark_partition_id()).sortWithinPartitions(*by)
    numbered = parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*by)))
    sizes = numbered.groupBy("__p").agg(F.max("__i").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return numbered.join(before, "__p").withColumn(out, (F.col("__b") + F.col("__i")).cast("long")).drop("__p", "__i", "__b")


def split_counts(total: Column, train: Column, val: Column, test: Column) -> list[Column]:
    """Sizes clamped to the total, train first, then val, then test."""
    left = lambda *used: F.greatest(F.lit(0), total - sum(used))
    return [F.least(train, total).alias("train"), F.least(val, left(train)).alias("val"), F.least(test, left(train, val)).alias("test")]


def stratified_split(df: DataFrame, key: str, stratum: str, train: float, val: float, seed: int) -> DataFrame:
    """df with split: shares of each stratum, at least one row for train and val."""
    d = df.withColumn("__h", hash_order(seed, key)).withColumn("__range", ranks.hex_range(F.coalesce("__h", F.lit("00"))))
    d = ranks.with_sizes(ranks.prefix(d, [stratum], ["__h", key], F.lit(1), "__n"), stratum, "__size")
    first = F.greatest(F.lit(1), F.floor(F.col("__size") * train))
    second = first + F.greatest(F.lit(1), F.floor(F.col("__size") * val))
    split = F.when(F.col("__n") < first, "train").when(F.col("__n") < second, "val").otherwise("test")
    return d.withColumn("split", split).drop("__h", "__range", "__n", "__size")


def stable_id(columns: list[str]) -> Column:
    """sha256 of the trimmed columns, one per line."""
    return F.sha2(F.concat_ws("\n", *[F.trim(F.coalesce(c, F.lit(""))) for c in columns]), 256)


def split_manifest(df: DataFrame, columns: list[str], seed: int, train: float, val: float) -> DataFrame:
    """(row_id, split): distinct stable ids, split by hash rank; with one or two ids, train gets them first."""
    ids = df.select(stable_id(columns).alias("row_id")).distinct()
    n = ids.count()
    a = max(1, int(n * train)) if n else 0
    b = a + (max(1, int(n * val)) if n > 2 else min(1, n - a))
    r = ranked(ids.withColumn("__h", hash_order(seed, "row_id")), "__h", "__n", ["row_id"])
    return r.select("row_id", F.when(F.col("__n") <= a, "train").when(F.col("__n") <= b, "val").otherwise("test").alias("split"))


def weighted_copies(df: DataFrame, key: str, weight: float, seed: int) -> DataFrame:
    """(key, copies): floor(weight) copies, and one more with the remaining probability, by hash."""
    u = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.select(key, (F.lit(int(weight)) + F.when(u < weight % 1, 1).otherwise(0)).alias("copies"))


def recency_upweighted(df: DataFrame, group: str, order: list[Column | str], weight: float) -> DataFrame:
    """df repeated: the newest floor(n * (weight - 1)) rows of each group appear twice; ``copy`` numbers them."""
    w = Window.partitionBy(group)
    n, size = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    d = df.withColumn("__twice", n <= F.floor(size * (weight - 1)))
    return d.withColumn("copy", F.explode(F.when(F.col("__twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("__twice")


STAGE_WEIGHTS = [("easy", "early", 0.6), ("medium", "early", 0.3), ("hard", "early", 0.1), ("easy", "late", 0.2), ("medium", "late", 0.3), ("hard", "late", 0.5)]


def with_stage_weights(df: DataFrame, column: str) -> DataFrame:
    """df with the sampling weight of its difficulty in each stage."""
    weights = F.array(*[F.struct(F.lit(a).alias("d"), F.lit(b).alias("stage"), F.lit(c).alias("weight")) for a, b, c in STAGE_WEIGHTS])
    mine = F.filter(weights, lambda w: w["d"] == F.col(column))
    return df.withColumn("w", F.explode(mine)).select(*[c for c in df.columns if c != column], "w.stage", "w.weight")


def hard_pack(df: DataFrame, group: str, key: str, score: str, delta: str) -> DataFrame:
    """(key, reason): the top half by score and the lowest 30% by delta of each group; delta's reason wins."""
    d = df.select(group, key, F.coalesce(-F.col(score), F.lit(float("inf"))).alias("__x"), F.coalesce(F.col(delta), F.lit(float("inf"))).alias("__y"))
    d = ranks.ranks(ranks.ranks(d, [group], F.col("__x"), key, "__a"), [group], F.col("__y"), key, "__b")
    d = ranks.with_sizes(d, group, "__size")
    share = lambda x: F.greatest(F.lit(1), F.floor(F.col("__size") * x))
    d = d.withColumn("__top", F.col("__a") <= share(0.5)).withColumn("__low", F.col("__b") <= share(0.3))
    return d.filter("__top OR __low").select(key, F.when(F.col("__low"), "low_delta").otherwise("high_score").alias("reason"))


def leaderboard(groups: DataFrame, order: list[Column | str], delta: str, rate: str) -> DataFrame:
    """groups (one row per run) with rank and distances from the leader."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # as many rows as there are runs
    d = groups.withColumn("rank", F.row_number().over(w))
    return d.withColumn("delta_from_leader", F.col(delta) - F.first(delta).over(w)).withColumn("pass_rate_from_leader", F.col(rate) - F.first(rate).over(w))


def standardized(df: DataFrame, group: list[str], value: str, out: str, sample: bool, epsilon: float = 1e-8) -> DataFrame:
    """df with (value - mean) / (deviation + epsilon) in its group.

    The moments are an aggregate with map-side combine joined back, so a large
    group is never gathered in one task as a window would.
    """
    dev = F.stddev_samp(value) if sample else F.stddev_pop(value)
    m = df.groupBy(*group).agg(F.avg(value).alias("__mean"), F.coalesce(dev, F.lit(1.0 if sample else 0.0)).alias("__dev"))
    same = None
    m = m.select(*[F.col(g).alias(f"__{g}") for g in group], "__mean", "__dev")
    for g in group:
        on = F.col(g).eqNullSafe(F.col(f"__{g}"))
        same = on if same is None else same & on
    d = df.join(m, same)
    return d.withColumn(out, (F.col(value) - F.col("__mean")) / (F.col("__dev") + epsilon)).drop("__mean", "__dev", *[f"__{g}" for g in group])


def plateau(df: DataFrame, group: list[str], order: str, value: str, patience: int, epsilon: float) -> DataFrame:
    """(group, order, stop): whether the last ``patience`` gains were all below epsilon."""
    w = Window.partitionBy(*group).orderBy(order)
    last = w.rowsBetween(-(patience - 1), 0)
    gain = df.withColumn("__g", F.lag(value).over(w) - F.col(value))
    small = F.bool_and(F.coalesce(F.col("__g") < epsilon, F.lit(False))).over(last)
    return gain.withColumn("stop", (F.count("__g").over(last) >= patience) & small).select(*group, order, "stop")


def evals_since_best(df: DataFrame, group: list[str], order: str, value: str, patience: int) -> DataFrame:
    """(group, order, since_best, stop): evaluations since the last new minimum."""
    w = Window.partitionBy(*group).orderBy(order)
    d = df.withColumn("__b", F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("__i", F.row_number().over(w))
    new = F.when(F.col("__b").isNull() | (F.col(value) < F.col("__b")), F.col("__i"))
    d = d.withColumn("since_best", (F.col("__i") - F.max(new).over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return d.withColumn("stop", F.col("since_best") >= patience).select(*group, order, "since_best", "stop")


def trajectories(df: DataFrame, group: list[str], order: list[str], key: str) -> DataFrame:
    """(group, a, b, kind): consecutive pairs, and first with last of longer trajectories."""
    w = Window.partitionBy(*group).orderBy(*order)
    steps = df.select(*group, F.col(key).alias("a"), F.lead(key).over(w).alias("b"), F.lit("step").alias("kind")).filter("b IS NOT NULL")
    first = F.struct(*order)
    ends = df.groupBy(*group).agg(F.min_by(key, first).alias("a"), F.max_by(key, first).alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    return steps.unionByName(ends.select(*group, "a", "b", F.lit("ends").alias("kind")))
