"""Joins, keyed unions, deduplication and per-group ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column | str], keep: list[str] | None = None) -> DataFrame:
    """The first row of each group; ``order`` must end in a unique key.

    By a row number whose limit of one row Spark also applies below the shuffle,
    so a hot group sends one row per partition.
    """
    keep = keep or [c for c in df.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*keys, *keep)


def top_per(df: DataFrame, keys: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[Column | str]) -> DataFrame:
    """Inner join with the first matching row of right only; unmatched rows are dropped."""
    return left.join(first_per(right, [key], order), key)


def keyed_overwrite(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of parts in which a later part's row replaces an earlier one's of the same key."""
    tagged = [p.withColumn("__p", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t, allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("__p", key)]
    return both.groupBy(key).agg(F.max_by(F.struct(*columns), "__p").alias("r")).select(key, "r.*")


def backfill(base: DataFrame, extra: DataFrame, key: str, limit: int, order: list[Column | str]) -> DataFrame:
    """base and up to ``limit`` rows of extra whose key base lacks (a top-k report)."""
    return base.unionByName(extra.join(base.select(key).distinct(), key, "left_anti").orderBy(*order).limit(limit))


def fill_from(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join; missing values of columns come from right."""
    r = right.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = left.join(r, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, in doubles; null where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, centroid): mean vectors, summed by position with map-side combine."""
    parts = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def nearest(df: DataFrame, key: str, vector: str, centers: DataFrame, group: str, least: float | None = None, most_centers: int = 4096) -> DataFrame:
    """(key, group, similarity): the most similar center of each row.

    The centers' number is checked before they are broadcast; more than
    ``most_centers`` are an error, since comparing everything with everything
    isn't a join this operator does.
    """
    if centers.limit(most_centers + 1).count() > most_centers:
        raise ValueError("too many centers to compare every row with")
    both = df.select(key, vector).join(F.broadcast(centers.select(group, "centroid")))
    both = both.withColumn("similarity", F.round(cosine(F.col(vector), F.col("centroid")), 9))
    best = both.groupBy(key).agg(F.max(F.struct("similarity", (-F.col(group)).alias("g"))).alias("m"))
    out = best.select(key, (-F.col("m.g")).alias(group), F.col("m.similarity").alias("similarity"))
    return out if least is None else out.filter(F.col("similarity") >= least)


def medoids(df: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """(group, key): the member with the least mean cosine distance to its group.

    The mean distance to all members is 1 minus the dot product of the unit
    vector with the mean of the unit vectors, so no pair is ever formed.
    """
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = df.select(group, key, F.transform(vector, lambda v: v.cast("double") / norm).alias("u"))
    means = centroids(unit, group, "u")
    scored = unit.join(means, group).withColumn("__d", F.round(1 - F.aggregate(F.zip_with("u", "centroid", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 9))
    return scored.groupBy(group).agg(F.min(F.struct("__d", key)).alias("m")).select(group, F.col(f"m.{key}").alias(key), F.col("m.__d").alias("distance"))


def assign_ranges(left: DataFrame, right: DataFrame, bucket: str, n: int, order_left: list[Column | str], order_right: list[Column | str]) -> DataFrame:
    """Give row j of left the right rows of its bucket with ranks in (j*n, (j+1)*n]: at most n each, none twice.

    Ranks are per bucket; the join is an equi join on (bucket, block).
    """
    a = left.withColumn("__j", F.row_number().over(Window.partitionBy(bucket).orderBy(*order_left)) - 1)
    b = right.withColumn("__r", F.row_number().over(Window.partitionBy(bucket).orderBy(*order_right)) - 1).withColumn("__j", F.expr(f"__r div {n}"))
    return a.join(b.drop("__r"), [bucket, "__j"]).drop("__j")


def starting_with(heads: DataFrame, head_key: str, head: str, texts: DataFrame, text_key: str, text: str, longest: int) -> DataFrame:
    """(head_key, text_key) of every text that starts with a head of one to ``longest`` characters.

    They meet on the hash of the head's first characters, as many as the next
    lower of fixed lengths; then the whole head is compared.
    """
    lengths = F.array(*[F.lit(n) for n in [1, 2, 4, 8, 16, *range(32, longest, 32), longest]])
    fits = lambda c: F.filter(lengths, lambda n: n <= F.length(c))
    a = heads.filter(F.length(head) > 0).select(head_key, head, F.array_max(fits(head)).alias("__n"))
    a = a.withColumn("__h", F.xxhash64(F.left(head, F.col("__n"))))
    b = texts.select(text_key, text, F.explode(fits(text)).alias("__n"))
    b = b.select(text_key, "__n", F.xxhash64(F.left(text, F.col("__n"))).alias("__h"))
    met = a.join(b, ["__n", "__h"]).select(head_key, head, text_key)
    return met.join(texts.select(text_key, text), text_key).filter(F.startswith(text, head)).select(head_key, text_key)
