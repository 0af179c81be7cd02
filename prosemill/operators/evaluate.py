"""Evaluation: classification metrics, curves, correlations, regressions, threshold sweeps, gate summaries.

Ranks over all rows would need one global order, so curve metrics first reduce
the rows to one per distinct score (an aggregate with map-side combine) and
accumulate over those by ranges of the score (``ranks.prefix``), so no task
holds all distinct scores; ``buckets`` bounds their number, if that is wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.operators import ranks


def ratio0(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(y: Column, p: Column) -> dict[str, Column]:
    """Aggregates tp, fp, fn, tn of boolean truth and prediction."""
    return {"tp": F.count_if(y & p), "fp": F.count_if(~y & p), "fn": F.count_if(y & ~p), "tn": F.count_if(~y & ~p)}


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": ratio0(2 * precision * recall, precision + recall)}


def by_score(df: DataFrame, score: str, truth: Column, buckets: int | None = None) -> DataFrame:
    """(score, pos, neg): class counts per distinct score, or per bucket of [0, 1]."""
    s = F.col(score) if buckets is None else F.floor(F.col(score) * buckets) / buckets
    return df.filter(F.col(score).isNotNull()).groupBy(s.alias("score")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))


def roc_auc(counts: DataFrame, single_class: float | None = 0.0) -> DataFrame:
    """One row auc from ``by_score``: pairs ranked right plus half the ties, over all pairs."""
    d = ranks.prefix(ranks.score_ranges(counts, F.col("score")), [], ["score"], F.col("neg"), "below")
    s = d.agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select(F.coalesce(F.try_divide(F.col("u"), (F.col("p") * F.col("n")).cast("double")), F.lit(single_class)).alias("auc"))


def roc_points(counts: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr) for each distinct score, from the highest."""
    totals = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    d = ranks.score_ranges(counts, -F.col("score"))
    for c, above in (("pos", "tp"), ("neg", "fp")):
        d = ranks.prefix(d, [], [F.desc("score")], F.col(c), above).withColumn(above, F.col(above) + F.col(c))
    d = d.join(F.broadcast(totals))  # one row
    return d.select(F.col("score").alias("threshold"), ratio0(F.col("fp"), F.col("n")).alias("fpr"), ratio0(F.col("tp"), F.col("p")).alias("tpr"))


def threshold_sweep(counts: DataFrame, thresholds: Column) -> DataFrame:
    """(threshold, f1_macro) for an array of thresholds, from class counts per score."""
    t = counts.withColumn("t", F.explode(thresholds))
    hit = F.col("score") >= F.col("t")
    part = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0))
    g = t.groupBy("t").agg(part("pos", hit).alias("tp"), part("neg", hit).alias("fp"), part("pos", ~hit).alias("fn"), part("neg", ~hit).alias("tn"))
    f1 = lambda a, b, c: ratio0(2 * F.col(a), 2 * F.col(a) + F.col(b) + F.col(c))
    return g.select(F.col("t").alias("threshold"), ((f1("tp", "fp", "fn") + f1("tn", "fn", "fp")) / 2).alias("f1_macro"))


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, out): the average rank of each distinct value; join it back on the value."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    g = ranks.prefix(ranks.score_ranges(g, F.col(value)), [], [value], F.col("__n"), "__below")
    return g.select(value, (F.col("__below") + (F.col("__n") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row spearman: correlation of average ranks."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = d.join(average_ranks(d, a, "__ra"), a).join(average_ranks(d, b, "__rb"), b)
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"))


def regression_metrics(y: str, p: str) -> dict[str, Column]:
    """Aggregates mae, rmse, r2."""
    e = F.col(y) - F.col(p)
    rest = F.sum(e * e)
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    return {"mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "r2": 1 - F.try_divide(rest, total)}


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bucket, n): equal bins; values at or above high fall into the last."""
    width = (high - low) / bins
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - low) / width))).cast("int")
    return df.filter(F.col(value).isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def score_stats(value: str, threshold: float) -> dict[str, Column]:
    """count, mean, median, least, most, sample deviation (0 for one row), share below the threshold."""
    return {
        "count": F.count(value), "mean": F.avg(value), "median": F.median(value), "least": F.min(value), "most": F.max(value),
        "stdev": F.coalesce(F.stddev_samp(value), F.lit(0.0)), "pct_below": ratio0(F.count_if(F.col(value) < threshold), F.count(value)),
    }


def gate_summary(similarity: str, ratio: str, invalid: str) -> dict[str, Column]:
    """Mean similarity, median ratio, invalid rate; 0, 0 and 1 without rows."""
    return {
        "mean_similarity": F.coalesce(F.avg(similarity), F.lit(0.0)), "median_ratio": F.coalesce(F.median(ratio), F.lit(0.0)),
        "invalid_rate": F.coalesce(F.avg(F.col(invalid).cast("double")), F.lit(1.0)),
    }
