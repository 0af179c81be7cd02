"""Queries of aggregates, evaluation and arrays (AGG-*, ARR-*, PRJ-18..20/26/27, ML-11/14, GEN-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import arrays as A
from prosemill.functions import text as X
from prosemill.operators import evaluate as E
from prosemill.operators import relational as J
from prosemill.operators import rows as R
from prosemill.operators import synth
from prosemill.plans.catalogue import DOCS_SQL, query, r6, w_sql
from prosemill.plans.row_queries import INVALID_SQL, LOG_ONCE_SQL, ONCE_SQL, RATIO_SQL, SIM_SQL, essay_overlap, essay_ratio, log_once, once
from prosemill.plans.text_queries import ABNORMAL, ADVICE, ECHO, GENERIC, INFO, REP2, docs
from prosemill.session import table

# ---- gates and summaries -----------------------------------------------------------------------


def gated(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "mutation_op", "input_slop_score", "output_slop_score", similarity=essay_overlap(), ratio=essay_ratio(), invalid=R.invalid_output(F.col("best_essay")))


GATED_SQL = f"(select pair_id, mutation_op, input_slop_score, output_slop_score, {SIM_SQL} as similarity, {RATIO_SQL} as ratio, coalesce({INVALID_SQL}, true) as invalid from {ONCE_SQL})"


@query("agg_01_gate_summary", f"select round(avg(similarity), 6) as mean_similarity, round(median(ratio), 6) as median_ratio, round(avg(case when invalid then 1.0 else 0.0 end), 6) as invalid_rate from {GATED_SQL}")
def agg_01(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).agg(*[r6(c).alias(n) for n, c in E.gate_summary("similarity", "ratio", "invalid").items()])


PASSED = "similarity >= 0.1 and ratio between 0.8 and 1.25 and not invalid"


@query("agg_02_eval_summary", f"select mutation_op, count(*) as n, count(*) filter ({PASSED}) as passed, round(avg(case when {PASSED} then 1.0 else 0.0 end), 6) as pass_rate, round(avg(input_slop_score - output_slop_score), 6) as mean_delta, round(avg(input_slop_score - output_slop_score) filter ({PASSED}), 6) as mean_delta_passed, round(avg(abs(1 - ratio)), 6) as mean_gap from {GATED_SQL} group by mutation_op")
def agg_02(spark: SparkSession, d: str) -> DataFrame:
    ok = (F.col("similarity") >= 0.1) & F.col("ratio").between(0.8, 1.25) & ~F.col("invalid")
    delta = F.col("input_slop_score") - F.col("output_slop_score")
    return gated(spark, d).groupBy("mutation_op").agg(
        F.count("*").alias("n"), F.count_if(ok).alias("passed"), r6(F.avg(F.when(ok, 1.0).otherwise(0.0))).alias("pass_rate"), r6(F.avg(delta)).alias("mean_delta"),
        r6(F.avg(F.when(ok, delta))).alias("mean_delta_passed"), r6(F.avg(F.abs(1 - F.col("ratio")))).alias("mean_gap"),
    )


@query("agg_03_manifest", f"select count(*) as pairs, count(distinct topic) as topics, round(avg(improvement), 6) as mean_delta from {ONCE_SQL}")
def agg_03(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "topic", "improvement").agg(F.count("*").alias("pairs"), F.countDistinct("topic").alias("topics"), r6(F.avg("improvement")).alias("mean_delta"))


@query("agg_04_counts", "select source, lang, count(*) as n from documents group by source, lang")
def agg_04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("agg_05_slop_stats", "select source, count(slop_score) as count, round(avg(slop_score), 6) as mean, round(median(slop_score), 6) as median, round(min(slop_score), 6) as least, round(max(slop_score), 6) as most, round(coalesce(stddev_samp(slop_score), 0), 6) as stdev, round(coalesce(count(*) filter (slop_score < 0.3) / nullif(count(slop_score), 0), 0), 6) as pct_below from documents group by source")
def agg_05(spark: SparkSession, d: str) -> DataFrame:
    stats = {n: c if n == "count" else r6(c) for n, c in E.score_stats("slop_score", 0.3).items()}
    return table(spark, d, "documents").groupBy("source").agg(*[c.alias(n) for n, c in stats.items()])


@query("agg_06_round_summary", f"select generation, round(avg(best), 6) as best_mean_slop, count(*) as topics from (select generation, topic, min(slop_score) as best from {LOG_ONCE_SQL} where constraint_ok group by generation, topic) group by generation")
def agg_06(spark: SparkSession, d: str) -> DataFrame:
    best = log_once(spark, d, "generation", "topic", "slop_score", "constraint_ok").filter("constraint_ok").groupBy("generation", "topic").agg(F.min("slop_score").alias("best"))
    return best.groupBy("generation").agg(r6(F.avg("best")).alias("best_mean_slop"), F.count("*").alias("topics"))


@query("agg_07_prompt_means", f"select prompt_id, generation, round(avg(optimization_slop) + 1e-9, 6) as opt, round(avg(slop_score) + 1e-9, 6) as raw, bool_or(not constraint_ok) as failed_any from {LOG_ONCE_SQL} group by prompt_id, generation")
def agg_07(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "prompt_id", "generation", "optimization_slop", "slop_score", "constraint_ok")
    return e.groupBy("prompt_id", "generation").agg(r6(F.avg("optimization_slop") + 1e-9).alias("opt"), r6(F.avg("slop_score") + 1e-9).alias("raw"), F.bool_or(~F.col("constraint_ok")).alias("failed_any"))


# token scores: 1/length of each word stands for a token's probability
PROBS_SQL = f"[1.0 / length(x) for x in {w_sql('text')}]"


def token_scores(spark: SparkSession, d: str) -> DataFrame:
    probs = F.transform(X.words(F.col("text")), lambda x: F.lit(1.0) / F.length(x))
    return table(spark, d, "slop_examples").select("example_id", "labels", probs.alias("p"))


TOKENS_SQL = f"(select example_id, labels, {PROBS_SQL} as p from slop_examples)"


@query("agg_08_token_pooling", f"select example_id, round(coalesce(list_avg(p), 0), 6) as mean, round(coalesce(list_sum(p), 0), 6) as total, round(coalesce(list_max(p), 0), 6) as most, round(coalesce(list_avg(list_reverse_sort(p)[1:greatest(1, cast(floor(len(p) * 0.1) as int))]), 0), 6) as topk from {TOKENS_SQL}")
def agg_08(spark: SparkSession, d: str) -> DataFrame:
    p = F.coalesce("p", F.array().cast("array<double>"))
    return token_scores(spark, d).select("example_id", r6(A.pool(p, "mean")).alias("mean"), r6(A.pool(p, "sum")).alias("total"), r6(A.pool(p, "max")).alias("most"), r6(A.pool(p, "topk", 0.1)).alias("topk"))


@query("agg_09_bottom_k", f"select example_id, round(coalesce(list_avg(list_sort(p)[1:5]), 0), 6) as score from {TOKENS_SQL}")
def agg_09(spark: SparkSession, d: str) -> DataFrame:
    return token_scores(spark, d).select("example_id", r6(A.bottom_k(F.col("p"), 5)).alias("score"))


@query("agg_10_doc_labels", "select example_id, case when list_contains(labels, 1) then 1 else 0 end as any_label, case when coalesce(list_avg([x for x in labels if x <> -100]), 0) > 0.5 then 1 else 0 end as majority from slop_examples where labels is not null")
def agg_10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL")
    return e.select("example_id", A.label_any(F.col("labels")).alias("any_label"), A.label_majority(F.col("labels")).alias("majority"))


CHUNK_SQL = f"""(select doc_id, i, w[i * 50 + 1 : i * 50 + 100] as c from (select doc_id, w, unnest(range(0, case when len(w) <= 100 then 1 else cast(ceil((len(w) - 100) / 50.0) as bigint) + 1 end)) as i from (select doc_id, {w_sql('text')} as w from documents) where len(w) > 0))"""


@query("agg_11_chunk_scores", f"select doc_id, count(*) as chunks, round(avg(s), 6) as mean, round(max(s), 6) as most from (select doc_id, len(list_distinct(c)) / len(c) as s from {CHUNK_SQL}) group by doc_id")
def agg_11(spark: SparkSession, d: str) -> DataFrame:
    c = docs(spark, d).select("doc_id", F.explode(A.chunks(F.col("w"), 100)).alias("c"))
    s = c.select("doc_id", (F.size(F.array_distinct("c")) / F.size("c")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("chunks"), r6(F.avg("s")).alias("mean"), r6(F.max("s")).alias("most"))


@query("agg_12_penalty_means", f"{DOCS_SQL} select source, round(avg({ABNORMAL}), 6) as density, round(avg({REP2}), 6) as repetition from d group by source")
def agg_12(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d)
    return t.groupBy("source").agg(r6(F.avg(X.abnormal_punctuation_density(F.col("t"), F.col("ls")))).alias("density"), r6(F.avg(X.repetition_ratio(F.col("w")))).alias("repetition"))


@query("prj_18_structural_penalty", f"{DOCS_SQL} select source, round(greatest(0.0, (avg({ABNORMAL}) - 0.02) / 0.98), 6) as penalty from d group by source")
def prj_18(spark: SparkSession, d: str) -> DataFrame:
    mean = F.avg(X.abnormal_punctuation_density(F.col("t"), F.col("ls")))
    return docs(spark, d).groupBy("source").agg(r6(F.greatest(F.lit(0.0), (mean - 0.02) / (1 - 0.02))).alias("penalty"))


META_SQL = f"({ECHO} + {ADVICE} + {GENERIC}) / 3.0"


@query("prj_19_semantic_penalty", f"{DOCS_SQL} select source, round(avg(least(1.0, 0.6 * least(1.0, {META_SQL}) + 0.4 * least(1.0, 0.5 * {GENERIC}))), 6) as penalty from d group by source")
def prj_19(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    meta = F.least(F.lit(1.0), (X.instruction_echo_ratio(t) + X.writing_advice_ratio(t) + X.off_task_generic_ratio(t)) / 3.0)
    off = F.least(F.lit(1.0), 0.5 * X.off_task_generic_ratio(t))
    return docs(spark, d).groupBy("source").agg(r6(F.avg(F.least(F.lit(1.0), 0.6 * meta + 0.4 * off))).alias("penalty"))


@query("prj_20_total_objective", f"{DOCS_SQL} select source, case when count(*) filter (len(w) >= 8) = 0 then -1.0 else round(avg(1 - {REP2}) - 0.5 * avg({ABNORMAL}) + 0.2 * avg({INFO}), 6) end as total from d group by source")
def prj_20(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    total = F.avg(1 - X.repetition_ratio(w)) - 0.5 * F.avg(X.abnormal_punctuation_density(F.col("t"), F.col("ls"))) + 0.2 * F.avg(X.information_density(F.col("tok")))
    return docs(spark, d).groupBy("source").agg(F.when(F.count_if(F.size(w) >= 8) == 0, -1.0).otherwise(r6(total)).alias("total"))


@query("prj_26_penalized_reward", f"{DOCS_SQL} select d.doc_id, round(-(coalesce(slop_score, 0) + 0.3 * {REP2} + 0.1 * (case when len(w) < 50 then (50 - len(w)) / 50.0 when len(w) > 200 then (len(w) - 200) / 200.0 else 0.0 end)), 6) as reward from d join (select doc_id, slop_score from documents) s using (doc_id)")
def prj_26(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "slop_score", X.words(F.col("text")).alias("w"))
    return t.select("doc_id", r6(-(F.coalesce("slop_score", F.lit(0.0)) + 0.3 * X.repetition_ratio(F.col("w")) + 0.1 * X.length_penalty(F.size("w"), 50, 200))).alias("reward"))


@query("prj_27_sequence_reward", f"select example_id, round(1 - coalesce(list_avg(p), 0), 6) as reward from {TOKENS_SQL}")
def prj_27(spark: SparkSession, d: str) -> DataFrame:
    return token_scores(spark, d).select("example_id", r6(1 - A.mean(F.col("p"))).alias("reward"))


@query("agg_13_by_difficulty", f"select difficulty, count(*) as n, round(avg(coalesce(list_avg(p), 0)), 6) as mean from (select e.difficulty, t.p from slop_examples e join {TOKENS_SQL} t using (example_id)) group by difficulty")
def agg_13(spark: SparkSession, d: str) -> DataFrame:
    p = F.transform(X.words(F.col("text")), lambda x: F.lit(1.0) / F.length(x))
    return table(spark, d, "slop_examples").groupBy("difficulty").agg(F.count("*").alias("n"), r6(F.avg(A.mean(p))).alias("mean"))


@query("agg_14_slop_fraction", "select round(sum(len([x for x in labels if x = 1])) / sum(len([x for x in labels if x <> -100])), 6) as fraction from slop_examples where labels is not null")
def agg_14(spark: SparkSession, d: str) -> DataFrame:
    size = lambda f: F.sum(F.size(F.filter("labels", f)))
    return table(spark, d, "slop_examples").filter("labels IS NOT NULL").agg(r6(F.try_divide(size(lambda x: x == 1), size(lambda x: x != A.IGNORE))).alias("fraction"))


@query("agg_15_histogram", "select cast(least(9, greatest(0, floor(slop_score / 0.1::double))) as int) as bucket, count(*) as n from documents where slop_score is not null group by 1")
def agg_15(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(table(spark, d, "documents"), "slop_score", 0.0, 1.0, 10)


@query("agg_16_most_common", "select topic, count(*) as n from documents where topic is not null group by topic order by n desc, topic limit 10")
def agg_16(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").filter("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "topic").limit(10)


@query("agg_17_threshold_counts", "select count(*) filter (slop_score < 0.1) as below_1, count(*) filter (slop_score < 0.3) as below_3, count(*) filter (slop_score < 0.5) as below_5, count(*) filter (slop_score >= 0.5) as above_5 from documents")
def agg_17(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("slop_score")
    return table(spark, d, "documents").agg(F.count_if(s < 0.1).alias("below_1"), F.count_if(s < 0.3).alias("below_3"), F.count_if(s < 0.5).alias("below_5"), F.count_if(s >= 0.5).alias("above_5"))


@query("agg_18_label_percent", f"select generation, round(100.0 * count(*) filter (slop_score < 0.33) / count(slop_score), 6) as low, round(100.0 * count(*) filter (slop_score >= 0.66) / count(slop_score), 6) as high from {LOG_ONCE_SQL} where slop_score is not null group by generation")
def agg_18(spark: SparkSession, d: str) -> DataFrame:
    s, n = F.col("slop_score"), F.count("slop_score")
    return log_once(spark, d, "generation", "slop_score").filter("slop_score IS NOT NULL").groupBy("generation").agg(r6(100.0 * F.count_if(s < 0.33) / n).alias("low"), r6(100.0 * F.count_if(s >= 0.66) / n).alias("high"))


@query("agg_19_distinct_sizes", "select count(distinct topic) as topics, count(distinct source) as sources, count(distinct lang) as langs from documents")
def agg_19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.countDistinct("topic").alias("topics"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))


# ---- classification ----------------------------------------------------------------------------


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """quality >= 3 as the truth, 1 - slop_score as the score."""
    j = table(spark, d, "documents").select("doc_id", "slop_score").join(table(spark, d, "doc_labels"), "doc_id").filter("quality IS NOT NULL AND slop_score IS NOT NULL")
    return j.select("doc_id", (F.col("quality") >= 3).alias("y"), F.round(1 - F.col("slop_score"), 3).alias("s"))


LABELLED_SQL = "(select doc_id, quality >= 3 as y, round(1 - slop_score, 3) as s from documents join doc_labels using (doc_id) where quality is not null and slop_score is not null)"
CONF_SQL = f"(select count(*) filter (y and s >= 0.5)::double as tp, count(*) filter (not y and s >= 0.5)::double as fp, count(*) filter (y and s < 0.5)::double as fn, count(*) filter (not y and s < 0.5)::double as tn from {LABELLED_SQL})"
div = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0)"


@query("agg_20_binary_f1", f"select round({div('tp', 'tp + fp')}, 6) as precision, round({div('tp', 'tp + fn')}, 6) as recall, round({div('2 * tp', '2 * tp + fp + fn')}, 6) as f1 from {CONF_SQL}")
def agg_20(spark: SparkSession, d: str) -> DataFrame:
    c = labelled(spark, d).agg(*[v.alias(k) for k, v in E.confusion(F.col("y"), F.col("s") >= 0.5).items()])
    return c.select(*[r6(v).alias(k) for k, v in E.precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")).items()])


@query("agg_21_macro_f1", f"select round(({div('2 * tp', '2 * tp + fp + fn')} + {div('2 * tn', '2 * tn + fp + fn')}) / 2, 6) as macro_f1, round({div('tp + tn', 'tp + tn + fp + fn')}, 6) as accuracy from {CONF_SQL}")
def agg_21(spark: SparkSession, d: str) -> DataFrame:
    c = labelled(spark, d).agg(*[v.alias(k) for k, v in E.confusion(F.col("y"), F.col("s") >= 0.5).items()])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(r6((E.ratio0(2 * tp, 2 * tp + fp + fn) + E.ratio0(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"), r6(E.ratio0(tp + tn, tp + tn + fp + fn)).alias("accuracy"))


@query("agg_22_roc_auc", f"select round(coalesce(sum(case when a.s > b.s then 1.0 when a.s = b.s then 0.5 else 0.0 end) / nullif(count(*), 0), 0), 6) as auc from {LABELLED_SQL} a, {LABELLED_SQL} b where a.y and not b.y")
def agg_22(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_auc(E.by_score(labelled(spark, d), "s", F.col("y"))).select(r6("auc").alias("auc"))


@query("agg_23_confusion", f"select y, s >= 0.5 as predicted, count(*) as n from {LABELLED_SQL} group by 1, 2")
def agg_23(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).groupBy("y", (F.col("s") >= 0.5).alias("predicted")).agg(F.count("*").alias("n"))


RANKS_SQL = f"(select pair_id, a, b, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from (select pair_id, input_slop_score as a, output_slop_score as b from {ONCE_SQL} where input_slop_score is not null and output_slop_score is not null))"


@query("agg_24_correlations", f"select round(corr(a, b), 6) as pearson, round(corr(ra, rb), 6) as spearman from {RANKS_SQL}")
def agg_24(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score")
    r = E.spearman(p, "input_slop_score", "output_slop_score")
    return p.agg(F.corr("input_slop_score", "output_slop_score").alias("p")).join(F.broadcast(r)).select(r6("p").alias("pearson"), r6("spearman").alias("spearman"))


@query("agg_27_regression", f"select round(avg(abs(a - b)), 6) as mae, round(sqrt(avg((a - b) ** 2)), 6) as rmse, round(1 - sum((a - b) ** 2) / (sum(a * a) - sum(a) * sum(a) / count(a)), 6) as r2 from {RANKS_SQL}")
def agg_27(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score").filter("input_slop_score IS NOT NULL AND output_slop_score IS NOT NULL")
    return p.agg(*[r6(c).alias(n) for n, c in E.regression_metrics("input_slop_score", "output_slop_score").items()])


SWEEP_SQL = f"(select t, ({div('2 * tp', '2 * tp + fp + fn')} + {div('2 * tn', '2 * tn + fp + fn')}) / 2 as f from (select t, count(*) filter (y and s >= t)::double as tp, count(*) filter (not y and s >= t)::double as fp, count(*) filter (y and s < t)::double as fn, count(*) filter (not y and s < t)::double as tn from {LABELLED_SQL}, (select round(0.05 + i * 0.005::double, 3) as t from range(0, 181) r(i)) group by t))"


def thresholds(low: float, step: float, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(low + i * step, 3))


@query("agg_28_threshold_sweep", f"select t as threshold, round(f, 6) as f1_macro from {SWEEP_SQL} order by round(f, 9) desc, t limit 1")
def agg_28(spark: SparkSession, d: str) -> DataFrame:
    swept = E.threshold_sweep(E.by_score(labelled(spark, d), "s", F.col("y")), thresholds(0.05, 0.005, 181))
    return swept.orderBy(F.round("f1_macro", 9).desc(), "threshold").limit(1).select("threshold", r6("f1_macro").alias("f1_macro"))


@query("agg_29_ternary_sweep", f"""select lo, hi, round(avg(ok), 6) as accuracy from (select a.t as lo, b.t as hi, case when (case when s < a.t then 0 when s < b.t then 1 else 2 end) = least(2, q) then 1.0 else 0.0 end as ok
 from (select round(1 - slop_score, 3) as s, (quality - 1) // 2 as q from documents join doc_labels using (doc_id) where quality is not null and slop_score is not null), (select round(0.1 + i * 0.02::double, 3) as t from range(0, 25) r(i)) a, (select round(0.4 + i * 0.02::double, 3) as t from range(0, 25) r(i)) b where a.t < b.t) group by lo, hi order by round(avg(ok), 9) desc, lo, hi limit 1""")
def agg_29(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "slop_score").join(table(spark, d, "doc_labels"), "doc_id").filter("quality IS NOT NULL AND slop_score IS NOT NULL")
    c = j.groupBy(F.round(1 - F.col("slop_score"), 3).alias("s"), F.least(F.lit(2), F.expr("(quality - 1) div 2")).alias("q")).agg(F.count("*").alias("n"))
    g = c.withColumn("lo", F.explode(thresholds(0.1, 0.02, 25))).withColumn("hi", F.explode(thresholds(0.4, 0.02, 25))).filter("lo < hi")
    hit = F.when(F.col("s") < F.col("lo"), 0).when(F.col("s") < F.col("hi"), 1).otherwise(2) == F.col("q")
    acc = F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")
    return g.groupBy("lo", "hi").agg(acc.alias("a")).orderBy(F.round("a", 9).desc(), "lo", "hi").limit(1).select("lo", "hi", r6("a").alias("accuracy"))


@query("agg_30_first_to_last", f"with g as (select generation, avg(slop_score) as m from {LOG_ONCE_SQL} where slop_score is not null and generation is not null group by generation) select min(generation) as first, max(generation) as last, round(arg_max(m, generation) - arg_min(m, generation), 6) as change from g")
def agg_30(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "generation", "slop_score").filter("slop_score IS NOT NULL AND generation IS NOT NULL").groupBy("generation").agg(F.avg("slop_score").alias("m"))
    return g.agg(F.min("generation").alias("first"), F.max("generation").alias("last"), r6(F.max_by("m", "generation") - F.min_by("m", "generation")).alias("change"))


@query("agg_31_best_per_prompt", f"select prompt_id, log_id from (select prompt_id, log_id, row_number() over (partition by prompt_id order by slop_score, log_id) as n from {LOG_ONCE_SQL} where slop_score is not null) where n = 1")
def agg_31(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "prompt_id", "slop_score").filter("slop_score IS NOT NULL")
    return e.groupBy("prompt_id").agg(F.min_by("log_id", F.struct("slop_score", "log_id")).alias("log_id"))


@query("agg_32_budget", "select gen_config_id, cast(max_seq_len as bigint) * max_new_tokens * 4 as calls, round(max_new_tokens / max_seq_len, 6) as share from generation_config")
def agg_32(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("max_seq_len"), F.col("max_new_tokens")
    return table(spark, d, "generation_config").select("gen_config_id", (a.cast("long") * b * 4).alias("calls"), r6(b / a).alias("share"))


@query("agg_33_run_metrics", f"select mutation_op, round(avg(slop_score), 6) as mean, round(stddev_pop(slop_score), 6) as dev from {LOG_ONCE_SQL} group by mutation_op")
def agg_33(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "mutation_op", "slop_score").groupBy("mutation_op").agg(r6(F.avg("slop_score")).alias("mean"), r6(F.stddev_pop("slop_score")).alias("dev"))


@query("agg_34_memory_model", "select gen_config_id, cast(28 as bigint) * 3072 * 2 * 2 * (max_seq_len + max_new_tokens) as cache_bytes, round(cast(28 as bigint) * 3072 * 2 * 2 * (max_seq_len + max_new_tokens) / 1073741824.0, 6) as cache_gib from generation_config")
def agg_34(spark: SparkSession, d: str) -> DataFrame:
    b = F.lit(28).cast("long") * 3072 * 2 * 2 * (F.col("max_seq_len") + F.col("max_new_tokens"))
    return table(spark, d, "generation_config").select("gen_config_id", b.alias("cache_bytes"), r6(b / 1073741824.0).alias("cache_gib"))


@query("agg_35_sequence_accuracy", f"select round(avg(case when (coalesce(list_avg(p), 0) > 0.2) = (coalesce(list_avg([x for x in labels if x <> -100]), 0) > 0.5) then 1.0 else 0.0 end), 6) as accuracy from {TOKENS_SQL} where labels is not null")
def agg_35(spark: SparkSession, d: str) -> DataFrame:
    same = (A.mean(F.col("p")) > 0.2) == (A.mean(F.filter("labels", lambda x: x != A.IGNORE)) > 0.5)
    return token_scores(spark, d).filter("labels IS NOT NULL").agg(r6(F.avg(F.when(same, 1.0).otherwise(0.0))).alias("accuracy"))


@query("agg_36_answer_pools", "select domain_bucket, array_to_string(list(id order by id), ' ') as ids from (select distinct domain_bucket, id from source_pool where id like 'defan%') group by domain_bucket")
def agg_36(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_pool").filter("id LIKE 'defan%'").select("domain_bucket", "id").distinct()
    return s.groupBy("domain_bucket").agg(F.array_join(F.array_sort(F.collect_list("id")), " ").alias("ids"))


@query("agg_37_step_means", f"select generation, round(avg(slop_score), 6) as slop, round(avg(drift_penalty), 6) as drift from {LOG_ONCE_SQL} group by generation")
def agg_37(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "generation", "slop_score", "drift_penalty").groupBy("generation").agg(r6(F.avg("slop_score")).alias("slop"), r6(F.avg("drift_penalty")).alias("drift"))


@query("agg_38_original_vs_rewrite", f"select round(avg(input_slop_score), 6) as original, round(avg(output_slop_score), 6) as rewrite, round(avg({w_sql('baseline_essay').replace('[x', 'len([x', 1)})), 6) as words_a, round(avg({w_sql('best_essay').replace('[x', 'len([x', 1)})), 6) as words_b from {ONCE_SQL}")
def agg_38(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score", a=X.word_count(F.col("baseline_essay")), b=X.word_count(F.col("best_essay")))
    mean = lambda c: r6(F.avg(c))
    return p.agg(mean("input_slop_score").alias("original"), mean("output_slop_score").alias("rewrite"), mean("a").alias("words_a"), mean("b").alias("words_b"))


@query("agg_39_before_after", f"select topic_source, round(avg(input_slop_score), 6) as before, round(avg(output_slop_score), 6) as after, round(avg(input_slop_score - output_slop_score), 6) as delta from {ONCE_SQL} group by topic_source")
def agg_39(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic_source", "input_slop_score", "output_slop_score")
    return p.groupBy("topic_source").agg(r6(F.avg("input_slop_score")).alias("before"), r6(F.avg("output_slop_score")).alias("after"), r6(F.avg(F.expr("input_slop_score - output_slop_score"))).alias("delta"))


@query("agg_40_roc_points", f"with c as (select s, count(*) filter (y) as p, count(*) filter (not y) as n from {LABELLED_SQL} group by s) select s as threshold, round(sum(n) over w / nullif(sum(n) over (), 0), 6) as fpr, round(sum(p) over w / nullif(sum(p) over (), 0), 6) as tpr from c window w as (order by s desc)")
def agg_40(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_points(E.by_score(labelled(spark, d), "s", F.col("y"))).select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("agg_41_residuals", f"select cast(least(59, greatest(0, floor((a - b + 1) / (2.0::double / 60)))) as int) as bucket, count(*) as n from {RANKS_SQL} group by 1")
def agg_41(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score").select(F.expr("input_slop_score - output_slop_score").alias("e"))
    return E.histogram(p, "e", -1.0, 1.0, 60)


# ---- arrays and vectors ------------------------------------------------------------------------


@query("arr_01_word_chunks", f"select doc_id, cast(i as int) as i, array_to_string(c, ' ') as chunk from {CHUNK_SQL}")
def arr_01(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(A.chunks(F.col("w"), 100)).alias("i", "c")).select("doc_id", "i", F.array_join("c", " ").alias("chunk"))


@query("arr_02_padded_labels", "select example_id, array_to_string((labels || [-100 for i in range(0, 64)])[1:64], ' ') as labels, least(64, len(labels)) as used from slop_examples where labels is not null")
def arr_02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL")
    return e.select("example_id", F.array_join(A.pad(F.col("labels"), 64, A.IGNORE), " ").alias("labels"), F.least(F.lit(64), F.size("labels")).cast("long").alias("used"))


@query("arr_02_padded_label_chunks", """with t as (select example_id, labels, unnest(range(0, case when len(labels) <= 64 then 1 else cast(ceil((len(labels) - 64) / 32.0) as bigint) + 1 end)) as i from slop_examples where len(labels) > 0)
 select example_id, cast(i as int) as i, array_to_string((labels[i * 32 + 1 : i * 32 + 64] || [-100 for x in range(0, 64)])[1:64], ' ') as labels, rpad(repeat('1', cast(least(64, len(labels) - i * 32) as bigint)), 64, '0') as mask from t""")
def arr_02_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All labels of an example: chunks of 64 every 32, the last one padded, with a mask of what isn't padding."""
    e = table(spark, d, "slop_examples").filter(F.size("labels") > 0)
    e = e.select("example_id", F.posexplode(A.chunks(F.col("labels"), 64, 32)).alias("i", "c")).withColumn("c", F.col("c").cast("array<int>"))
    mask = A.pad(F.transform("c", lambda _: F.lit(1)), 64, 0)
    return e.select("example_id", "i", F.array_join(A.pad(F.col("c"), 64, A.IGNORE), " ").alias("labels"), F.array_join(mask, "").alias("mask"))


@query("arr_03_capped_windows", f"select doc_id, count(*) as windows from {CHUNK_SQL} where i < 3 group by doc_id")
def arr_03(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(A.chunks(F.col("w"), 100, 50, 3)).alias("c")).groupBy("doc_id").agg(F.count("*").alias("windows"))


@query("arr_04_char_chunks", "select doc_id, cast(i as int) as i, substr(text, cast(i * 500 + 1 as bigint), 500) as chunk from (select doc_id, text, unnest(range(0, cast(ceil(length(text) / 500.0) as bigint))) as i from documents where length(text) > 0)")
def arr_04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(A.char_chunks(F.col("text"), 500)).alias("i", "chunk"))


@query("arr_05_span_labels", f"with t as (select example_id, {w_sql('text')} as w, len(labels) as n from slop_examples), o as (select example_id, i, length(w[i]) as len, coalesce(list_sum([length(x) + 1 for x in w[1:i-1]]), 0) as st from (select example_id, w, unnest(range(1, len(w) + 1)) as i from t)) select example_id, sum(case when st + len / 2.0 >= 20 and st + len / 2.0 < 60 then 1 else 0 end)::bigint as inside from o group by example_id")
def arr_05(spark: SparkSession, d: str) -> DataFrame:
    w = X.words(F.col("text"))
    start = lambda i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda a, x: a + F.length(x) + 1)
    offsets = F.transform("w", lambda x, i: F.struct(F.when(i > 0, start(i)).otherwise(0).alias("start"), (F.when(i > 0, start(i)).otherwise(0) + F.length(x)).alias("end")))
    spans = F.array(F.struct(F.lit(20).alias("start"), F.lit(60).alias("end")))
    t = table(spark, d, "slop_examples").select("example_id", w.alias("w")).filter(F.size("w") > 0)
    return t.select("example_id", A.total(A.labels_from_spans(offsets, spans)).cast("long").alias("inside"))


@query("arr_07_constant_labels", f"select doc_id, array_to_string([1 for x in {w_sql('text')}], '') as labels from documents")
def arr_07(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.array_join(F.array_repeat(F.lit(1), F.size("w")), "").alias("labels"))


@query("arr_08_alignment_check", f"select count(*) as examples, count(*) filter (len(labels) = len({w_sql('text')})) as aligned from slop_examples where labels is not null and text is not null")
def arr_08(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL AND text IS NOT NULL")
    return e.agg(F.count("*").alias("examples"), F.count_if(F.size("labels") == F.size(X.words(F.col("text")))).alias("aligned"))


@query("arr_10_prompt_mask", "select example_id, array_to_string(([case when i <= 5 then -100 else labels[i] end for i in range(1, least(32, len(labels)) + 1)] || [-100 for i in range(0, 32)])[1:32], ' ') as labels from slop_examples where labels is not null")
def arr_10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL")
    return e.select("example_id", F.array_join(A.prompt_mask(F.lit(5), F.col("labels"), 32), " ").alias("labels"))


V = lambda a: f"list_transform({a}.embedding, lambda x: x::double)"
COSINE_SQL = f"(list_dot_product({V('a')}, {V('b')}) / (sqrt(list_dot_product({V('a')}, {V('a')})) * sqrt(list_dot_product({V('b')}, {V('b')}))))"


@query("arr_11_cosine", f"select a.vec_id, round({COSINE_SQL}, 6) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def arr_11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", r6(J.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("arr_12_drift", f"select a.vec_id, round(1 - greatest(-1.0, least(1.0, {COSINE_SQL})), 6) as drift from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def arr_12(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    c = J.cosine(F.col("embedding"), F.col("other"))
    return e.join(b, "vec_id").select("vec_id", r6(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))).alias("drift"))


@query("arr_13_mean_pooled", "with c as (select label, list(x order by i) as c from (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i) group by label) select label, round(c[1] / sqrt(list_dot_product(c, c)), 6) as first, round(c[2] / sqrt(list_dot_product(c, c)), 6) as second from c")
def arr_13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return J.centroids(e, "label", "v").withColumn("u", A.unit(F.col("centroid"))).select("label", r6(F.col("u")[0]).alias("first"), r6(F.col("u")[1]).alias("second"))


@query("arr_14_argmax", "select vec_id, list_position(embedding, list_max(embedding)) - 1 as position from embeddings")
def arr_14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.array_position("embedding", F.array_max("embedding")) - 1).alias("position"))


@query("arr_15_kl", "with s as (select vec_id, [exp(x::double) for x in embedding[1:8]] as p, [exp(x::double) for x in embedding[9:16]] as q from embeddings), n as (select vec_id, [x / list_sum(p) for x in p] as p, [x / list_sum(q) for x in q] as q from s) select vec_id, round(list_sum([p[i] * ln(p[i] / q[i]) for i in range(1, 9)]), 6) as kl from n")
def arr_15(spark: SparkSession, d: str) -> DataFrame:
    part = lambda a: R.softmax(F.transform(F.slice("embedding", a, 8), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", part(1).alias("p"), part(9).alias("q")).select("vec_id", r6(A.kl_mean(F.col("p"), F.col("q"))).alias("kl"))


@query("arr_16_json_extract", "select event_id, json_extract_string(props, '$.k') as k from events where json_extract_string(props, '$.k') is not null")
def arr_16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k IS NOT NULL")


@query("arr_18_composite_drift", f"select log_id, round(case when slop_score <= 0.5 then 1.0 * drift_penalty + 0.35 * (1 - optimization_slop) + 0.5 * (1 - slop_score) else 0.0 end, 6) as drift from {LOG_ONCE_SQL} where slop_score is not null")
def arr_18(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "slop_score", "drift_penalty", "optimization_slop").filter("slop_score IS NOT NULL")
    return e.select("log_id", r6(A.composite_drift(F.col("drift_penalty"), F.col("optimization_slop"), F.col("slop_score"), F.col("slop_score"), 0.5)).alias("drift"))


@query("arr_22_row_id", f"select pair_id, sha256(trim(coalesce(topic, '')) || chr(10) || trim(coalesce(input_prompt, '')) || chr(10) || trim(coalesce(output_prompt, ''))) as row_id from {ONCE_SQL}")
def arr_22(spark: SparkSession, d: str) -> DataFrame:
    from prosemill.operators.sampling import stable_id

    return once(spark, d, "topic", "input_prompt", "output_prompt").select("pair_id", stable_id(["topic", "input_prompt", "output_prompt"]).alias("row_id"))


@query("arr_23_align_labels", f"select example_id, array_to_string((labels || [-100 for i in range(0, len({w_sql('text')}))])[1:len({w_sql('text')})], ' ') as labels from slop_examples where labels is not null and len({w_sql('text')}) > 0")
def arr_23(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL").withColumn("n", F.size(X.words(F.col("text")))).filter("n > 0")
    return e.select("example_id", F.array_join(A.align_labels(F.col("labels"), F.col("n")), " ").alias("labels"))


@query("arr_24_pad_to_longest", "select example_id, len(labels) as own, max(len(labels)) over (partition by difficulty) as padded from slop_examples where labels is not null")
def arr_24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "slop_examples").filter("labels IS NOT NULL").select("example_id", "difficulty", F.size("labels").cast("long").alias("own"))
    most = e.groupBy("difficulty").agg(F.max("own").alias("padded"))
    return e.join(most, e["difficulty"].eqNullSafe(most["difficulty"])).select("example_id", "own", "padded")


# ---- generation and search tables --------------------------------------------------------------

NOUN_MAP_SQL = "map {" + ", ".join(f"'{a}': '{b}'" for a, b in synth.GENERIC_NOUNS.items()) + "}"


@query("gen_09_generic_nouns", f"select doc_id, array_to_string([case when map_contains(m, rtrim(lower(x), '.,;:!?')) then (case when regexp_matches(x, '^[\\p{{Lu}}]') then upper(left(m[rtrim(lower(x), '.,;:!?')], 1)) || substr(m[rtrim(lower(x), '.,;:!?')], 2) else m[rtrim(lower(x), '.,;:!?')] end) else x end for x in w], ' ') as text from (select doc_id, {w_sql('text')} as w, {NOUN_MAP_SQL} as m from documents)")
def gen_09(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", synth.generic_nouns(F.col("w")).alias("text"))


@query("ml_11_bandit_means", f"select mutation_op, count(*) as pulls, round(avg(improvement), 6) as mean from {ONCE_SQL} where improvement is not null group by mutation_op")
def ml_11(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "mutation_op", "improvement").filter("improvement IS NOT NULL").groupBy("mutation_op").agg(F.count("*").alias("pulls"), r6(F.avg("improvement")).alias("mean"))


@query("ml_14_variant_comparison", f"select topic_source, mutation_op, count(*) as n, round(avg(input_slop_score), 6) as seed, round(avg(output_slop_score), 6) as optimized from {ONCE_SQL} group by topic_source, mutation_op")
def ml_14(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic_source", "mutation_op", "input_slop_score", "output_slop_score")
    return p.groupBy("topic_source", "mutation_op").agg(F.count("*").alias("n"), r6(F.avg("input_slop_score")).alias("seed"), r6(F.avg("output_slop_score")).alias("optimized"))

