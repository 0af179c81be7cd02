"""Queries of joins, set operations, sampling and windows (JOIN-*, SET-*, SMP-*, WIN-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.operators import ranks
from prosemill.operators import relational as J
from prosemill.operators import sampling as S
from prosemill.plans.catalogue import query, r6, w_sql
from prosemill.plans.row_queries import LOG_ONCE_SQL, ONCE_SQL, POOL_SQL, log_once, once, pool
from prosemill.session import table


def desc(c: str):
    return F.col(c).desc_nulls_last()


# ---- joins -------------------------------------------------------------------------------------


@query("join_01_first_match", f"""select l.log_id, p.pair_id from {LOG_ONCE_SQL} l join (select topic, min(pair_id) as pair_id from {ONCE_SQL} where topic is not null group by topic) p using (topic) where not l.constraint_ok""")
def join_01(spark: SparkSession, d: str) -> DataFrame:
    failures = log_once(spark, d, "topic", "constraint_ok").filter("NOT constraint_ok").select("log_id", "topic")
    return J.first_match(failures, once(spark, d, "topic"), "topic", ["pair_id"]).select("log_id", "pair_id")


@query("join_02_semi", f"select pair_id from {ONCE_SQL} where topic in (select topic from topic_sources where slop_score < 0.3)")
def join_02(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "topic_sources").filter("slop_score < 0.3").select("topic")
    return once(spark, d, "topic").join(good, "topic", "left_semi").select("pair_id")


@query("join_03_semi_on_topic", f"select log_id from {LOG_ONCE_SQL} where topic in (select topic from prompt_pairs where topic_source = 'original')")
def join_03(spark: SparkSession, d: str) -> DataFrame:
    allowed = table(spark, d, "prompt_pairs").filter("topic_source = 'original'").select("topic")
    return log_once(spark, d, "topic").join(allowed, "topic", "left_semi").select("log_id")


@query("join_04_anti", "select distinct topic from topic_sources where topic is not null and topic not in (select topic from prompt_pairs where topic is not null and topic_source = 'original')")
def join_04(spark: SparkSession, d: str) -> DataFrame:
    used = table(spark, d, "prompt_pairs").filter("topic_source = 'original'").select("topic")
    return table(spark, d, "topic_sources").select("topic").filter("topic IS NOT NULL").join(used, "topic", "left_anti").distinct()


@query("join_05_backfill", "(select doc_id, text from documents where source = 'aeon_essays' and text is not null) union all (select doc_id, text from documents where source = 'forum_replies' and text is not null and text not in (select text from documents where source = 'aeon_essays' and text is not null) order by doc_id limit 50)")
def join_05(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", "source").filter("text IS NOT NULL")
    part = lambda s: t.filter(F.col("source") == s).select("doc_id", "text")
    return J.backfill(part("aeon_essays"), part("forum_replies"), "text", 50, ["doc_id"])


@query("join_06_lookup_chain", """select e.example_id, p.domain_bucket, c.n from slop_examples e join (select id, any_value(domain_bucket) as domain_bucket from source_pool group by id) p on e.pool_id = p.id
 join (select domain_bucket, count(*) as n from source_pool group by domain_bucket) c on p.domain_bucket = c.domain_bucket""")
def join_06(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "source_pool")
    domains = s.groupBy("id").agg(F.any_value("domain_bucket").alias("domain_bucket")).withColumnRenamed("id", "pool_id")
    sizes = s.groupBy("domain_bucket").agg(F.count("*").alias("n"))
    return table(spark, d, "slop_examples").select("example_id", "pool_id").join(domains, "pool_id").join(sizes, "domain_bucket").select("example_id", "domain_bucket", "n")


@query("join_07_capped_assignment", f"""with l as (select pair_id, round_num, row_number() over (partition by round_num order by md5('1|' || pair_id), pair_id) - 1 as j from {ONCE_SQL} where round_num is not null),
 r as (select topic, round_num, (row_number() over (partition by round_num order by md5('2|' || topic), topic) - 1) // 2 as j from (select distinct topic, round_num from topic_sources where topic is not null and round_num is not null))
 select l.pair_id, r.topic from l join r using (round_num, j)""")
def join_07(spark: SparkSession, d: str) -> DataFrame:
    left = once(spark, d, "round_num").filter("round_num IS NOT NULL")
    right = table(spark, d, "topic_sources").select("topic", "round_num").filter("topic IS NOT NULL AND round_num IS NOT NULL").distinct()
    order = lambda seed, c: [F.md5(F.concat(F.lit(f"{seed}|"), F.col(c).cast("string"))), c]
    return J.assign_ranges(left, right, "round_num", 2, order(1, "pair_id"), order(2, "topic")).select("pair_id", "topic")


VEC = "list_transform(embedding, lambda x: x::double)"
CENT_SQL = "select label, list(x order by i) as c from (select label, i, avg(x) as x from (select label, unnest(embedding)::double as x, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by label, i) group by label"
COS = lambda a, b: f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"


@query("join_08_nearest_centroid", f"with c as ({CENT_SQL}), s as (select vec_id, c.label, round({COS(VEC, 'c.c')}, 9) as s from embeddings, c) select vec_id, arg_max(label, (s, -label)) as label, round(max(s), 6) as similarity from s group by vec_id having max(s) >= 0.3")
def join_08(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    centers = J.centroids(e.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v")), "label", "v")
    return J.nearest(e.select("vec_id", "embedding"), "vec_id", "embedding", centers, "label", 0.3).select("vec_id", "label", r6("similarity").alias("similarity"))


@query("join_09_medoid", f"with p as (select a.label, a.vec_id, 1 - {COS(VEC.replace('embedding', 'a.embedding'), VEC.replace('embedding', 'b.embedding'))} as dist from embeddings a join embeddings b on a.label = b.label), m as (select label, vec_id, round(avg(dist), 9) as dist from p group by label, vec_id) select label, arg_min(vec_id, (dist, vec_id)) as vec_id, round(min(dist), 6) as distance from m group by label")
def join_09(spark: SparkSession, d: str) -> DataFrame:
    return J.medoids(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", r6("distance").alias("distance"))


@query("join_10_prefix", f"select l.log_id, p.pair_id from {LOG_ONCE_SQL} l join {ONCE_SQL} p on left(l.essay, 60) = left(p.best_essay, 60)")
def join_10(spark: SparkSession, d: str) -> DataFrame:
    a = log_once(spark, d, head=F.left("essay", F.lit(60)))
    return a.join(once(spark, d, head=F.left("best_essay", F.lit(60))), "head").select("log_id", "pair_id")


@query("join_10_logged_prefix", f"select l.log_id, p.pair_id from {LOG_ONCE_SQL} l join {ONCE_SQL} p on starts_with(p.best_essay, left(l.essay, 500)) where regexp_matches(l.essay, '[^ \\t\\n\\r\\f]')")
def join_10_logged(spark: SparkSession, d: str) -> DataFrame:
    """Logged essays, of which 500 characters count, with the pairs whose essay starts with them; blank ones meet none."""
    return J.starting_with(
        log_once(spark, d, head=F.left("essay", F.lit(500))).filter(F.col("head").rlike("[^ \\t\\n\\r\\f]")), "log_id", "head",
        once(spark, d, text=F.left("best_essay", F.lit(500))), "pair_id", "text", 500,
    )


@query("join_11_fill_missing", "select d.doc_id, coalesce(d.slop_score, t.s) as slop_score from documents d left join (select topic, max(slop_score) as s from topic_sources where topic is not null group by topic) t using (topic)")
def join_11(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "topic_sources").filter("topic IS NOT NULL").groupBy("topic").agg(F.max("slop_score").alias("slop_score"))
    return J.fill_from(table(spark, d, "documents").select("doc_id", "topic", "slop_score"), best, "topic", ["slop_score"]).select("doc_id", "slop_score")


@query("join_12_positional_zip", """with a as (select doc_id, topic, row_number() over (partition by topic order by doc_id) as n from documents where topic is not null), b as (select log_id, topic, row_number() over (partition by topic order by log_id) as n from (select distinct log_id, topic from essay_log where topic is not null))
 select doc_id, log_id from a join b using (topic, n)""")
def join_12(spark: SparkSession, d: str) -> DataFrame:
    at = lambda key: F.row_number().over(Window.partitionBy("topic").orderBy(key))
    a = table(spark, d, "documents").select("doc_id", "topic").filter("topic IS NOT NULL").withColumn("n", at("doc_id"))
    b = log_once(spark, d, "topic").filter("topic IS NOT NULL").withColumn("n", at("log_id"))
    return a.join(b, ["topic", "n"]).select("doc_id", "log_id")


@query("join_13_resume", "select distinct log_id from essay_log where log_id not in (select log_id from essay_log where constraint_ok)")
def join_13(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "essay_log")
    return e.select("log_id").distinct().join(e.filter("constraint_ok").select("log_id"), "log_id", "left_anti")


@query("join_14_mirror_pairs", f"select a.pair_id, length(a.best_essay) as best_chars, length(b.baseline_essay) as baseline_chars from {ONCE_SQL} a join {ONCE_SQL} b using (pair_id) where a.best_essay is not null and b.baseline_essay is not null")
def join_14(spark: SparkSession, d: str) -> DataFrame:
    side = lambda c, out: once(spark, d, **{out: F.length(c).cast("long")}).filter(F.col(out).isNotNull())
    return side("best_essay", "best_chars").join(side("baseline_essay", "baseline_chars"), "pair_id")


# ---- deduplication and ranking -----------------------------------------------------------------


@query("win_01_exact_dedup", "select min(doc_id) as doc_id from documents group by text")
def win_01(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.xxhash64(F.lit(1), "text").alias("a"), F.xxhash64(F.lit(2), "text").alias("b"), F.col("text").isNull().alias("none"))
    return t.groupBy("a", "b", "none").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("win_02_composite_dedup", "select min(log_id) as log_id, topic, mutation_op, generation from essay_log group by topic, mutation_op, generation")
def win_02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "essay_log").groupBy("topic", "mutation_op", "generation").agg(F.min("log_id").alias("log_id"))


@query("win_04_ordered_distinct", "select topic, row_number() over (order by first) as position from (select topic, min(doc_id) as first from documents where topic is not null group by topic)")
def win_04(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(table(spark, d, "documents").filter("topic IS NOT NULL").groupBy("topic").agg(F.min("doc_id").alias("first")), "first", "position").select("topic", "position")


@query("win_05_few_shot_pool", f"select log_id, slop_score from (select log_id, slop_score, row_number() over (partition by left(essay, 4000) order by slop_score, log_id) as n from {LOG_ONCE_SQL} where essay is not null and slop_score is not null) where n = 1 order by slop_score, log_id limit 100")
def win_05(spark: SparkSession, d: str) -> DataFrame:
    head = F.left("essay", F.lit(4000))
    e = log_once(spark, d, "slop_score", a=F.xxhash64(F.lit(1), head), b=F.xxhash64(F.lit(2), head), some=F.col("essay").isNotNull()).filter("some AND slop_score IS NOT NULL")
    best = e.groupBy("a", "b").agg(F.min(F.struct("slop_score", "log_id")).alias("m")).select("m.*")
    return best.orderBy("slop_score", "log_id").limit(100).select("log_id", "slop_score")


@query("win_06_best_per_prompt", f"select pair_id from (select pair_id, row_number() over (partition by output_prompt order by improvement desc nulls last, pair_id) as n from {ONCE_SQL}) where n = 1")
def win_06(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "output_prompt", "improvement")
    return J.first_per(p, ["output_prompt"], [desc("improvement"), "pair_id"], ["pair_id"]).select("pair_id")


@query("win_07_best_per_topic", f"select topic, pair_id, output_slop_score from (select *, row_number() over (partition by topic order by output_slop_score, pair_id) as n from {ONCE_SQL} where output_slop_score is not null) where n = 1")
def win_07(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "output_slop_score").filter("output_slop_score IS NOT NULL")
    return p.groupBy("topic").agg(F.min(F.struct("output_slop_score", "pair_id")).alias("m")).select("topic", "m.pair_id", "m.output_slop_score")


@query("win_08_best_gap", f"select topic, pair_id, round(gap, 6) as gap from (select topic, pair_id, input_slop_score - output_slop_score as gap, row_number() over (partition by topic order by input_slop_score - output_slop_score desc, pair_id) as n from {ONCE_SQL} where input_slop_score is not null and output_slop_score is not null) where n = 1")
def win_08(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "input_slop_score", "output_slop_score").withColumn("gap", F.expr("input_slop_score - output_slop_score")).filter("gap IS NOT NULL")
    return J.first_per(p, ["topic"], [desc("gap"), "pair_id"], ["pair_id", "gap"]).select("topic", "pair_id", r6("gap").alias("gap"))


@query("win_09_scored_beats_unscored", "select topic, source_passage from (select topic, source_passage, row_number() over (partition by topic order by slop_score nulls last, case when slop_score is null then -round_num else 0 end, source_passage) as n from topic_sources where topic is not null) where n = 1")
def win_09(spark: SparkSession, d: str) -> DataFrame:
    late = F.when(F.col("slop_score").isNull(), -F.col("round_num")).otherwise(0)
    t = table(spark, d, "topic_sources").filter("topic IS NOT NULL")
    return J.first_per(t, ["topic"], [F.col("slop_score").asc_nulls_last(), late.asc_nulls_last(), "source_passage"], ["source_passage"])


@query("win_10_ratchet", f"select log_id from (select log_id, slop_score, min(slop_score) over (partition by topic order by generation, log_id rows between unbounded preceding and 1 preceding) as best from {LOG_ONCE_SQL} where slop_score is not null and generation is not null) where best is null or slop_score < best")
def win_10(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "topic", "generation", "slop_score").filter("slop_score IS NOT NULL AND generation IS NOT NULL")
    e = ranks.score_ranges(e, F.col("generation"), "log_id")
    return ranks.prefix(e, ["topic"], ["generation", "log_id"], F.col("slop_score"), "best", least=True).filter("best IS NULL OR slop_score < best").select("log_id")


@query("win_11_top_per_source", f"select topic, pair_id from (select topic, pair_id, row_number() over (partition by topic order by improvement desc nulls last, input_slop_score desc nulls last, pair_id) as n from {ONCE_SQL}) where n <= 2")
def win_11(spark: SparkSession, d: str) -> DataFrame:
    return J.top_per(once(spark, d, "topic", "improvement", "input_slop_score"), ["topic"], [desc("improvement"), desc("input_slop_score"), "pair_id"], 2).select("topic", "pair_id")


@query("win_12_hard_pack", f"""with p as (select pair_id, topic_source, row_number() over (partition by topic_source order by output_slop_score desc nulls last, pair_id) as a, row_number() over (partition by topic_source order by improvement nulls last, pair_id) as b, count(*) over (partition by topic_source) as n from {ONCE_SQL})
 select pair_id, case when b <= greatest(1, cast(floor(n * 0.3) as bigint)) then 'low_delta' else 'high_score' end as reason from p where a <= greatest(1, cast(floor(n * 0.5) as bigint)) or b <= greatest(1, cast(floor(n * 0.3) as bigint))""")
def win_12(spark: SparkSession, d: str) -> DataFrame:
    return S.hard_pack(once(spark, d, "topic_source", "output_slop_score", "improvement"), "topic_source", "pair_id", "output_slop_score", "improvement")


@query("win_13_extremes", f"select topic, arg_min(log_id, (slop_score, log_id)) as chosen, arg_max(log_id, (slop_score, -log_id)) as rejected from {LOG_ONCE_SQL} where slop_score is not null group by topic having count(*) >= 2")
def win_13(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "topic", "slop_score").filter("slop_score IS NOT NULL")
    g = e.groupBy("topic").agg(F.min_by("log_id", F.struct("slop_score", "log_id")).alias("chosen"), F.max_by("log_id", F.struct("slop_score", -F.col("log_id"))).alias("rejected"), F.count("*").alias("n"))
    return g.filter("n >= 2").drop("n")


LEADER_KEYS = "pass_rate desc, mean_delta desc, mean_output"


@query("win_14_leaderboard", f"""with g as (select mutation_op, round(avg(case when improvement >= 0.1 then 1.0 else 0.0 end), 9) as pass_rate, round(coalesce(avg(improvement), 0), 9) as mean_delta, round(coalesce(avg(output_slop_score), 1.0), 9) as mean_output from {ONCE_SQL} where mutation_op is not null group by mutation_op)
 select mutation_op, row_number() over (order by {LEADER_KEYS}, mutation_op) as rank, round(pass_rate, 6) as pass_rate, round(mean_delta - first_value(mean_delta) over (order by {LEADER_KEYS}, mutation_op), 6) as delta_from_leader, round(pass_rate - first_value(pass_rate) over (order by {LEADER_KEYS}, mutation_op), 6) as pass_rate_from_leader from g""")
def win_14(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "mutation_op", "improvement", "output_slop_score").filter("mutation_op IS NOT NULL")
    g = p.groupBy("mutation_op").agg(
        F.round(F.avg(F.when(F.col("improvement") >= 0.1, 1.0).otherwise(0.0)), 9).alias("pass_rate"),
        F.round(F.coalesce(F.avg("improvement"), F.lit(0.0)), 9).alias("mean_delta"), F.round(F.coalesce(F.avg("output_slop_score"), F.lit(1.0)), 9).alias("mean_output"),
    )
    return S.leaderboard(g, [F.desc("pass_rate"), F.desc("mean_delta"), "mean_output", "mutation_op"], "mean_delta", "pass_rate").select(
        "mutation_op", "rank", r6("pass_rate").alias("pass_rate"), r6("delta_from_leader").alias("delta_from_leader"), r6("pass_rate_from_leader").alias("pass_rate_from_leader")
    )


@query("win_15_sort_and_limit", f"select pair_id from {ONCE_SQL} order by coalesce(input_slop_score, 0.0) desc, pair_id limit 40")
def win_15(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "input_slop_score").orderBy(F.coalesce("input_slop_score", F.lit(0.0)).desc(), "pair_id").limit(40).select("pair_id")


@query("win_16_stratified_head", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) where n <= 10")
def win_16(spark: SparkSession, d: str) -> DataFrame:
    return J.top_per(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 10)


@query("win_17_tournament", f"select log_id from {LOG_ONCE_SQL} where slop_score is not null order by -slop_score desc, log_id limit 20")
def win_17(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "slop_score").filter("slop_score IS NOT NULL").orderBy("slop_score", "log_id").limit(20).select("log_id")


@query("win_18_best_ever", f"select topic, generation, round(min(min(slop_score)) over (partition by topic order by generation), 6) as best from {LOG_ONCE_SQL} where slop_score is not null and generation is not null group by topic, generation")
def win_18(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "topic", "generation", "slop_score").filter("slop_score IS NOT NULL AND generation IS NOT NULL").groupBy("topic", "generation").agg(F.min("slop_score").alias("m"))
    w = Window.partitionBy("topic").orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("topic", "generation", r6(F.min("m").over(w)).alias("best"))


@query("win_19_curriculum", f"select pair_id, row_number() over (partition by topic_source order by coalesce(improvement, 0) desc, pair_id) as position from {ONCE_SQL}")
def win_19(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic_source", "improvement")
    return ranks.ranks(p, ["topic_source"], -F.coalesce("improvement", F.lit(0.0)), "pair_id", "position").select("pair_id", F.col("position").cast("int"))


def _z(kind: str, name: str, group: str, one: str) -> None:
    sql = f"select log_id, round((slop_score - avg(slop_score) over w) / (coalesce({kind}(slop_score) over w, {one}) + 1e-8), 6) as z from {LOG_ONCE_SQL} where slop_score is not null window w as (partition by {group})"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        keys = group.split(", ")
        e = log_once(spark, d, "slop_score", *keys).filter("slop_score IS NOT NULL")
        return S.standardized(e, keys, "slop_score", "z", sample=kind == "stddev_samp").select("log_id", r6("z").alias("z"))


_z("stddev_samp", "win_20_batch_z", "generation", "1.0")
_z("stddev_samp", "win_21_batch_advantage", "mutation_op", "1.0")
_z("stddev_pop", "win_22_group_advantage", "topic, generation", "0.0")


@query("win_24_plateau", f"""with g as (select topic, generation, min(slop_score) as m from {LOG_ONCE_SQL} where slop_score is not null and generation is not null group by topic, generation), x as (select topic, generation, lag(m) over (partition by topic order by generation) - m as gain from g)
 select topic, generation, coalesce(count(gain) over w >= 2 and bool_and(coalesce(gain < 0.01, false)) over w, false) as stop from x window w as (partition by topic order by generation rows between 1 preceding and current row)""")
def win_24(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "topic", "generation", "slop_score").filter("slop_score IS NOT NULL AND generation IS NOT NULL").groupBy("topic", "generation").agg(F.min("slop_score").alias("m"))
    return S.plateau(g, ["topic"], "generation", "m", patience=2, epsilon=0.01)


@query("win_25_early_stop", f"""with g as (select topic, generation, min(slop_score) as m from {LOG_ONCE_SQL} where slop_score is not null and generation is not null group by topic, generation),
 b as (select *, min(m) over (partition by topic order by generation rows between unbounded preceding and 1 preceding) as best, row_number() over (partition by topic order by generation) as i from g),
 c as (select *, max(case when best is null or m < best then i end) over (partition by topic order by generation) as last from b) select topic, generation, i - last as since_best, i - last >= 2 as stop from c""")
def win_25(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "topic", "generation", "slop_score").filter("slop_score IS NOT NULL AND generation IS NOT NULL").groupBy("topic", "generation").agg(F.min("slop_score").alias("m"))
    return S.evals_since_best(g, ["topic"], "generation", "m", patience=2)


@query("win_26_time_to_result", f"select t.threshold, e.topic, min(e.generation) as first_generation from {LOG_ONCE_SQL} e join (select unnest([0.2, 0.4, 0.6])::double as threshold) t on e.slop_score <= t.threshold group by t.threshold, e.topic")
def win_26(spark: SparkSession, d: str) -> DataFrame:
    reached = F.explode(F.filter(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.6)), lambda t: F.col("slop_score") <= t)).alias("threshold")
    e = log_once(spark, d, "topic", "generation", "slop_score").select("topic", "generation", reached)
    return e.groupBy("threshold", "topic").agg(F.min("generation").alias("first_generation"))


@query("win_27_first_seen", f"select prompt_id, min(generation) as first_generation from {LOG_ONCE_SQL} group by prompt_id")
def win_27(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "prompt_id", "generation").groupBy("prompt_id").agg(F.min("generation").alias("first_generation"))


@query("win_29_top_and_bottom", "(select doc_id, 'low' as side from documents where slop_score is not null order by slop_score, doc_id limit 5) union all (select doc_id, 'high' from documents where slop_score is not null order by slop_score desc, doc_id limit 5)")
def win_29(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("slop_score IS NOT NULL").select("doc_id", "slop_score")
    low = t.orderBy("slop_score", "doc_id").limit(5).select("doc_id", F.lit("low").alias("side"))
    return low.unionByName(t.orderBy(F.desc("slop_score"), "doc_id").limit(5).select("doc_id", F.lit("high").alias("side")))


@query("win_30_trajectories", f"""with e as (select topic, log_id, row_number() over (partition by topic order by generation nulls first, log_id) as i, count(*) over (partition by topic) as n, lead(log_id) over (partition by topic order by generation nulls first, log_id) as nxt, first_value(log_id) over (partition by topic order by generation nulls first, log_id) as f from {LOG_ONCE_SQL})
 select topic, log_id as a, nxt as b, 'step' as kind from e where nxt is not null union all select topic, f, log_id, 'ends' from e where i = n and n > 2""")
def win_30(spark: SparkSession, d: str) -> DataFrame:
    return S.trajectories(log_once(spark, d, "topic", "generation"), ["topic"], ["generation", "log_id"], "log_id")


@query("win_31_most_recent", "select doc_id, received_at from documents where received_at is not null order by received_at desc, doc_id limit 10")
def win_31(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("received_at IS NOT NULL").select("doc_id", "received_at").orderBy(F.desc("received_at"), "doc_id").limit(10)


@query("win_32_nearest_member", f"with c as ({CENT_SQL}), x as (select e.label, vec_id, round(sqrt(list_sum([(a - b) ** 2 for a, b in list_zip_dummy])), 9) as dist from embeddings e join c using (label)) select * from x".replace("list_sum([(a - b) ** 2 for a, b in list_zip_dummy])", f"list_dot_product({VEC}, {VEC}) + list_dot_product(c.c, c.c) - 2 * list_dot_product({VEC}, c.c)").replace("select * from x", "select label, arg_min(vec_id, (dist, vec_id)) as vec_id from x group by label"))
def win_32(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    far = F.round(F.sqrt(F.aggregate(F.zip_with("v", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)), 9)
    j = e.join(J.centroids(e, "label", "v"), "label").select("label", "vec_id", far.alias("dist"))
    return j.groupBy("label").agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("label", "m.vec_id")


@query("win_33_frequent_and_best", f"select topic, count(*) as n, round(min(output_slop_score), 6) as best from {ONCE_SQL} where topic is not null group by topic order by n desc, topic limit 20")
def win_33(spark: SparkSession, d: str) -> DataFrame:
    g = once(spark, d, "topic", "output_slop_score").filter("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("n"), r6(F.min("output_slop_score")).alias("best"))
    return g.orderBy(F.desc("n"), "topic").limit(20)


@query("win_36_candidates", f"select topic, pair_id from (select topic, pair_id, row_number() over (partition by topic order by first) as n from (select topic, output_prompt, min(pair_id) as pair_id, min(pair_id) as first from {ONCE_SQL} where output_prompt is not null group by topic, output_prompt)) where n <= 3")
def win_36(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "output_prompt").filter("output_prompt IS NOT NULL").groupBy("topic", "output_prompt").agg(F.min("pair_id").alias("pair_id"))
    return J.top_per(p, ["topic"], ["pair_id"], 3).select("topic", "pair_id")


# ---- sets, samples, splits ---------------------------------------------------------------------


@query("set_01_union_all", "select topic, slop_score from documents union all select topic, slop_score from essay_log union all select topic, slop_score from topic_sources")
def set_01(spark: SparkSession, d: str) -> DataFrame:
    part = lambda t: table(spark, d, t).select("topic", "slop_score")
    return part("documents").unionByName(part("essay_log")).unionByName(part("topic_sources"))


@query("set_02_union_with_tag", "select pair_id, coalesce(topic_source, 'organic') as origin from prompt_pairs union all select example_id, 'token_example' from slop_examples")
def set_02(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "prompt_pairs").select("pair_id", F.coalesce("topic_source", F.lit("organic")).alias("origin"))
    return a.unionByName(table(spark, d, "slop_examples").select(F.col("example_id").alias("pair_id"), F.lit("token_example").alias("origin")))


@query("set_03_keyed_overwrite", f"select doc_id, coalesce(q.weight, p.weight) as weight from (select doc_id, 1 as weight from documents where slop_score > 0.3) p full join (select doc_id, 3 as weight from documents where slop_score > 0.7) q using (doc_id)")
def set_03(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "slop_score")
    part = lambda low, w: t.filter(F.col("slop_score") > low).select("doc_id", F.lit(w).alias("weight"))
    return J.keyed_overwrite([part(0.3, 1), part(0.7, 3)], "doc_id")


@query("set_04_except", "select topic from topic_sources where topic is not null except select topic from documents")
def set_04(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_sources").select("topic").filter("topic IS NOT NULL").subtract(table(spark, d, "documents").select("topic"))


@query("set_05_provider_merge", f"select topic, 'human' as kind, min(source_passage) as text from topic_sources where topic is not null group by topic union all select topic, 'ai', essay from {LOG_ONCE_SQL} where topic is not null and essay is not null")
def set_05(spark: SparkSession, d: str) -> DataFrame:
    human = table(spark, d, "topic_sources").filter("topic IS NOT NULL").groupBy("topic").agg(F.min("source_passage").alias("text")).select("topic", F.lit("human").alias("kind"), "text")
    ai = log_once(spark, d, "topic", "essay").filter("topic IS NOT NULL AND essay IS NOT NULL")
    return human.unionByName(ai.select("topic", F.lit("ai").alias("kind"), F.col("essay").alias("text")))


@query("set_06_baseline_row", f"select * from (select -1 as generation, cast(1.0 as double) as mean_slop union all select generation, round(avg(slop_score), 6) from {LOG_ONCE_SQL} where generation is not null group by generation) order by generation")
def set_06(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "generation", "slop_score").filter("generation IS NOT NULL").groupBy("generation").agg(r6(F.avg("slop_score")).alias("mean_slop"))
    return spark.sql("SELECT -1 AS generation, 1.0D AS mean_slop").unionByName(g).orderBy("generation")


@query("smp_01_shuffle_and_cut", "select doc_id, row_number() over (order by md5('42|' || doc_id), doc_id) as position from documents order by position limit 100")
def smp_01(spark: SparkSession, d: str) -> DataFrame:
    return S.ranked(S.shuffled(table(spark, d, "documents").select("doc_id"), 42, "doc_id").limit(100), "__h", "position", ["doc_id"]).select("doc_id", "position")


@query("smp_02_split_counts", "select pool_config_id, least(train_size, 2000) as train, least(val_size, greatest(0, 2000 - train_size)) as val, least(test_size, greatest(0, 2000 - train_size - val_size)) as test from pool_config")
def smp_02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pool_config").select("pool_config_id", *S.split_counts(F.lit(2000), F.col("train_size"), F.col("val_size"), F.col("test_size")))


def _stratified(name: str, tab: str, key: str, stratum: str, seed: int) -> None:
    sql = f"select {key}, case when n <= greatest(1, cast(floor(c * cast(0.8 as double)) as bigint)) then 'train' when n <= greatest(1, cast(floor(c * cast(0.8 as double)) as bigint)) + greatest(1, cast(floor(c * cast(0.1 as double)) as bigint)) then 'val' else 'test' end as split from (select {key}, row_number() over (partition by {stratum} order by md5('{seed}|' || {key}), {key}) as n, count(*) over (partition by {stratum}) as c from {tab})"

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return S.stratified_split(table(spark, d, tab).select(key, stratum), key, stratum, 0.8, 0.1, seed).select(key, "split")


_stratified("smp_03_stratified_by_difficulty", "slop_examples", "example_id", "difficulty", 42)
_stratified("smp_04_stratified_by_domain", "documents", "doc_id", "domain_bucket", 7)
_stratified("smp_05_stratified_by_label", "doc_labels", "doc_id", "toxic", 9)


@query("smp_06_stable_ids", f"select pair_id, sha256(concat_ws(chr(10), trim(coalesce(topic, '')), trim(coalesce(input_prompt, '')), trim(coalesce(output_prompt, '')))) as row_id from {ONCE_SQL}")
def smp_06(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "topic", "input_prompt", "output_prompt").select("pair_id", S.stable_id(["topic", "input_prompt", "output_prompt"]).alias("row_id"))


@query("smp_07_weighted_copies", "select doc_id, 1 + (case when cast('0x' || left(md5('3|' || doc_id), 8) as bigint) / 4294967296.0 < 0.5 then 1 else 0 end) as copies from documents where source = 'forum_replies'")
def smp_07(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_copies(table(spark, d, "documents").filter("source = 'forum_replies'").select("doc_id"), "doc_id", 1.5, 3)


@query("smp_08_recency", "with l as (select doc_id, topic, created_at, row_number() over (partition by domain_bucket order by created_at desc nulls last, doc_id) as n, count(*) over (partition by domain_bucket) as c from documents) select doc_id, cast(unnest(range(0, case when n <= cast(floor(c * 0.5) as bigint) then 2 else 1 end)) as int) as copy from l")
def smp_08(spark: SparkSession, d: str) -> DataFrame:
    return S.recency_upweighted(table(spark, d, "documents").select("doc_id", "domain_bucket", "created_at"), "domain_bucket", [desc("created_at"), "doc_id"], 1.5).select("doc_id", "copy")


@query("smp_09_sample", "select doc_id from documents order by md5('8|' || doc_id), doc_id limit 50")
def smp_09(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled(table(spark, d, "documents").select("doc_id"), 8, "doc_id").limit(50).select("doc_id")


@query("smp_10_cap_after_shuffle", "select log_id from (select distinct log_id from essay_log) order by md5('5|' || log_id), log_id limit 300")
def smp_10(spark: SparkSession, d: str) -> DataFrame:
    return S.shuffled(table(spark, d, "essay_log").select("log_id").distinct(), 5, "log_id").limit(300).select("log_id")


@query("smp_11_curriculum_weights", "select e.example_id, w.stage, w.weight from slop_examples e join (values ('easy', 'early', 0.6), ('medium', 'early', 0.3), ('hard', 'early', 0.1), ('easy', 'late', 0.2), ('medium', 'late', 0.3), ('hard', 'late', 0.5)) w(difficulty, stage, weight) using (difficulty)".replace("w.weight", "cast(w.weight as double) as weight"))
def smp_11(spark: SparkSession, d: str) -> DataFrame:
    return S.with_stage_weights(table(spark, d, "slop_examples").select("example_id", "difficulty"), "difficulty")


__all__ = ["X", "pool", "POOL_SQL", "w_sql"]
