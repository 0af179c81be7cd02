"""Queries of sources, filters and projections (SRC-*, SNK-04, FLT-*, PRJ-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.operators import rows as R
from prosemill.plans.catalogue import list_sql, norm_sql, query, r6, strip_sql, w_sql
from prosemill.session import table

N_WORDS = lambda t: f"len({w_sql(t)})"
ONCE_SQL = "(select pair_id, any_value(topic) as topic, any_value(topic_source) as topic_source, any_value(input_prompt) as input_prompt, any_value(output_prompt) as output_prompt, any_value(input_slop_score) as input_slop_score, any_value(output_slop_score) as output_slop_score, any_value(improvement) as improvement, any_value(mutation_op) as mutation_op, any_value(round_num) as round_num, any_value(best_essay) as best_essay, any_value(baseline_essay) as baseline_essay, any_value(logged_at) as logged_at from prompt_pairs group by pair_id)"
LOG_ONCE_SQL = "(select log_id, any_value(topic) as topic, any_value(essay) as essay, any_value(slop_score) as slop_score, any_value(optimization_slop) as optimization_slop, any_value(drift_penalty) as drift_penalty, any_value(constraint_ok) as constraint_ok, any_value(constraint_reason) as constraint_reason, any_value(generation) as generation, any_value(prompt_id) as prompt_id, any_value(mutation_op) as mutation_op, any_value(domain_bucket) as domain_bucket, any_value(logged_at) as logged_at from essay_log group by log_id)"


def once(spark: SparkSession, d: str, *columns: str, **made: Column) -> DataFrame:
    """The pair log, each pair once, with columns made from it.

    What is delivered again is equal, so columns are made before the shuffle
    that drops it: texts that are only measured don't travel.
    """
    return table(spark, d, "prompt_pairs").select("pair_id", *columns, *[c.alias(n) for n, c in made.items()]).dropDuplicates(["pair_id"])


def log_once(spark: SparkSession, d: str, *columns: str, **made: Column) -> DataFrame:
    """The essay log, each entry once, with columns made from it."""
    return table(spark, d, "essay_log").select("log_id", *columns, *[c.alias(n) for n, c in made.items()]).dropDuplicates(["log_id"])


def essay_ratio() -> Column:
    """Words of the best essay per word of the baseline."""
    return X.ratio(X.word_count(F.col("best_essay")), X.word_count(F.col("baseline_essay")))


def essay_overlap() -> Column:
    return R.word_overlap(X.words(F.col("best_essay")), X.words(F.col("baseline_essay")))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """source_pool, each id once, the last delivery."""
    last = F.max_by(F.struct("domain_bucket", "text", "split"), F.struct("loaded_at", F.coalesce("text", F.lit(""))))
    return table(spark, d, "source_pool").groupBy("id").agg(last.alias("r")).select("id", "r.*").withColumn("source", F.regexp_extract("id", "^[a-z]+", 0))


POOL_SQL = "(select id, domain_bucket, text, split, regexp_extract(id, '^[a-z]+') as source from (select *, row_number() over (partition by id order by loaded_at desc, coalesce(text, '') desc) as n from source_pool) where n = 1)"


# ---- sources -----------------------------------------------------------------------------------


@query("src_07_human_texts", f"select min(doc_id) as doc_id, text from documents where source = 'pangram_human' and {N_WORDS('text')} between 20 and 400 group by text")
def src_07(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("source = 'pangram_human'").select("doc_id", "text")
    return t.filter(X.word_count(F.col("text")).between(20, 400)).groupBy("text").agg(F.min("doc_id").alias("doc_id"))


@query("src_08_essays", f"select doc_id, array_to_string(({w_sql('text')})[1:120], ' ') as text from documents where source = 'aeon_essays' and {N_WORDS('text')} >= 30")
def src_08(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("source = 'aeon_essays'").select("doc_id", "text").filter(X.word_count(F.col("text")) >= 30)
    return t.select("doc_id", F.array_join(F.slice(X.words(F.col("text")), 1, 120), " ").alias("text"))


@query("src_09_rendered_qa", f"select pair_id, 'Question: ' || input_prompt || chr(10) || 'Answer: ' || output_prompt as text from {ONCE_SQL} where trim(input_prompt) <> '' and trim(output_prompt) <> ''")
def src_09(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_prompt", "output_prompt").filter("trim(input_prompt) <> '' AND trim(output_prompt) <> ''")
    return p.select("pair_id", R.render_qa(F.col("input_prompt"), F.col("output_prompt")).alias("text"))


@query("snk_04_chosen_columns", "select domain_bucket, id, source_dataset from source_pool")
def snk_04(spark: SparkSession, d: str) -> DataFrame:
    return R.chosen_columns(table(spark, d, "source_pool"), ["domain_bucket", "id", "source_dataset", "not_there"])


# ---- filters -----------------------------------------------------------------------------------


@query("flt_01_trim_window", f"select doc_id, case when {N_WORDS('text')} > 100 then array_to_string(({w_sql('text')})[1:100], ' ') else text end as text from documents where {N_WORDS('text')} >= 20")
def flt_01(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.trim_window(F.col("text"), 20, 100).alias("text"))
    return t.filter("text IS NOT NULL")


@query("flt_02_length_between", "select doc_id from documents where length(text) between 200 and 1000")
def flt_02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length("text").between(200, 1000)).select("doc_id")


@query("flt_03_least_length", f"select doc_id from documents where length({strip_sql('text')}) >= 10")
def flt_03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.length(X.strip(F.col("text"))) >= 10).select("doc_id")


@query("flt_04_instruction_cascade", f"select pair_id from {ONCE_SQL} where length(input_prompt) <= 700 and ({' or '.join(f'contains(lower(input_prompt), {chr(39)}{k}{chr(39)})' for k in R.INSTRUCTION_KEYWORDS)}) and {N_WORDS('output_prompt')} between 50 and 500")
def flt_04(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_prompt", "output_prompt")
    return p.filter(R.instruction_kept(F.col("input_prompt"), F.col("output_prompt"), most_chars=700)).select("pair_id")


@query("flt_05_below_threshold", "select doc_id, slop_score from documents where slop_score < 0.3")
def flt_05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("slop_score < 0.3").select("doc_id", "slop_score")


RATIO_SQL = f"({N_WORDS('best_essay')} / greatest(cast({N_WORDS('baseline_essay')} as double), 1.0))"


@query("flt_06_ratio_and_delta", f"select pair_id from {ONCE_SQL} where {RATIO_SQL} between 0.8 and 1.3 and input_slop_score - output_slop_score >= 0.1")
def flt_06(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score", ratio=essay_ratio())
    return p.filter(F.col("ratio").between(0.8, 1.3) & (F.col("input_slop_score") - F.col("output_slop_score") >= 0.1)).select("pair_id")


SIM_SQL = f"(len(list_intersect(list_distinct({w_sql('best_essay')}), list_distinct({w_sql('baseline_essay')}))) / greatest(cast(len(list_distinct({w_sql('best_essay')} || {w_sql('baseline_essay')})) as double), 1.0))"


@query("flt_07_similarity_gate", f"select pair_id, round({SIM_SQL}, 6) as similarity from {ONCE_SQL} where {SIM_SQL} >= 0.15 and {RATIO_SQL} between 0.80 and 1.25")
def flt_07(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, s=essay_overlap(), ratio=essay_ratio())
    return p.filter(R.similarity_gate(F.col("s"), F.col("ratio"), 0.15, 0.80, 1.25)).select("pair_id", r6("s").alias("similarity"))


INVALID_SQL = f"({strip_sql('coalesce(best_essay, {0})'.format(chr(39) * 2))} = '' or starts_with(lower({strip_sql('best_essay')}), 'rewrite the following') or {N_WORDS('best_essay')} < 8)"


@query("flt_08_invalid_output", f"select pair_id, coalesce({INVALID_SQL}, true) as invalid from {ONCE_SQL}")
def flt_08(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, invalid=R.invalid_output(F.col("best_essay")))


@query("flt_09_pass_gate", f"select pair_id, ({SIM_SQL} >= 0.1 and {RATIO_SQL} between 0.8 and 1.25 and not coalesce({INVALID_SQL}, true)) as passed from {ONCE_SQL}")
def flt_09(spark: SparkSession, d: str) -> DataFrame:
    gate = R.similarity_gate(essay_overlap(), essay_ratio(), 0.1, 0.8, 1.25)
    return once(spark, d, passed=gate & ~R.invalid_output(F.col("best_essay")))


@query("flt_10_split_or_null", f"select id, split from {POOL_SQL} where split = 'train' or split is null")
def flt_10(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).filter("split = 'train' OR split IS NULL").select("id", "split")


@query("flt_11_constraint_cascade", f"""select doc_id, case when {N_WORDS('text')} < 50 then 'too_short' when {N_WORDS('text')} > 500 then 'too_long'
  when regexp_matches(coalesce(text, ''), '{X.REFUSAL.replace(chr(39), chr(39) * 2)}') then 'refusal' when lower(coalesce(lang, '')) <> 'en' then 'non_english' else 'ok' end as reason from documents""")
def flt_11(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    return t.select("doc_id", R.constraint_reason(F.col("text"), F.col("lang"), 50, 500).alias("reason"))


@query("flt_12_refusals", f"select log_id from {LOG_ONCE_SQL} where regexp_matches(essay, '{X.REFUSAL.replace(chr(39), chr(39) * 2)}')")
def flt_12(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, refused=F.col("essay").rlike(X.REFUSAL)).filter("refused").select("log_id")


@query("flt_13_rollout_length", f"select pair_id from {ONCE_SQL} where {N_WORDS('best_essay')} >= 50 and {N_WORDS('best_essay')} >= 0.40 * {N_WORDS('baseline_essay')}")
def flt_13(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, n=X.word_count(F.col("best_essay")), m=X.word_count(F.col("baseline_essay")))
    return p.filter("n >= 50 AND n >= 0.40D * m").select("pair_id")


@query("flt_14_invalid_counts", f"select generation, count(*) as outputs, sum(case when {N_WORDS('essay')} < 60 then 1 else 0 end)::bigint as invalid from {LOG_ONCE_SQL} group by generation")
def flt_14(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "generation", short=X.word_count(F.col("essay")) < 60)
    return e.groupBy("generation").agg(F.count("*").alias("outputs"), F.count_if("short").alias("invalid"))


@query("flt_15_least_improvement", f"select pair_id from {ONCE_SQL} where coalesce(improvement, 0) >= 0.2")
def flt_15(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "improvement").filter("coalesce(improvement, 0) >= 0.2").select("pair_id")


@query("flt_16_contrastive_gap", f"select pair_id from {ONCE_SQL} where input_slop_score - output_slop_score > 0.1")
def flt_16(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "input_slop_score", "output_slop_score").filter("input_slop_score - output_slop_score > 0.1").select("pair_id")


@query("flt_17_fooling_essays", f"select log_id, essay as text, cast(1.0 as double) as score from {LOG_ONCE_SQL} where constraint_ok and slop_score < 0.3")
def flt_17(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "essay", "constraint_ok", "slop_score").filter("constraint_ok AND slop_score < 0.3").select("log_id", F.col("essay").alias("text"), F.lit(1.0).alias("score"))


@query("flt_18_complete_pairs", f"select pair_id from {ONCE_SQL} where {strip_sql('best_essay')} <> '' and {strip_sql('baseline_essay')} <> '' and topic_source in ('original', 'cross_topic')")
def flt_18(spark: SparkSession, d: str) -> DataFrame:
    complete = (X.strip(F.col("best_essay")) != "") & (X.strip(F.col("baseline_essay")) != "")
    return once(spark, d, "topic_source", complete=complete).filter(F.col("complete") & F.col("topic_source").isin("original", "cross_topic")).select("pair_id")


@query("flt_19_strict_improvements", f"select pair_id, round(input_slop_score - output_slop_score, 6) as improvement from {ONCE_SQL} where output_slop_score < input_slop_score")
def flt_19(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_slop_score", "output_slop_score").filter("output_slop_score < input_slop_score")
    return p.select("pair_id", r6(F.col("input_slop_score") - F.col("output_slop_score")).alias("improvement"))


@query("flt_20_misclassified", "select doc_id, toxic, slop_score from documents join doc_labels using (doc_id) where toxic is not null and slop_score is not null and (slop_score >= 0.5) <> (toxic = 1) order by doc_id limit 5")
def flt_20(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "slop_score").join(table(spark, d, "doc_labels"), "doc_id")
    wrong = j.filter("toxic IS NOT NULL AND slop_score IS NOT NULL AND (slop_score >= 0.5) <> (toxic = 1)")
    return wrong.orderBy("doc_id").limit(5).select("doc_id", "toxic", "slop_score")


# ---- projections -------------------------------------------------------------------------------


@query("prj_01_training_records", f"select pair_id, 'Rewrite the following text so it sounds more natural and human while preserving its meaning and approximate length.' || chr(10) || chr(10) || 'Original text:' || chr(10) || {strip_sql('baseline_essay')} || chr(10) || chr(10) || 'Rewritten text:' || chr(10) as prompt, {strip_sql('best_essay')} as completion from {ONCE_SQL}")
def prj_01(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "baseline_essay", "best_essay").select("pair_id", R.rewrite_prompt(F.col("baseline_essay")).alias("prompt"), X.strip(F.col("best_essay")).alias("completion"))


@query("prj_02_difficulty", f"select pair_id, case when output_slop_score <= 0.10 and input_slop_score >= 0.80 then 'easy' when input_slop_score >= 0.60 and input_slop_score - output_slop_score >= 0.20 then 'medium' else 'hard' end as bucket from {ONCE_SQL}")
def prj_02(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "input_slop_score", "output_slop_score").select("pair_id", R.difficulty(F.col("input_slop_score"), F.col("output_slop_score")).alias("bucket"))


@query("prj_03_acceptance", f"select pair_id, case when input_slop_score - output_slop_score >= 0.15 and {RATIO_SQL} between 0.80 and 1.30 then 'strong' when input_slop_score - output_slop_score >= 0.10 then 'fallback' else 'no_threshold_topk' end as reason from {ONCE_SQL}")
def prj_03(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, reason=R.acceptance(F.col("input_slop_score") - F.col("output_slop_score"), essay_ratio()))


SPEC_SQL = "select gen_config_id, 'Role: editor' || chr(10) || chr(10) || 'Task: Write ' || max_new_tokens || ' tokens.' || chr(10) || chr(10) || 'Constraints:' || chr(10) || chr(10) || '- Keep to the topic' || chr(10) || chr(10) || '- Use temperature ' || temperature || chr(10) || chr(10) || 'Tone: plain' as structured, 'Write ' || max_new_tokens || ' tokens. Keep to the topic. Use temperature ' || temperature || '. plain.' as simple from generation_config"


@query("prj_04_render_spec", SPEC_SQL)
def prj_04(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generation_config")
    spec = {
        "role": F.lit("editor"), "task": F.concat(F.lit("Write "), F.col("max_new_tokens"), F.lit(" tokens.")),
        "constraints": F.array(F.lit("Keep to the topic"), F.concat(F.lit("Use temperature "), F.col("temperature"))), "tone": F.lit("plain"),
    }
    return g.select("gen_config_id", R.render_structured(spec).alias("structured"), R.render_simple(spec).alias("simple"))


@query("prj_05_topic_slots", f"select pair_id, replace(replace(output_prompt, '{{topic}}', topic), '<topic>', topic) as prompt from {ONCE_SQL}")
def prj_05(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "output_prompt", "topic").select("pair_id", R.fill_topic(F.col("output_prompt"), F.col("topic")).alias("prompt"))


@query("prj_06_few_shot_block", f"""select topic, left(string_agg('Example ' || n || ':' || chr(10) || essay, chr(10) || chr(10) order by n), 3500) as block from
 (select topic, essay, row_number() over (partition by topic order by slop_score, log_id) as n from {LOG_ONCE_SQL} where essay is not null and topic is not null and slop_score is not null) where n <= 3 group by topic""")
def prj_06(spark: SparkSession, d: str) -> DataFrame:
    return R.few_shot_blocks(log_once(spark, d, "topic", "essay", "slop_score"), "topic", "essay", "slop_score", "log_id", 3, 3500)


TOPIC_SQL = r"""case when regexp_matches(t, '(?is)^Explain\s+(.+)$') then 'the nature and implications of ' || trim(regexp_extract(t, '(?is)^Explain\s+(.+)$', 1))
 when regexp_matches(t, '(?is)^Describe\s+(.+)$') then trim(regexp_extract(t, '(?is)^Describe\s+(.+)$', 1)) || ' and its significance'
 when regexp_matches(t, '(?is)^Compare\s+(.+?)\s+(?:and|to|with)\s+(.+)$') then 'the relative merits of ' || trim(regexp_extract(t, '(?is)^Compare\s+(.+?)\s+(?:and|to|with)\s+(.+)$', 1)) || ' versus ' || trim(regexp_extract(t, '(?is)^Compare\s+(.+?)\s+(?:and|to|with)\s+(.+)$', 2))
 when regexp_matches(t, '(?is)^Should\s+(.+)$') then 'whether ' || trim(regexp_extract(t, '(?is)^Should\s+(.+)$', 1))
 when regexp_matches(t, '(?is)^What\s+(?:is|are)\s+(.+)$') then trim(regexp_extract(t, '(?is)^What\s+(?:is|are)\s+(.+)$', 1)) || ' and what it means' else t end"""


@query("prj_07_topic_of_instruction", rf"select pair_id, {TOPIC_SQL} as topic from (select pair_id, {strip_sql('regexp_extract(output_prompt, {0}, 1)'.format(chr(39) + chr(92) + 'n' + chr(92) + 'n([^' + chr(92) + 'n]+)' + chr(39)))} as t from {ONCE_SQL})")
def prj_07(spark: SparkSession, d: str) -> DataFrame:
    t = once(spark, d, "output_prompt").select("pair_id", X.strip(F.regexp_extract("output_prompt", r"\n\n([^\n]+)", 1)).alias("t"))
    return t.select("pair_id", R.topic_of_instruction(F.col("t")).alias("topic"))


VARIANT_SQL = "[" + ", ".join(f"replace(p, '{a}', '{b}')" for a, b in R.SUBSTITUTIONS) + "]"


@query("prj_08_variants", f"select pair_id, unnest(([v for v in {VARIANT_SQL} if v <> p])[1:3]) as variant from (select pair_id, {strip_sql('output_prompt')} as p from {ONCE_SQL} where output_prompt is not null)")
def prj_08(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "output_prompt").filter("output_prompt IS NOT NULL").select("pair_id", X.strip(F.col("output_prompt")).alias("p"))
    return p.select("pair_id", F.explode(R.variants(F.col("p"))).alias("variant"))


@query("prj_09_unpivot", f"select pair_id, unnest(['best', 'baseline']) as kind, unnest([best_essay, baseline_essay]) as essay from {ONCE_SQL}")
def prj_09(spark: SparkSession, d: str) -> DataFrame:
    return R.unpivot(once(spark, d, "best_essay", "baseline_essay"), ["pair_id"], {"best": "best_essay", "baseline": "baseline_essay"}, "kind", "essay")


@query("prj_10_score_bucket", "select doc_id, case when slop_score is not null then cast(least(3, greatest(0, floor(greatest(0.0, least(1.0, slop_score)) * 4))) as int) end as bucket from documents")
def prj_10(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.score_bucket(F.col("slop_score"), 4).alias("bucket"))


@query("prj_11_ternary", "select doc_id, case when slop_score is null then null when slop_score < 0.33 then 0 when slop_score < 0.66 then 1 else 2 end as label from documents")
def prj_11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.ternary(F.col("slop_score")).alias("label"))


E4 = "[embedding[1]::double, embedding[2]::double, embedding[3]::double, embedding[4]::double]"


@query("prj_12_expected_bucket", f"select vec_id, round(list_sum([e[i] * (i - 1) for i in range(1, 5)]) / list_sum(e) / 3.0, 6) as score, round(list_max(e) / list_sum(e), 6) as top from (select vec_id, [exp(x) for x in {E4}] as e from embeddings)")
def prj_12(spark: SparkSession, d: str) -> DataFrame:
    p = R.softmax(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", r6(R.expected_bucket(F.col("p"))).alias("score"), r6(F.array_max("p")).alias("top"))


LEN_RATIO = RATIO_SQL


@query("prj_13_combined_reward", f"select pair_id, round(0.6 * (1 - output_slop_score) + 0.3 * improvement + 0.1 * (case when {RATIO_SQL} between 0.40 and 1.60 then 1.0 else greatest(0.0, 1.0 - abs({RATIO_SQL} - 1.0)) end) + 1e-9, 6) as reward from {ONCE_SQL}")
def prj_13(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, reward=r6(R.combined_reward(F.col("output_slop_score"), F.col("improvement"), essay_ratio(), 0.6, 0.3, 0.1) + 1e-9))


@query("prj_14_similarity_reward", f"select pair_id, round((1 - output_slop_score) + 0.25 * {SIM_SQL} - 0.10 * abs(1 - {RATIO_SQL}), 6) as reward from {ONCE_SQL}")
def prj_14(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, reward=r6((1 - F.col("output_slop_score")) + 0.25 * essay_overlap() - 0.10 * F.abs(1 - essay_ratio())))


@query("prj_15_best_objective", f"select topic, arg_max(pair_id, (round(1.0 * (1 - output_slop_score) + 0.35 * input_slop_score, 6), -pair_id)) as pair_id from {ONCE_SQL} where output_slop_score is not null and input_slop_score is not null group by topic")
def prj_15(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "input_slop_score", "output_slop_score").filter("output_slop_score IS NOT NULL AND input_slop_score IS NOT NULL")
    objective = F.struct(r6(1.0 * (1 - F.col("output_slop_score")) + 0.35 * F.col("input_slop_score")).alias("v"), (-F.col("pair_id")).alias("k"))
    return p.groupBy("topic").agg(F.max_by("pair_id", objective).alias("pair_id"))


@query("prj_16_fitness", f"select log_id, case when coalesce(constraint_ok, false) then round(-slop_score + 0.3 * (1 - drift_penalty), 6) else cast('-inf' as double) end as fitness from {LOG_ONCE_SQL}")
def prj_16(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "constraint_ok", "slop_score", "drift_penalty")
    return e.select("log_id", R.fitness(F.col("slop_score"), 1 - F.col("drift_penalty"), F.coalesce("constraint_ok", F.lit(False)), 0.3).alias("fitness"))


@query("prj_17_finite_or_null", f"select log_id, case when isnan(x) or isinf(x) then null else round(x, 6) end as x from (select log_id, case when constraint_ok then slop_score when constraint_ok is null then cast('nan' as double) else cast('-inf' as double) end as x from {LOG_ONCE_SQL})")
def prj_17(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("constraint_ok"), F.col("slop_score")).when(F.col("constraint_ok").isNull(), F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    return log_once(spark, d, "constraint_ok", "slop_score").select("log_id", r6(R.finite(x)).alias("x"))


@query("prj_21_delta", f"select pair_id, round(input_slop_score - output_slop_score, 6) as delta from {ONCE_SQL}")
def prj_21(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "input_slop_score", "output_slop_score").select("pair_id", r6(F.col("input_slop_score") - F.col("output_slop_score")).alias("delta"))


@query("prj_22_mirror_prompt", f"select doc_id, 'Length: between ' || cast(floor({N_WORDS('text')} * cast(0.85 as double)) as int) || ' and ' || cast(floor({N_WORDS('text')} * cast(1.15 as double)) as int) || ' words' as band, array_to_string(({w_sql('text')})[1:40], ' ') as head from documents")
def prj_22(spark: SparkSession, d: str) -> DataFrame:
    w = X.words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", R.length_band(F.size(w)).alias("band"), F.array_join(F.slice(w, 1, 40), " ").alias("head"))


@query("prj_23_prompt_with_context", f"select pair_id, case when {strip_sql('coalesce(topic, {0})'.format(chr(39) * 2))} = '' then input_prompt else input_prompt || chr(10) || chr(10) || 'Context: ' || topic end as prompt from {ONCE_SQL}")
def prj_23(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "input_prompt", "topic").select("pair_id", R.prompt_with_context(F.col("input_prompt"), F.col("topic")).alias("prompt"))


@query("prj_24_human_and_ai_rows", f"select pair_id, unnest([baseline_essay, best_essay]) as text, cast(unnest([0.0, 1.0]) as double) as score from {ONCE_SQL}")
def prj_24(spark: SparkSession, d: str) -> DataFrame:
    return R.human_and_ai(once(spark, d, "baseline_essay", "best_essay"), "pair_id", "baseline_essay", "best_essay")


@query("prj_25_detector_row", "select doc_id, coalesce(text, '') as text, greatest(0.0, least(1.0, coalesce(slop_score, 0.0))) as score, coalesce(domain_bucket, 'unknown') as domain from documents")
def prj_25(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.present(F.col("text")).alias("text"), R.clamp01(F.coalesce("slop_score", F.lit(0.0))).alias("score"), F.coalesce("domain_bucket", F.lit("unknown")).alias("domain"))


@query("prj_28_objective", f"select log_id, round(slop_score + drift_penalty, 6) as objective from {LOG_ONCE_SQL}")
def prj_28(spark: SparkSession, d: str) -> DataFrame:
    return log_once(spark, d, "slop_score", "drift_penalty").select("log_id", r6(F.col("slop_score") + F.col("drift_penalty")).alias("objective"))


@query("prj_29_evasion", f"select mutation_op, count(*) as n, round(1 - avg(slop_score), 6) as evasion from {LOG_ONCE_SQL} where generation = 2 group by mutation_op")
def prj_29(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "mutation_op", "generation", "slop_score").filter("generation = 2")
    return e.groupBy("mutation_op").agg(F.count("*").alias("n"), r6(1 - F.avg("slop_score")).alias("evasion"))


@query("prj_31_answer_reward", f"select pair_id, round(coalesce(output_slop_score, 0.0) + 0.5 * (case when improvement < 0 then 1 else 0 end) - 0.01 * greatest(1, {N_WORDS('output_prompt')}), 6) as reward from {ONCE_SQL}")
def prj_31(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "output_slop_score", "improvement", n=X.word_count(F.col("output_prompt")))
    wrong = F.when(F.col("improvement") < 0, 1).otherwise(0)
    return p.select("pair_id", r6(F.coalesce("output_slop_score", F.lit(0.0)) + 0.5 * wrong - 0.01 * F.greatest(F.lit(1), F.col("n"))).alias("reward"))


__all__ = ["POOL_SQL", "ONCE_SQL", "LOG_ONCE_SQL", "log_once", "once", "pool", "list_sql", "norm_sql", "Column"]
