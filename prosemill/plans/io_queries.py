"""Queries that write tables to the shared folder and read them back, and adapters with stand-ins (SRC-*, SNK-*, ML-*, PRJ-30)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.operators import evaluate as E
from prosemill.operators import models as M
from prosemill.operators import search, synth
from prosemill.plans.catalogue import query, r6
from prosemill.plans.row_queries import LOG_ONCE_SQL, ONCE_SQL, log_once, once, pool
from prosemill.session import checkpoint_dir, table
from prosemill.sources import io


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/prosemill-io-{uuid.uuid4().hex}"


@query("src_01_jsonl", "select topic, source_passage, slop_score, round_num from topic_sources")
def src_01(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "topic_sources").select("topic", "source_passage", "slop_score", "round_num")
    io.write_jsonl(t, to)
    return io.read_jsonl(spark, to, t.schema)


@query("src_02_jsonl_required", "select gen_config_id, max_seq_len from generation_config")
def src_02(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "generation_config").select("gen_config_id", "max_seq_len")
    io.write_jsonl(t, to)
    return io.read_jsonl(spark, to, t.schema, missing_ok=False)


@query("src_03_csv", "select topic, cast(round_num as varchar) as round_num from topic_sources where topic is not null and round_num is not null")
def src_03(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "topic_sources").select("topic", "round_num").filter("topic IS NOT NULL AND round_num IS NOT NULL")
    io.write_csv(t, to, ["topic", "round_num"])
    return io.read_csv(spark, to)


@query("src_04_csv_checked", "select cast(pool_config_id as varchar) as pool_config_id, config_name from pool_config")
def src_04(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    io.write_csv(table(spark, d, "pool_config"), to, ["pool_config_id", "config_name"])
    return io.read_csv(spark, to, required=["config_name"])


@query("src_05_json_array", "select gen_config_id, max_new_tokens from generation_config")
def src_05(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "generation_config").select("gen_config_id", "max_new_tokens")
    t.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(to)
    return io.read_json_array(spark, to, t.schema)


@query("src_06_text_lines", "select topic as line from topic_sources where topic is not null and len(string_split(topic, ' ')) >= 5")
def src_06(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    table(spark, d, "topic_sources").filter("topic IS NOT NULL").select(F.col("topic").alias("value")).write.text(to)
    return io.read_clean_lines(spark, to, 5)


@query("src_11_local_export", "select vec_id, label from embeddings")
def src_11(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    table(spark, d, "embeddings").write.parquet(to)
    return spark.read.parquet(to).select("vec_id", "label")


@query("src_13_keywords", "select distinct lower(topic) as keyword from topic_sources where topic is not null and length(topic) < 40")
def src_13(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    table(spark, d, "topic_sources").filter("topic IS NOT NULL").select(F.col("topic").alias("value")).write.text(to)
    return io.read_keywords(spark, to)


@query("snk_01_overwrite", "select pool_config_id, train_size from pool_config")
def snk_01(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "pool_config").select("pool_config_id", "train_size")
    io.write_jsonl(t.limit(0), to)
    io.write_jsonl(t, to)
    return io.read_jsonl(spark, to, t.schema)


@query("snk_02_append", "select pool_config_id from pool_config union all select pool_config_id from pool_config")
def snk_02(spark: SparkSession, d: str) -> DataFrame:
    to, t = folder(spark), table(spark, d, "pool_config").select("pool_config_id")
    io.write_jsonl(t, to)
    io.write_jsonl(t, to, append=True)
    return io.read_jsonl(spark, to, t.schema)


MANIFEST_SQL = f"select count(*) as pairs, count(distinct topic) as topics, round(avg(improvement), 6) as mean_delta from {ONCE_SQL}"


@query("snk_03_manifest", MANIFEST_SQL)
def snk_03(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    m = once(spark, d, "topic", "improvement").agg(F.count("*").alias("pairs"), F.countDistinct("topic").alias("topics"), r6(F.avg("improvement")).alias("mean_delta"))
    io.write_jsonl(m.coalesce(1), to)
    return io.read_jsonl(spark, to, m.schema)


@query("snk_05_markdown", f"select '| ' || coalesce(cast(generation as varchar), '') || ' | ' || n || ' |' as line from (select generation, count(*) as n from {LOG_ONCE_SQL} group by generation)")
def snk_05(spark: SparkSession, d: str) -> DataFrame:
    g = log_once(spark, d, "generation").groupBy("generation").agg(F.count("*").alias("n"))
    lines = io.markdown_table(g).split("\n")[2:]
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("snk_06_fingerprints")
def snk_06(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    io.write_jsonl(table(spark, d, "pool_config").orderBy("pool_config_id").coalesce(1), to)
    return io.fingerprints(spark, f"{to}/*.json").select("sha256")


@query("src_12_topics_file", "select distinct topic from topic_sources where topic is not null")
def src_12(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    lines = table(spark, d, "topic_sources").filter("topic IS NOT NULL").select(F.concat(F.lit("- "), "topic").alias("value")).distinct()
    lines.coalesce(1).write.text(to)
    return io.read_topics(spark, f"{to}/part-*").select("topic")


@query("src_14_latest_checkpoint", "select 'step-' || max(gen_config_id) as name, count(*) as n from generation_config")
def src_14(spark: SparkSession, d: str) -> DataFrame:
    """The newest of several written checkpoints, found through the file system of the folder, and what it holds."""
    to, t = folder(spark), table(spark, d, "generation_config")
    for (k,) in t.select("gen_config_id").collect():  # a fixed table of five rows
        io.write_jsonl(t.filter(F.col("gen_config_id") <= k), f"{to}/step-{k}")
    last = io.latest_checkpoint(spark, to)
    return io.read_jsonl(spark, last, t.schema).agg(F.count("*").alias("n")).select(F.lit(last.rsplit("/", 1)[1]).alias("name"), "n")


@query("smp_12_manifest_reuse", "select true as reused")
def smp_12(spark: SparkSession, d: str) -> DataFrame:
    to = folder(spark)
    io.write_jsonl(table(spark, d, "pool_config").coalesce(1), to)
    sha = io.fingerprints(spark, f"{to}/*.json").first()["sha256"]
    return spark.createDataFrame([(io.manifest_matches(spark, {"source_sha256": sha}, f"{to}/*.json"),)], "reused boolean")


ECHO_SQL = "case when trim(coalesce(best_essay, '')) <> '' then best_essay else 'About: ' || coalesce(output_prompt, '') end"


def _echo() -> M.Generator:
    """A stand-in generator."""
    return lambda prompts: [f"About: {p}" for p in prompts]


@query("prj_30_reuse_or_generate", f"select pair_id, {ECHO_SQL} as essay from {ONCE_SQL}")
def prj_30(spark: SparkSession, d: str) -> DataFrame:
    return M.reuse_or_generate(once(spark, d, "best_essay", "output_prompt"), "output_prompt", "best_essay", "essay", _echo).select("pair_id", "essay")


@query("ml_08_generated", f"select pair_id, 'About: ' || coalesce(input_prompt, '') as text from {ONCE_SQL}")
def ml_08(spark: SparkSession, d: str) -> DataFrame:
    return M.with_generations(once(spark, d, "input_prompt"), "input_prompt", "text", _echo).select("pair_id", "text")


@query("ml_06_chunked_scores")
def ml_06(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in scores of overlapping chunks pooled to documents, plus repetition and length penalties."""
    from prosemill.functions import arrays as A

    docs = X.once(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], w=X.words(F.col("text")))
    chunks = docs.select("doc_id", F.posexplode(A.chunks(F.col("w"), 200)).alias("i", "c")).select("doc_id", F.array_join("c", " ").alias("chunk"))
    pooled = M.with_scores(chunks, "chunk", "s", M.heuristic_scorer).groupBy("doc_id").agg(F.avg("s").alias("mean"), F.max("s").alias("most"))
    penalty = docs.select("doc_id", (0.3 * X.repetition_ratio(F.col("w")) + 0.1 * X.length_penalty(F.size("w"), 50, 2000)).alias("penalty"))
    return penalty.join(pooled, "doc_id", "left").select("doc_id", r6("most").alias("heuristic_score"), r6(-(F.coalesce("mean", F.lit(0.0)) + F.col("penalty"))).alias("reward"))


@query("ml_03_regression")
def ml_03(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_prompt", "input_slop_score").filter("input_prompt IS NOT NULL AND input_slop_score IS NOT NULL")
    f, _ = M.tfidf(p, "input_prompt", "features")
    test = F.pmod(F.xxhash64("pair_id"), F.lit(5)) == 0
    made = M.linear_regression(f.filter(~test), "features", "input_slop_score").transform(f.filter(test))
    return made.agg(F.count("*").alias("n"), *[r6(c).alias(n) for n, c in E.regression_metrics("input_slop_score", "prediction").items()])


RANK_CTE = "(select slop_score, x, rank() over (order by slop_score) + (count(*) over (partition by slop_score) - 1) / 2.0 as ra, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0 as rb from (select slop_score, {0} as x from " + LOG_ONCE_SQL + " where slop_score is not null and {0} is not null))"


@query("win_34_rank_by_spearman", f"select model, spearman, row_number() over (order by spearman desc, model) as rank from (select 'optimization_slop' as model, round(corr(ra, rb), 6) as spearman from {RANK_CTE.format('optimization_slop')} union all select 'drift_penalty', round(corr(ra, rb), 6) from {RANK_CTE.format('drift_penalty')})")
def win_34(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = log_once(spark, d, "slop_score", "optimization_slop", "drift_penalty")
    each = [E.spearman(e, "slop_score", m).select(F.lit(m).alias("model"), r6("spearman").alias("spearman")) for m in ("optimization_slop", "drift_penalty")]
    return each[0].unionByName(each[1]).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("spearman"), "model")))  # a row per model


@query("gen_02_single_rules")
def gen_02(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("text"), F.col("id")
    return pool(spark, d).select("id", *[synth.single_rule(t, k, r, 0.3)["text"].alias(r) for r in synth.RULES])


@query("gen_08_mutated_specs")
def gen_08(spark: SparkSession, d: str) -> DataFrame:
    spec = F.to_json(F.struct(F.lit("plain").alias("tone"), F.lit("general readers").alias("audience")))
    return table(spark, d, "generation_config").select("gen_config_id", synth.mutated_spec(spec, F.col("gen_config_id"), 2).alias("spec"))


@query("gen_10_real_and_fake_answers")
def gen_10(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "output_prompt").filter("topic IS NOT NULL AND output_prompt IS NOT NULL")
    return synth.fake_answers(p, "pair_id", "topic", "output_prompt", 3)


def _spec_score(df: DataFrame) -> DataFrame:
    """A stand-in objective of a specification: plain tone and short format score best."""
    tone = F.when(F.col("spec")["tone"] == "direct", 0.6).when(F.col("spec")["tone"] == "plain", 0.4).otherwise(0.1)
    return df.withColumn("fitness", tone + F.when(F.col("spec")["output_format"] == "one short paragraph", 0.3).otherwise(0.0))


@query("ml_13_prompt_search")
def ml_13(spark: SparkSession, d: str) -> DataFrame:
    seeds = [{"tone": "warm", "audience": r["config_name"]} for r in table(spark, d, "pool_config").select("config_name").orderBy("config_name").collect()]  # a fixed table
    found = search.prompt_search(spark, seeds, _spec_score, rounds=4, size=12, seed=1)
    return spark.createDataFrame([(i, c.fitness, c.found_in, c.origin, c.spec) for i, c in enumerate(found)], "rank int, fitness double, found_in int, origin string, spec map<string,string>").select("rank", "fitness", "found_in", "origin", F.to_json("spec").alias("spec"))


@query("ml_12_refilled_population")
def ml_12(spark: SparkSession, d: str) -> DataFrame:
    seeds = [{"tone": "plain"}, {"tone": "warm"}]
    made = search.refill([search.Candidate(s, fitness=1.0 - i) for i, s in enumerate(seeds)], 20, seeds, 3)
    return spark.createDataFrame([(i, c.origin, ",".join(c.changed)) for i, c in enumerate(made)], "i int, origin string, changed string").groupBy("origin").agg(F.count("*").alias("n"))
