"""Queries that SQL can't say: checked by tests, by row counts here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions import arrays as A
from prosemill.functions import text as X
from prosemill.functions import udfs as U
from prosemill.operators import models as M
from prosemill.operators import sampling as S
from prosemill.operators import search, synth
from prosemill.plans.catalogue import query, r6
from prosemill.plans.row_queries import LOG_ONCE_SQL, ONCE_SQL, log_once, once, pool
from prosemill.session import checkpoint_dir, spread, table


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


@query("txt_35_compression_ratio")
def txt_35(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", r6(U.compression_ratio(F.col("text"))).alias("ratio"))


@query("txt_36_sloppy_spans")
def txt_36(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("doc_id", U.sloppy_spans(F.col("text")).alias("spans"))


@query("txt_37_clean_output")
def txt_37(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "best_essay").select("pair_id", U.cleaned_output(F.col("best_essay")).alias("text"))


# a mark that no text holds stands where a sentence ends
SPACE_SQL = "[\\s\\x0B\\x{85}\\p{Z}]+"
SENTENCES_SQL = f"list_filter(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '^{SPACE_SQL}|{SPACE_SQL}$', '', 'g'), '([.!?]){SPACE_SQL}', '\\1' || chr(7), 'g'), chr(7)), lambda x: x <> '')"


@query("txt_40_sentences", f"select doc_id, i - 1 as i, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {SENTENCES_SQL} as s from documents))")
def txt_40(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(U.sentences(F.col("text"))).alias("i", "sentence"))


@query("txt_41_seed_text", f"select doc_id, left(array_to_string(list_slice({SENTENCES_SQL}, 1, 2), ' '), 400) as seed from documents")
def txt_41(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", U.seed_text(F.col("text")).alias("seed"))


@query("txt_43_keyword_sentences", f"select doc_id, case when len(s) = 0 then 0.0 else round(len(list_filter(s, lambda x: regexp_matches(lower(x), 'cost|report|lesson')))::double / len(s), 6) end as share from (select doc_id, {SENTENCES_SQL} as s from documents)")
def txt_43(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", r6(U.keyword_sentence_share(F.col("text"), ["cost", "report", "lesson"])).alias("share"))


@query("txt_47_corrupted_answers")
def txt_47(spark: SparkSession, d: str) -> DataFrame:
    return synth.fake_answers(pool(spark, d).filter("source = 'defan'").select("id", "domain_bucket", "text"), "id", "domain_bucket", "text", 2)


@query("arr_06_label_examples")
def arr_06(spark: SparkSession, d: str) -> DataFrame:
    return U.label_examples(once(spark, d, "best_essay", "baseline_essay"), "pair_id", "baseline_essay", "best_essay", 64, 32)


@query("arr_06_span_label_examples")
def arr_06_spans(spark: SparkSession, d: str) -> DataFrame:
    return U.label_examples(once(spark, d, "best_essay", "baseline_essay"), "pair_id", "baseline_essay", "best_essay", 64, 32, "spans")


@query("arr_09_subword_means")
def arr_09(spark: SparkSession, d: str) -> DataFrame:
    w = X.words(F.col("text"))
    e = table(spark, d, "slop_examples").select("example_id", w.alias("w")).filter(F.size("w") > 0)
    scores = F.flatten(F.transform("w", lambda x: F.transform(F.sequence(F.lit(1), F.ceil(F.length(x) / 4.0).cast("int")), lambda k: 1.0 / k)))
    return U.subword_means(e.withColumn("s", scores), "example_id", "w", "s")


def _tag_sql(name: str) -> str:
    return f"nullif(trim(regexp_extract(t, '(?is){name}:\\s*(.*?)(?:\\n(?:SYSTEM|USER|STYLE):|\\z)', 1)), '') as {name}"


@query("arr_17_triplets", f"select pair_id, {_tag_sql('system')}, {_tag_sql('user')}, {_tag_sql('style')} from (select pair_id, 'SYSTEM: ' || topic || chr(10) || 'USER: ' || input_prompt || chr(10) || 'STYLE: ' || mutation_op as t from {ONCE_SQL})")
def arr_17(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "topic", "input_prompt", "mutation_op")
    tagged = F.concat(F.lit("SYSTEM: "), F.col("topic"), F.lit("\nUSER: "), F.col("input_prompt"), F.lit("\nSTYLE: "), F.col("mutation_op"))
    p = p.select("pair_id", tagged.alias("t"))
    return p.select("pair_id", *[c.alias(n) for n, c in U.parse_triplet(F.col("t")).items()])


@query("arr_19_rouge_l")
def arr_19(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "best_essay", "baseline_essay").select("pair_id", r6(U.rouge_l_f1(F.col("best_essay"), F.col("baseline_essay"))).alias("rouge_l"))


@query("arr_21_self_bleu")
def arr_21(spark: SparkSession, d: str) -> DataFrame:
    return U.self_bleu(log_once(spark, d, "mutation_op", "essay"), "mutation_op", "essay", "log_id")


@query("gen_01_sloppified")
def gen_01(spark: SparkSession, d: str) -> DataFrame:
    t, k = F.col("text"), F.col("id")
    return pool(spark, d).select("id", *[synth.sloppified(t, k, m)["text"].alias(m) for m in synth.PRESETS])


@query("gen_03_labelled_variants")
def gen_03(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("id", synth.sloppified(F.col("text"), F.col("id"), "hard").alias("r")).select("id", "r.text", "r.labels")


@query("gen_04_candidates")
def gen_04(spark: SparkSession, d: str) -> DataFrame:
    return synth.candidates(pool(spark, d).select("id", "text"), "id", "text")


@query("gen_05_token_examples")
def gen_05(spark: SparkSession, d: str) -> DataFrame:
    return synth.token_examples(pool(spark, d).select("id", "text"), "id", "text", ["easy", "medium", "hard"])


@query("gen_06_slop_pairs")
def gen_06(spark: SparkSession, d: str) -> DataFrame:
    made = [pool(spark, d).select("id", F.col("text").alias("human"), synth.sloppified(F.col("text"), F.col("id"), "medium", k)["text"].alias("slop")) for k in range(2)]
    return made[0].unionByName(made[1]).filter("human IS NOT NULL")


@query("gen_07_corruptions")
def gen_07(spark: SparkSession, d: str) -> DataFrame:
    return synth.corrupted(pool(spark, d).select("id", "text"), "id", "text")


@query("win_03_candidate_dedup")
def win_03(spark: SparkSession, d: str) -> DataFrame:
    c = synth.candidates(pool(spark, d).select("id", "text"), "id", "text")
    return c.groupBy("id").agg(F.count("*").alias("candidates"))


@query("win_23_moving_baseline", f"select topic, round(sum(0.1::double * pow(0.9::double, k - 1) * slop_score) + 1e-9, 6) as baseline from (select topic, slop_score, row_number() over (partition by topic order by log_id desc) as k from {LOG_ONCE_SQL} where slop_score is not null) group by topic")
def win_23(spark: SparkSession, d: str) -> DataFrame:
    e = log_once(spark, d, "topic", "slop_score").filter("slop_score IS NOT NULL")
    return search.moving_baseline(e, "topic", "log_id", "slop_score").select("topic", r6(F.col("baseline") + 1e-9).alias("baseline"))


@query("win_35_top_features")
def win_35(spark: SparkSession, d: str) -> DataFrame:
    p = once(spark, d, "input_prompt", "input_slop_score").filter("input_prompt IS NOT NULL AND input_slop_score IS NOT NULL")
    f, vocabulary = M.tfidf(p, "input_prompt", "features")
    model = M.linear_regression(f, "features", "input_slop_score")
    weights = sorted(zip(vocabulary, model.coefficients.toArray().tolist()), key=lambda x: -abs(x[1]))[:30]
    return spark.createDataFrame([(t, round(w, 9)) for t, w in weights], "term string, weight double")


STABLE_SQL = "sha256(trim(coalesce(topic, '')) || chr(10) || trim(coalesce(input_prompt, '')) || chr(10) || trim(coalesce(output_prompt, '')))"


@query("smp_06_split_manifest", f"""with i as (select distinct {STABLE_SQL} as row_id from {ONCE_SQL}), r as (select row_id, row_number() over (order by md5('42|' || row_id), row_id) as k, count(*) over () as n from i),
 c as (select *, greatest(1, cast(floor(n * 0.8) as bigint)) as a from r)
 select row_id, case when k <= a then 'train' when k <= a + (case when n > 2 then greatest(1, cast(floor(n * 0.1) as bigint)) else least(1, n - a) end) then 'val' else 'test' end as split from c""")
def smp_06_manifest(spark: SparkSession, d: str) -> DataFrame:
    return S.split_manifest(once(spark, d, "topic", "input_prompt", "output_prompt"), ["topic", "input_prompt", "output_prompt"], 42, 0.8, 0.1)


@query("ml_01_kmeans")
def ml_01(spark: SparkSession, d: str) -> DataFrame:
    return M.kmeans(table(spark, d, "embeddings"), "embedding", 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query("ml_02_tfidf")
def ml_02(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    f, _ = M.tfidf(once(spark, d, "input_prompt"), "input_prompt", "features")
    return f.select("pair_id", r6(F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("ml_04_logistic")
def ml_04(spark: SparkSession, d: str) -> DataFrame:
    _, p = M.logistic_regression(table(spark, d, "embeddings").withColumn("y", F.col("label") % 2), "embedding", "y")
    return p.groupBy("y", "prediction").agg(F.count("*").alias("n"))


@query("ml_07_fluency", """with w as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) as w from documents), c as (select w, ln(count(*)::double / (select count(*) from w)) as p from w group by w)
 select doc_id, round(avg(p), 6) as fluency, round(exp(-avg(p)), 4) as perplexity from w join c using (w) group by doc_id""")
def ml_07(spark: SparkSession, d: str) -> DataFrame:
    """Fluency and perplexity of each document under the corpus' own word frequencies; a model's log-probabilities plug in the same way.

    Words are counted per document before the join, so a frequent word is one row a document.
    """
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    words = table(spark, d, "documents").select("doc_id", F.explode(w).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    counts = words.groupBy("w").agg(F.sum("n").alias("c"))
    total = counts.agg(F.sum("c").alias("total"))
    p = words.join(counts, "w").crossJoin(F.broadcast(total))  # one row
    loss = (F.sum(F.col("n") * F.log(F.col("c") / F.col("total"))) / F.sum("n")).alias("f")
    return p.groupBy("doc_id").agg(loss).select("doc_id", r6("f").alias("fluency"), F.round(F.exp(-F.col("f")), 4).alias("perplexity"))


@query("arr_20_greedy_match", """with t as (select vec_id // 4 as t, embedding::double[] as e from embeddings), s as (select a.t, list_cosine_similarity(a.e, b.e) as c, a.e as x, b.e as y from t a join t b on b.t = a.t + 1),
 p as (select t, avg(m) as p from (select t, x, max(c) as m from s group by t, x) group by t), r as (select t, avg(m) as r from (select t, y, max(c) as m from s group by t, y) group by t)
 select p.t, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / (p + r), 6) as f1 from p join r using (t)""")
def arr_20(spark: SparkSession, d: str) -> DataFrame:
    """Greedy token matching (as BERTScore has it) of texts of four token vectors with the text behind each."""
    t = table(spark, d, "embeddings").groupBy(F.expr("vec_id div 4").alias("t")).agg(F.collect_list("embedding").alias("e"))
    both = t.join(t.select((F.col("t") - 1).alias("t"), F.col("e").alias("ref")), "t")
    return both.select("t", *[r6(c).alias(n) for n, c in A.greedy_match(F.col("e"), F.col("ref")).items()])


@query("ml_05_heuristic_scores")
def ml_05(spark: SparkSession, d: str) -> DataFrame:
    return M.with_scores(texts(spark, d), "text", "heuristic_score", M.heuristic_scorer).select("doc_id", "heuristic_score")


@query("str_01_drained_log", f"select log_id, topic, slop_score, generation from {LOG_ONCE_SQL}")
def str_01(spark: SparkSession, d: str) -> DataFrame:
    """The essay log written as JSON lines, drained by a stream, read back."""
    import uuid

    from prosemill.streaming import logs

    base = f"{checkpoint_dir(spark).rstrip('/')}/prosemill-log-{uuid.uuid4().hex}"
    log = log_once(spark, d, "topic", "slop_score", "generation")
    log.write.json(f"{base}/in")
    logs.drain(logs.tail(spark, f"{base}/in", log.schema), f"{base}/out", f"{base}/cp").awaitTermination()
    return spark.read.schema(log.schema).parquet(f"{base}/out")


@query("str_02_ratchet", f"select log_id, topic, slop_score from (select *, row_number() over (partition by topic order by slop_score, log_id) as k from {LOG_ONCE_SQL} where slop_score is not null) where k = 1")
def str_02(spark: SparkSession, d: str) -> DataFrame:
    """The best entry per topic, merged batch by batch."""
    import uuid

    from prosemill.streaming import logs

    base = f"{checkpoint_dir(spark).rstrip('/')}/prosemill-log-{uuid.uuid4().hex}"
    log = log_once(spark, d, "topic", "slop_score").filter("slop_score IS NOT NULL")
    log.write.json(f"{base}/in")
    logs.merge_best(logs.tail(spark, f"{base}/in", log.schema, 4), f"{base}/best", f"{base}/cp", "topic", ["slop_score", "log_id"]).awaitTermination()
    return logs.ratchet_table(spark, f"{base}/best", "topic", ["slop_score", "log_id"])
