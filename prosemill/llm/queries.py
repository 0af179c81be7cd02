"""The pN_ queries and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.llm import abuse, canonical, mixing, neardup, packing, pairs, tokens, truncation
from prosemill.session import durable, spread, table

NEAR, LEAST_WORDS = 0.7, 25


def p1_configs(spark: SparkSession, d: str) -> DataFrame:
    share = lambda s: F.struct(F.lit(s).alias("source"), F.col(f"{s}_share").alias("share"))
    return table(spark, d, "pool_config").select(
        F.col("pool_config_id").alias("config"), (F.col("train_size") + F.col("val_size") + F.col("test_size")).cast("long").alias("total"),
        "val_size", "test_size", "max_repeats", "min_words", "max_words", F.col("shuffle_seed").alias("seed"),
        F.array(share("pangram"), share("kaggle"), share("defan")).alias("shares"),
    )


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    r = mixing.unique_records(table(spark, d, "source_pool"), "id", "text", "loaded_at")
    return durable(r.withColumn("source", F.regexp_extract(F.lower("id"), "^[a-z]+", 0)))


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every pool, one row per copy of a record, with its split."""
    configs = p1_configs(spark, d)
    mix = mixing.Mix(p1_records(spark, d), configs, "id", sources=3)
    split = mixing.assign_splits(durable(mix.repeats()), configs.select("config", "total", "val_size", "test_size", "seed"), "id")
    copy = F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")
    return split.select(F.col("config").alias("pool_config_id"), "source", "id", copy, "tokens", "split")


def _p1_shares(spark: SparkSession, d: str, size: str) -> DataFrame:
    configs = p1_configs(spark, d)
    if size == "tokens":  # as many tokens as records of the asked number at the middle of the length window
        configs = configs.withColumn("total", (F.col("total") * (F.col("min_words") + F.col("max_words")) / 2).cast("long"))
    mix = mixing.Mix(p1_records(spark, d), configs, "id", size=size, sources=3)
    return mix.report(durable(mix.repeats())).withColumnRenamed("config", "pool_config_id")


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in each pool, in records."""
    return _p1_shares(spark, d, "records")


def p1_token_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same pools filled and measured in tokens."""
    return _p1_shares(spark, d, "tokens")


P2_FIELDS = ["output_prompt", "input_prompt"]


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fields = F.array(*[F.struct(F.lit(i).alias("part"), F.col(f).alias("prompt")) for i, f in enumerate(P2_FIELDS)])
    prompts = table(spark, d, "prompt_pairs").select("pair_id", F.explode(fields).alias("x")).select("pair_id", "x.part", "x.prompt")
    return neardup.near_duplicates(prompts, "part", "pair_id", "prompt", NEAR, LEAST_WORDS)


def _field_name() -> Column:
    return F.element_at(F.array(*map(F.lit, P2_FIELDS)), F.col("part") + 1).alias("field_name")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records whose prompts share at least 0.7 of their distinct words."""
    members, links = _p2(spark, d)
    return neardup.expand_pairs(members, links).select(_field_name(), "key_a", "key_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per record its class of equal word sets and the number of other classes near it."""
    members, links = _p2(spark, d)
    ends = links.select("part", F.explode(F.array("a", "b")).alias("class_id")).groupBy("part", "class_id").agg(F.count("*").alias("links"))
    rows = members.join(ends.hint("merge"), ["part", "class_id"], "left")
    return rows.select(_field_name(), F.col("key").alias("pair_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


def _copied(answer: str, question: str) -> Column:
    """Whether nearly all words of the answer are the question's."""
    a, q = neardup.distinct_words(F.col(answer)), neardup.distinct_words(F.col(question))
    return F.coalesce(F.size(F.array_intersect(a, q)) >= 0.85 * F.size(a), F.lit(False))


def _p3_essays(spark: SparkSession, d: str) -> DataFrame:
    essays = table(spark, d, "prompt_pairs").select("pair_id", "topic", "topic_source", "best_essay", _copied("best_essay", "output_prompt").alias("copied"))
    closed = durable(truncation.closings(essays, "pair_id", "best_essay", "topic", ["topic_source", "copied"]))
    verdict = truncation.judge(closed, "pair_id")
    return closed.select("pair_id", "topic_source", "copied").join(verdict.hint("merge"), "pair_id").withColumn("unfinished", F.col("unfinished") & ~F.col("copied"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Essays whose last sentence is unfinished."""
    return _p3_essays(spark, d).filter("unfinished").select("pair_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    """Essays, unfinished essays and their share per topic source."""
    got = _p3_essays(spark, d).groupBy("topic_source").agg(F.count("*").alias("essays"), F.count_if("unfinished").alias("unfinished"))
    return got.withColumn("rate", F.round(F.col("unfinished") / F.col("essays"), 6))


def p3_deciders(spark: SparkSession, d: str) -> DataFrame:
    """Per decider and what alignment shows (cut, whole or nothing): essays and unfinished essays."""
    return _p3_essays(spark, d).groupBy("decider", "aligned").agg(F.count("*").alias("essays"), F.count_if("unfinished").alias("unfinished"))


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "slop_examples").select(F.lit("slop_text").alias("field_name"), F.col("example_id").alias("key"), "text")
    b = table(spark, d, "prompt_pairs").select(F.lit("best_essay").alias("field_name"), F.col("pair_id").alias("key"), F.col("best_essay").alias("text"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of texts of a field that read the same but are spelt differently."""
    classes = canonical.screen_classes(p4_texts(spark, d), "key", "text", ["field_name"])
    return canonical.lookalike_pairs(classes, "key", ["field_name"])


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Per text its class of equal-looking texts and the number of spellings in it."""
    return canonical.lookalike_classes(canonical.screen_classes(p4_texts(spark, d), "key", "text", ["field_name"]), "key", ["field_name"])


def p4_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its canonical form."""
    return p4_texts(spark, d).dropDuplicates(["field_name", "key"]).select("field_name", "key", canonical.canonical_text(F.col("text")).alias("text"))


def p5_tags(spark: SparkSession, d: str) -> DataFrame:
    """Every answer with its defect, if any, and the share of it that each tag covers."""
    fields = ["input_prompt", "output_prompt", "best_essay"]
    t = table(spark, d, "prompt_pairs").select("pair_id", "topic", *fields).dropDuplicates(["pair_id"])
    t = t.withColumns({c: canonical.screen_key_text(F.col(c)) for c in fields})
    for c in fields[1:]:
        t = truncation.closings_of(t, c, "topic").withColumn(f"end_{c}", F.struct("state", "word", "digest")).drop("state", "word", "digest")
    t = durable(t.drop("topic"))
    answers = [F.struct(F.lit(c).alias("field"), F.col(c).alias("text"), F.col(f"end_{c}").alias("end")) for c in fields[1:]]
    closed = t.select("pair_id", F.explode(F.array(*answers)).alias("x")).select(F.struct("pair_id", "x.field").alias("k"), "x.text", "x.end.*")
    broken = truncation.judge(closed, "k").filter("unfinished").groupBy("k.pair_id").agg(F.collect_set("k.field").alias("broken"))
    chains = truncation.attach(t, broken, "pair_id").withColumns({f"broken_{c}": F.coalesce(F.array_contains("broken", c), F.lit(False)) for c in fields[1:]})
    return pairs.pair_defects(chains, "pair_id", fields, [f"broken_{c}" for c in fields[1:]]).withColumnRenamed("field", "field_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers with their defect."""
    return p5_tags(spark, d).filter("defect IS NOT NULL").select("pair_id", "field_name", "defect")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Every document as its list of byte_bpe_50k ids."""
    return tokens.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")


def _p7_pack(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens.token_counts(F.col("text")).alias("n_tokens"))
    caps = [r[0] for r in table(spark, d, "generation_config").select("max_seq_len").distinct().collect()]  # a fixed table of 5 rows
    return packing.pack(durable(docs), "doc_id", "n_tokens", caps)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place in the containers of each max_seq_len."""
    return _p7_pack(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, least possible and unused space per max_seq_len."""
    return packing.packing_report(_p7_pack(spark, d))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score_documents(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "doc_labels"), "doc_id", "text", "toxic", ["source"])


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and verdict of every document."""
    return _p8(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with an abusive, hateful or sexually explicit sentence."""
    return _p8(spark, d).filter("flagged").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, flagged documents and their share per source."""
    got = _p8(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("flagged").alias("flagged"))
    return got.withColumn("rate", F.round(F.col("flagged") / F.col("documents"), 6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [p1_mix, p1_shares, p1_token_shares, p1_supply, p2_found, p2_classes, p3_found, p3_rates, p3_deciders, p4_found, p4_classes, p4_canonical, p5_found, p5_tags, p6_ids, p7_packed, p7_report, p8_found, p8_scores, p8_rates]
    return {f.__name__: f for f in named}


P2_SQL = """
with r as (select distinct pair_id, unnest(['output_prompt', 'input_prompt']) as field_name, unnest([output_prompt, input_prompt]) as t from prompt_pairs),
 s as (select field_name, pair_id, list_distinct(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+')) as w from r where t is not null),
 k as (select * from s where len(w) >= 25)
select a.field_name, a.pair_id as key_a, b.pair_id as key_b from k a join k b on a.field_name = b.field_name and a.pair_id < b.pair_id
 where len(list_intersect(a.w, b.w)) >= 0.7 * len(list_distinct(a.w || b.w)) - 1e-9"""
P1_SQL = """
with n as (select id, loaded_at, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from source_pool),
 l as (select id, t from (select *, row_number() over (partition by id order by loaded_at desc) as k from n) where k = 1 and t <> ''),
 u as (select min(id) as id, len(string_split(t, ' ')) as words, regexp_extract(min(id), '^[a-z]+') as source from l group by t),
 c as (select pool_config_id, cast(train_size + val_size + test_size as bigint) as total, min_words, unnest(['pangram', 'kaggle', 'defan']) as source from pool_config)
select c.pool_config_id, c.source, count(u.id) as supply, c.total from c left join u on u.source = c.source and u.words >= c.min_words group by all"""


def p1_supply(spark: SparkSession, d: str) -> DataFrame:
    """Distinct eligible records of each source for each pool, and the pool's size."""
    mix = mixing.Mix(p1_records(spark, d), p1_configs(spark, d), "id", sources=3)
    return mix.targets.select(F.col("config").alias("pool_config_id"), "source", "supply", "total")


def oracle_sql() -> dict[str, str]:
    """p2_found and p1_supply; the others are tested against brute force, round trips and held-out labels."""
    return {"p2_found": P2_SQL, "p1_supply": P1_SQL}
