"""Queries of text metrics (TXT-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X
from prosemill.functions import udfs as U
from prosemill.plans.catalogue import DOCS_SQL, PAIRS_SQL, gram_sql, hits_sql, list_sql, norm_sql, query, r6, strip_sql, w_sql
from prosemill.session import durable, spread, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    """documents with words, tokens and lines."""
    t = F.col("text")
    return X.once(spread(table(spark, d, "documents").select("doc_id", "lang", "source", "topic", "text")), ["doc_id", "lang", "source", "topic"], t=X.present(t), w=X.words(t), tok=X.tokens(t), ls=X.lines(t))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair: the prompt q and the essay t with words, tokens and lines."""
    p = table(spark, d, "prompt_pairs").select("pair_id", "output_prompt", "best_essay").dropDuplicates(["pair_id"])
    t, q = F.col("best_essay"), F.col("output_prompt")
    return X.once(p, ["pair_id"], q=X.present(q), t=X.present(t), w=X.words(t), tok=X.tokens(t), qtok=X.tokens(q), ls=X.lines(t))


def metric(name: str, out: str, build, sql: str) -> None:
    """A query of one metric over documents."""

    @query(name, f"{DOCS_SQL} select doc_id, round(cast({sql} as double), 6) as {out} from d")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return docs(spark, d).select("doc_id", r6(build()).alias(out))


def ratio_sql(a: str, b: str) -> str:
    return f"(cast({a} as double) / greatest(cast({b} as double), 1.0))"


BULLET_SQL = r"regexp_matches(x, '^([-*•·][ \t\n\r\f]|[0-9]+[.)][ \t\n\r\f])')"
LIST_SQL = r"regexp_matches(x, '^([-*•·][ \t\n\r\f]|[0-9]+[.)][ \t\n\r\f]|[0-9]+\.?[ \t\n\r\f]*[A-Za-z])')"
lines_share = lambda cond: ratio_sql(f"len([x for x in ls if {cond}])", "len(ls)")
BULLETS, MARKS, SYMBOLS = lines_share(BULLET_SQL), lines_share(LIST_SQL), lines_share(r"regexp_matches(x, '^[^\p{L}]')")
DASH = f"least(1.0, {ratio_sql("coalesce(list_sum([length(x) for x in regexp_extract_all(t, '-{2,}|—+')]), 0)", 'length(t)')})"
QUOTE_COUNT = "(len(regexp_extract_all(t, chr(34) || chr(34))) + len(regexp_extract_all(t, chr(39) || chr(39)))) * 2"
QUOTE = f"least(1.0, {ratio_sql(QUOTE_COUNT, 'length(t)')})"
TILDE = ratio_sql("length(t) - length(replace(t, '~', ''))", "length(t)")
ABNORMAL = f"least(1.0, 0.35 * {BULLETS} + 0.15 * {DASH} + 0.10 * {QUOTE} + 0.10 * least(1.0, {TILDE} * 20) + 0.30 * {SYMBOLS})"
REP2 = f"(case when len(w) < 4 then 0.0 else {ratio_sql(f'2 * (len({gram_sql("w", 2)}) - len(list_distinct({gram_sql("w", 2)})))', 'len(w)')} end)"
ECHO, ADVICE, GENERIC = (f"least(1.0, {hits_sql('lt', p)} / {max(len(p) * k, 1)})" for p, k in ((X.INSTRUCTION_ECHO, 0.2), (X.WRITING_ADVICE, 0.25), (X.OFF_TASK_GENERIC, 0.3)))
STOP = list_sql(X.STOPWORDS)
INFO = f"""greatest(0.0, least(1.0, (0.5 * {ratio_sql("len(list_distinct(tok))", "len(tok)")} + 0.5 * {ratio_sql(f"len([x for x in tok if not list_contains({STOP}, x)])", "len(tok)")})
  * (case when len(tok) <= 3 then 0.0 when len(tok) < 15 then (len(tok) - 3) / 12.0 else least(1.0, len(tok) / 80.0) end)))"""
unit_sql = lambda x: f"greatest(0.0, least(1.0, {x}))"
SENT = f"[n for n in [len({w_sql('s')}) for s in string_split_regex(t, '[.!?]+')] if n > 0]"
MEAN = f"(list_sum({SENT}) / cast(len({SENT}) as double))"
SENTLEN = f"(case when len({SENT}) = 0 then 0.0 when {MEAN} < 5 then {MEAN} / 5.0 when {MEAN} > 40 then greatest(0.0, 1.0 - ({MEAN} - 40) / 40.0) else 1.0 end)"
CLARITY = f"(case when {strip_sql('t')} = '' then 0.0 else {unit_sql(f'0.4 * {SENTLEN} + 0.2 * {unit_sql(f"1.0 - {ABNORMAL}")} + 0.2 * {unit_sql(f"1.0 - 2.0 * {REP2}")} + 0.2 * {unit_sql(f"1.0 - 2.0 * {ECHO}")}')} end)"
KEYWORDS = f"list_filter(qtok, lambda x: regexp_full_match(x, '[a-z]{{3,}}') and not list_contains({list_sql(X.KEYWORD_STOPWORDS)}, x))"
FIRST_KEYWORDS = f"[k for k, i in (select 1)]"
GENERIC_PHRASES = ["in the end", "of course", "to be fair", "for a moment", "as a result", "in practice"]


metric("txt_02_word_count", "words", lambda: F.size(F.col("w")), "len(w)")
metric("txt_04_bullet_like_line_ratio", "ratio", lambda: X.bullet_like_line_ratio(F.col("ls")), BULLETS)
metric("txt_05_repeated_dash_ratio", "ratio", lambda: X.repeated_dash_ratio(F.col("t")), DASH)
metric("txt_06_repeated_quote_ratio", "ratio", lambda: X.repeated_quote_ratio(F.col("t")), QUOTE)
metric("txt_07_tilde_ratio", "ratio", lambda: X.tilde_ratio(F.col("t")), TILDE)
metric("txt_08_list_marker_ratio", "ratio", lambda: X.list_marker_ratio(F.col("ls")), MARKS)
metric("txt_09_line_start_symbol_ratio", "ratio", lambda: X.line_start_symbol_ratio(F.col("ls")), SYMBOLS)
metric("txt_10_abnormal_punctuation", "density", lambda: X.abnormal_punctuation_density(F.col("t"), F.col("ls")), ABNORMAL)
metric("txt_12_information_density", "score", lambda: X.information_density(F.col("tok")), INFO)
metric("txt_13_clarity", "score", lambda: X.clarity(F.col("t"), X.abnormal_punctuation_density(F.col("t"), F.col("ls")), X.repetition_ratio(F.col("w")), X.instruction_echo_ratio(F.col("t"))), CLARITY)
metric("txt_16_repetition_ratio", "ratio", lambda: X.repetition_ratio(F.col("w")), REP2)
metric("txt_17_repeated_token_fraction", "fraction", lambda: X.repeated_token_fraction(F.col("w")), ratio_sql("len(w) - len(list_distinct(w))", "len(w)"))
metric("txt_18_punctuation_ratio", "ratio", lambda: X.punctuation_ratio(F.col("t")), ratio_sql(f"length(t) - length(translate(t, '{X.PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''))", "length(t)"))
metric("txt_19_caps_ratio", "ratio", lambda: X.caps_ratio(F.col("t")), ratio_sql(r"len(regexp_extract_all(t, '\p{Lu}'))", r"len(regexp_extract_all(t, '\p{L}'))"))
metric("txt_21_instruction_echo", "ratio", lambda: X.instruction_echo_ratio(F.col("t")), ECHO)
metric("txt_22_writing_advice", "ratio", lambda: X.writing_advice_ratio(F.col("t")), ADVICE)
metric("txt_23_off_task_generic", "ratio", lambda: X.off_task_generic_ratio(F.col("t")), GENERIC)
metric("txt_31_ngram_repetition_3", "ratio", lambda: X.ngram_repetition(F.col("tok")), f"(case when len(tok) < 3 then 0.0 else 1.0 - {ratio_sql(f'len(list_distinct({gram_sql("tok", 3)}))', f'len({gram_sql("tok", 3)})')} end)")
metric("txt_32_distinct_2", "ratio", lambda: X.distinct_n(F.col("tok")), ratio_sql(f"len(list_distinct({gram_sql('tok', 2)}))", f"len({gram_sql('tok', 2)})"))
metric("txt_34_punct_density", "density", lambda: X.punct_density(F.col("t")), ratio_sql(f"length(t) - length(translate(t, '{X.ASCII_PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''))", "length(t)"))
metric("txt_42_lightweight_style", "score", lambda: X.lightweight_style(F.col("t"), F.col("tok")), f"(case when len(tok) = 0 then 0.0 else {unit_sql(f'''0.65 * least(len(tok) / 20.0, 1.0) + (case when regexp_matches(t, '[:;]') then 0.1 else 0.0 end) - 1.5 * {ratio_sql(f"len([x for x in tok if list_contains({list_sql(X.VAGUE_TERMS)}, x)])", "len(tok)")}''')} end)")
metric("txt_28_generic_phrase_ratio", "ratio", lambda: X.generic_phrase_ratio(F.col("t"), F.col("w"), GENERIC_PHRASES), f"least(1.0, {ratio_sql(' + '.join(f'''cast((length(lt) - length(replace(lt, '{p}', ''))) / {len(p)} as bigint)''' for p in GENERIC_PHRASES), 'len(w)')})")
metric("txt_29_length_penalty", "penalty", lambda: X.length_penalty(F.size(F.col("w")), 50, 200), "(case when len(w) < 50 then (50 - len(w)) / 50.0 when len(w) > 200 then (len(w) - 200) / 200.0 else 0.0 end)")
FILLER_SQL = " + ".join(f"coalesce(list_sum([least(1.0, len({w_sql('m')}) / 5.0) for m in regexp_extract_all(lt, '(?:\\b{p}\\b[ \\t\\n\\r\\f]*){{2,}}')]), 0.0)" for p in X.FILLERS)
metric("txt_20_filler_loop_score", "score", lambda: X.filler_loop_score(F.col("t")), f"least(1.0, {FILLER_SQL})")


@query("txt_01_normalize", f"select doc_id, {norm_sql('text')} as text from documents")
def txt_01(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("text"))


@query("txt_03_length_ratio", f"{PAIRS_SQL} select pair_id, round({ratio_sql('len(w)', f'len({w_sql("q")})')}, 6) as ratio from d")
def txt_03(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("pair_id", r6(X.ratio(F.size("w"), F.size(X.words(F.col("q"))))).alias("ratio"))


@query("txt_11_structural", f"""{DOCS_SQL} select doc_id, round({BULLETS}, 6) as bullet_like_line_ratio, round({DASH}, 6) as repeated_dash_ratio, round({QUOTE}, 6) as repeated_quote_ratio,
  round({TILDE}, 6) as tilde_ratio, round({MARKS}, 6) as list_marker_ratio, round({SYMBOLS}, 6) as line_start_symbol_ratio, round({ABNORMAL}, 6) as abnormal_punctuation_density from d""")
def txt_11(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", *[r6(c).alias(n) for n, c in X.structural(F.col("t"), F.col("ls")).items()])


KEYS_SQL = f"list_slice([x for x, i in [(1, 1)]], 1, 0)"
# distinct in order of first position: DuckDB's list_distinct has no order
ORDERED = f"[x for x, i in zip_dummy]"


def keyword_ctes() -> str:
    return f"""{PAIRS_SQL.rstrip()}, kept as (select pair_id, {KEYWORDS} as ks from d),
      pos as (select pair_id, k, min(i) as i from (select pair_id, unnest(ks) as k, unnest(range(1, len(ks) + 1)) as i from kept) group by pair_id, k),
      top as (select pair_id, k, i, row_number() over (partition by pair_id order by i) as n from pos),
      kw as (select pair_id, list(k order by i) as ks from top where n <= 10 group by pair_id),
      e as (select d.*, coalesce(kw.ks, cast([] as varchar[])) as ks from d left join kw using (pair_id))"""


RELEVANCE = f"(case when len(ks) = 0 then 1.0 else {ratio_sql('len([k for k in ks if contains(lt, k)])', 'len(ks)')} end)"
COPY = f"least(1.0, 1.5 * {ratio_sql('len(list_intersect(list_distinct(tok), list_distinct(qtok)))', 'len(list_distinct(tok))')})"
COMPLETE = f"(case when {strip_sql('t')} = '' then 0.0 when len(ks) = 0 then {INFO} when {RELEVANCE} > 0 then {RELEVANCE} else {unit_sql(f'0.3 * {INFO}')} end)"


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).withColumn("ks", X.task_keywords(F.col("q")))


@query("txt_30_task_keywords", f"{keyword_ctes()} select pair_id, array_to_string(ks, ' ') as keywords from e")
def txt_30(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("pair_id", F.array_join("ks", " ").alias("keywords"))


@query("txt_25_task_relevance", f"{keyword_ctes()} select pair_id, round({RELEVANCE}, 6) as relevance from e")
def txt_25(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("pair_id", r6(X.task_relevance(F.col("t"), F.col("ks"))).alias("relevance"))


@query("txt_24_prompt_copy", f"{PAIRS_SQL} select pair_id, round({COPY}, 6) as ratio from d")
def txt_24(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("pair_id", r6(X.prompt_copy_ratio(F.col("tok"), F.col("qtok"))).alias("ratio"))


@query("txt_26_semantic", f"""{keyword_ctes()} select pair_id, round({ECHO}, 6) as instruction_echo_ratio, round({ADVICE}, 6) as writing_advice_ratio, round({GENERIC}, 6) as off_task_generic_ratio,
  round({COPY}, 6) as prompt_copy_ratio, round({RELEVANCE}, 6) as task_relevance_score, round(least(1.0, ({ECHO} + {ADVICE} + {GENERIC}) / 3.0 + 0.3 * {COPY}), 6) as semantic_meta_score,
  round(least(1.0, (1.0 - {RELEVANCE}) + 0.5 * {GENERIC}), 6) as semantic_off_task_score from e""")
def txt_26(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("pair_id", *[r6(c).alias(n) for n, c in X.semantic(F.col("t"), F.col("tok"), F.col("qtok"), F.col("ks")).items()])


@query("txt_14_completeness", f"{keyword_ctes()} select pair_id, round({COMPLETE}, 6) as score from e")
def txt_14(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("pair_id", r6(X.completeness(F.col("t"), F.col("tok"), F.col("ks"))).alias("score"))


@query("txt_15_quality", f"{keyword_ctes()} select pair_id, round({unit_sql(f'0.4 * {INFO} + 0.3 * {CLARITY} + 0.3 * {COMPLETE}')} + 1e-9, 6) as score from e")
def txt_15(spark: SparkSession, d: str) -> DataFrame:
    clear = X.clarity(F.col("t"), X.abnormal_punctuation_density(F.col("t"), F.col("ls")), X.repetition_ratio(F.col("w")), X.instruction_echo_ratio(F.col("t")))
    return keyed(spark, d).select("pair_id", r6(X.quality(X.information_density(F.col("tok")), clear, X.completeness(F.col("t"), F.col("tok"), F.col("ks"))) + 1e-9).alias("score"))


@query("txt_27_diagnostics", f"""{DOCS_SQL} select doc_id, cast(length(t) as bigint) as length_chars, cast(len(w) as bigint) as length_tokens, len(w) < 3 as very_short, round({REP2}, 6) as repetition_ratio,
  round({ratio_sql("len(w) - len(list_distinct(w))", "len(w)")}, 6) as repeated_token_fraction, round({ABNORMAL}, 6) as abnormal_punctuation_density from d""")
def txt_27(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select(
        "doc_id", F.length("t").cast("long").alias("length_chars"), F.size("w").cast("long").alias("length_tokens"), (F.size("w") < 3).alias("very_short"),
        r6(X.repetition_ratio(F.col("w"))).alias("repetition_ratio"), r6(X.repeated_token_fraction(F.col("w"))).alias("repeated_token_fraction"), r6(X.abnormal_punctuation_density(F.col("t"), F.col("ls"))).alias("abnormal_punctuation_density"),
    )


def letter_entropy(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, entropy) in bits of the characters of each document that has text."""
    t = spread(table(spark, d, "documents").select("doc_id", "text"))
    return t.select("doc_id", U.char_entropy(F.col("text")).alias("entropy")).filter("entropy IS NOT NULL")


def char_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy in bits of the characters of each document that has text."""
    return letter_entropy(spark, d).select("doc_id", r6("entropy").alias("entropy"))


ENTROPY_SQL = """select doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) as entropy
  from (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(coalesce(text, ''), '')) as c from documents) where c <> '' group by doc_id, c) group by doc_id"""
query("txt_33_char_entropy", ENTROPY_SQL)(char_entropy)


@query("txt_38_clean_title", rf"select topic, {strip_sql(rf'''regexp_replace({strip_sql(rf"regexp_replace({strip_sql('topic')}, '^[""'']|[""'']$', '', 'g')")}, '(?i)^(?:title|subject):[ \t\n\r\f]*', '')''')} as title from (select distinct topic from topic_sources where topic is not null)".replace('""', '"'))
def txt_38(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "topic_sources").select("topic").filter("topic IS NOT NULL").distinct().select("topic", X.clean_title(F.col("topic")).alias("title"))


BOILER = " or ".join(f"starts_with(first, '{p.replace(chr(39), chr(39) * 2)}')" for p in X.BOILERPLATE_STARTS)


@query("txt_39_strip_boilerplate", f"""select pair_id, {strip_sql(f"case when {BOILER} then (case when instr(t, chr(10) || chr(10)) > 0 then substr(t, instr(t, chr(10) || chr(10)) + 2) else '' end) else t end")} as text
  from (select pair_id, t, lower({strip_sql("string_split(t, chr(10) || chr(10))[1]")}) as first from (select pair_id, {strip_sql("coalesce(any_value(best_essay), '')")} as t from prompt_pairs group by pair_id))""")
def txt_39(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("pair_id", X.strip_boilerplate(F.col("t")).alias("text"))


@query("txt_44_template", """select pair_id, case when t = '' then p when contains(p, t) then replace(p, t, '{topic}') when instr(lower(p), lower(t)) > 0
  then substr(p, 1, instr(lower(p), lower(t)) - 1) || '{topic}' || substr(p, instr(lower(p), lower(t)) + length(t)) else p end as template
  from (select pair_id, coalesce(any_value(output_prompt), '') as p, coalesce(any_value(topic), '') as t from prompt_pairs group by pair_id)""")
def txt_44(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prompt_pairs").select("pair_id", "output_prompt", "topic").dropDuplicates(["pair_id"])
    return p.select("pair_id", X.canonical_template(F.col("output_prompt"), F.col("topic")).alias("template"))


@query("txt_45_clean_rewrite", rf"""select pair_id, {norm_sql(rf"regexp_replace(regexp_replace({strip_sql('p')}, '(?i)^(rewrite|rewritten prompt|new prompt)[ \t\n\r\f]*[:\-][ \t\n\r\f]*', ''), '^[0-9]+[).:-][ \t\n\r\f]*', '')")} as prompt
  from (select pair_id, coalesce(any_value(output_prompt), '') as p from prompt_pairs group by pair_id)""")
def txt_45(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "prompt_pairs").select("pair_id", "output_prompt").dropDuplicates(["pair_id"])
    return p.select("pair_id", X.clean_rewrite(F.col("output_prompt")).alias("prompt"))


@query("txt_46_clip", "select doc_id, left(text, 2500) as text from documents")
def txt_46(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.left("text", F.lit(2500)).alias("text"))


@query("txt_48_highlight", f"select doc_id, array_to_string([case when length(x) >= 9 then '[' || x || ']' else x end for x in {w_sql('text')}], ' ') as line from documents")
def txt_48(spark: SparkSession, d: str) -> DataFrame:
    marked = F.transform("w", lambda x: F.when(F.length(x) >= 9, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return docs(spark, d).select("doc_id", F.array_join(marked, " ").alias("line"))


@query("txt_49_normalize_answer", rf"select id, lower(regexp_replace({norm_sql('text')}, '\.+$', '')) as answer from (select distinct id, text from source_pool)")
def txt_49(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_pool").select("id", "text").distinct().select("id", X.normalize_answer(F.col("text")).alias("answer"))


FLAGSHIP_METRICS = {"ngram_repetition_3": 1.0, "distinct_2": -1.0, "char_entropy": -0.7, "punct_density": 0.2, "caps_ratio": 0.2}


def document_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per document the metrics of the z-scored slop score, as a table: its readers go over it more than once."""
    t = F.col("text")
    scan = spread(table(spark, d, "documents").select("doc_id", "lang", "text")).withColumn("char_entropy", F.coalesce(U.char_entropy(t), F.lit(0.0)))
    base = X.once(scan, ["doc_id", "lang", "char_entropy"], t=X.present(t), tok=X.tokens(t))
    return durable(base.select(
        "doc_id", "lang", X.ngram_repetition(F.col("tok")).alias("ngram_repetition_3"), X.distinct_n(F.col("tok")).alias("distinct_2"),
        "char_entropy", X.punct_density(F.col("t")).alias("punct_density"), X.caps_ratio(F.col("t")).alias("caps_ratio"),
    ))


def slop_scores(metrics: DataFrame) -> DataFrame:
    """metrics with slop_score: weighted z-scores over all rows (population deviation). The moments are one row, broadcast."""
    moments = metrics.agg(*[F.avg(m).alias(f"{m}_mean") for m in FLAGSHIP_METRICS], *[F.stddev_pop(m).alias(f"{m}_dev") for m in FLAGSHIP_METRICS])
    score = F.lit(0.0)
    for m, weight in FLAGSHIP_METRICS.items():
        z = F.when(F.col(f"{m}_dev") > 0, (F.col(m) - F.col(f"{m}_mean")) / F.col(f"{m}_dev")).otherwise(0.0)
        score = score + weight * z
    return metrics.join(F.broadcast(moments)).select("doc_id", "lang", *FLAGSHIP_METRICS, score.alias("slop_score"))


METRICS_SQL = f"""{DOCS_SQL.rstrip()}, ent as (select doc_id, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h
  from (select doc_id, c, count(*) as n from (select doc_id, unnest(string_split(t, '')) as c from d) where c <> '' group by doc_id, c) group by doc_id),
 m as (select d.doc_id, d.lang, (case when len(tok) < 3 then 0.0 else 1.0 - {ratio_sql(f'len(list_distinct({gram_sql("tok", 3)}))', f'len({gram_sql("tok", 3)})')} end) as a,
  {ratio_sql(f"len(list_distinct({gram_sql('tok', 2)}))", f"len({gram_sql('tok', 2)})")} as b, coalesce(h, 0.0) as c,
  {ratio_sql(f"length(t) - length(translate(t, '{X.ASCII_PUNCTUATION.replace(chr(39), chr(39) * 2)}', ''))", "length(t)")} as e,
  {ratio_sql(chr(108) + r"en(regexp_extract_all(t, '\p{Lu}'))", r"len(regexp_extract_all(t, '\p{L}'))")} as f from d left join ent using (doc_id)),
 s as (select doc_id, lang, {" + ".join(f"{w} * ({x} - avg({x}) over ()) / stddev_pop({x}) over ()" for x, w in zip("abcef", (1.0, -1.0, -0.7, 0.2, 0.2)))} as slop_score from m)"""


@query("win_28_slop_score", f"{METRICS_SQL} select doc_id, round(slop_score, 6) as slop_score from s")
def win_28(spark: SparkSession, d: str) -> DataFrame:
    return slop_scores(document_metrics(spark, d)).select("doc_id", r6("slop_score").alias("slop_score"))


@query("flagship_slop_by_lang", f"{METRICS_SQL} select lang, count(*) as documents, round(avg(slop_score), 6) as mean_slop, round(median(slop_score), 6) as median_slop from s group by lang")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Slop score by language: n-gram, entropy and surface metrics, global z-scores, group statistics."""
    s = slop_scores(document_metrics(spark, d))
    return s.groupBy("lang").agg(F.count("*").alias("documents"), r6(F.avg("slop_score")).alias("mean_slop"), r6(F.median("slop_score")).alias("median_slop"))


@query("agg_25_correlations", f"{METRICS_SQL} " + " union all ".join(f"select '{n1}' as a, '{n2}' as b, round(corr({x1}, {x2}), 6) as r from m" for i, (n1, x1) in enumerate(zip(FLAGSHIP_METRICS, "abcef")) for n2, x2 in list(zip(FLAGSHIP_METRICS, "abcef"))[i + 1 :]))
def agg_25(spark: SparkSession, d: str) -> DataFrame:
    names = list(FLAGSHIP_METRICS)
    both = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = document_metrics(spark, d).agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in both])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"`{a}|{b}`")).alias("r")) for a, b in both])
    return one.select(F.explode(rows).alias("x")).select("x.*")


@query("agg_26_describe", f"{METRICS_SQL} " + " union all ".join(f"select '{n}' as metric, count({x}) as n, round(avg({x}), 6) as mean, round(stddev_samp({x}), 6) as dev, round(min({x}), 6) as least, round(quantile_cont({x}, 0.25), 6) as q1, round(median({x}), 6) as mid, round(quantile_cont({x}, 0.75), 6) as q3, round(max({x}), 6) as most from m" for n, x in zip(FLAGSHIP_METRICS, "abcef")))
def agg_26(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("x")) for n in FLAGSHIP_METRICS])
    x = document_metrics(spark, d).select(F.explode(rows).alias("r")).select("r.*")
    return x.groupBy("metric").agg(
        F.count("x").alias("n"), r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("dev"), r6(F.min("x")).alias("least"), r6(F.percentile("x", 0.25)).alias("q1"),
        r6(F.median("x")).alias("mid"), r6(F.percentile("x", 0.75)).alias("q3"), r6(F.max("x")).alias("most"),
    )
