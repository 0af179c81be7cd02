"""Row-wise operators: filters, gates, projections, record rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosemill.functions import text as X

# Fixed values.
INSTRUCTION_KEYWORDS = ["explain", "discuss", "argue", "analyze", "compare", "evaluate", "why", "should"]
SUBSTITUTIONS = [("Write an essay about", "Compose a piece discussing"), ("Discuss", "Explore"), ("Explain", "Describe"), ("What is", "Tell me about"), ("the role of", "how")]
REWRITE_REQUEST = "Rewrite the following text so it sounds more natural and human while preserving its meaning and approximate length."


def render_qa(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer: "), answer)


def chosen_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that df has, in the order asked; others are ignored."""
    return df.select(*[c for c in columns if c in df.columns])


def instruction_kept(instruction: Column, response: Column, most_chars: int = 150, least_words: int = 50, most_words: int = 500) -> Column:
    """Short instruction with a keyword, response of medium length; null counts as not kept."""
    keyword = F.lit(False)
    for k in INSTRUCTION_KEYWORDS:
        keyword = keyword | F.contains(F.lower(instruction), F.lit(k))
    return (F.length(instruction) <= most_chars) & keyword & X.word_count(response).between(least_words, most_words)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct words of two arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return X.ratio(both, F.size(F.array_union(a, b)))


def similarity_gate(similarity: Column, ratio: Column, least: float = 0.88, low: float = 0.80, high: float = 1.25) -> Column:
    return (similarity >= least) & ratio.between(low, high)


def invalid_output(text: Column, least_words: int = 8) -> Column:
    """Null, blank, an echo of the rewrite request, or too short."""
    t = X.strip(X.present(text))
    return (t == "") | F.lower(t).startswith("rewrite the following") | (F.size(X.words(text)) < least_words)


def constraint_reason(text: Column, lang: Column, least: int = 150, most: int = 2000, wanted: str = "en", on_topic: Column | None = None, least_similarity: float = 0.3) -> Column:
    """The first constraint that fails, or ok."""
    n = X.word_count(text)
    reason = F.when(n < least, "too_short").when(n > most, "too_long").when(X.present(text).rlike(X.REFUSAL), "refusal")
    reason = reason.when(F.lower(F.coalesce(lang, F.lit(""))) != wanted, "non_english")
    if on_topic is not None:
        reason = reason.when(on_topic < least_similarity, "off_topic")
    return reason.otherwise("ok")


def rewrite_prompt(text: Column) -> Column:
    return F.concat(F.lit(REWRITE_REQUEST + "\n\nOriginal text:\n"), X.strip(text), F.lit("\n\nRewritten text:\n"))


def difficulty(source: Column, target: Column) -> Column:
    return F.when((target <= 0.10) & (source >= 0.80), "easy").when((source >= 0.60) & (source - target >= 0.20), "medium").otherwise("hard")


def acceptance(delta: Column, ratio: Column) -> Column:
    return F.when((delta >= 0.15) & ratio.between(0.80, 1.30), "strong").when(delta >= 0.10, "fallback").otherwise("no_threshold_topk")


def render_structured(spec: dict[str, Column]) -> Column:
    """Sections in fixed order, missing ones skipped, a blank line between parts."""
    label = lambda k, name: F.when(spec[k] != "", F.concat(F.lit(f"{name}: "), spec[k])) if k in spec else F.lit(None).cast("string")
    items = lambda k: F.transform(spec[k], lambda c: F.concat(F.lit("- "), c)) if k in spec else F.array().cast("array<string>")
    headed = lambda k, name: F.when(F.size(items(k)) > 0, F.concat(F.array(F.lit(name)), items(k))).otherwise(F.array().cast("array<string>"))
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    parts = F.concat(
        some(label("role", "Role")), some(label("task", "Task")), headed("constraints", "Constraints:"), headed("anti_slop", "Style and clarity:"),
        some(label("output_format", "Output format")), some(label("tone", "Tone")), some(label("audience", "Audience")), some(label("reasoning_style", "Reasoning")),
    )
    return F.coalesce(F.nullif(F.array_join(parts, "\n\n"), F.lit("")), F.lit("Write clearly and precisely."))


def render_simple(spec: dict[str, Column]) -> Column:
    """One paragraph: the task, then constraints and style as sentences."""
    stop = lambda c: F.concat(F.regexp_replace(X.strip(c), r"\.+$", ""), F.lit("."))
    upper = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))
    one = lambda k: [stop(spec[k])] if k in spec else []
    many = lambda k: F.transform(spec[k], lambda c: upper(stop(c))) if k in spec else F.array().cast("array<string>")
    ends = F.array(*one("output_format"), *one("tone")) if {"output_format", "tone"} & spec.keys() else F.array().cast("array<string>")
    return F.array_join(F.concat(F.array(*one("task")), many("constraints"), many("anti_slop"), ends), " ")


def fill_topic(template: Column, topic: Column) -> Column:
    """{topic} and <topic> replaced literally; null if either is null."""
    return F.replace(F.replace(template, F.lit("{topic}"), topic), F.lit("<topic>"), topic)


def few_shot_blocks(df: DataFrame, group: str, text: str, score: str, key: str, n: int, most_chars: int) -> DataFrame:
    """(group, block): the n best-scored texts of a group, numbered, clipped. The rank limit is pushed below the shuffle."""
    w = Window.partitionBy(group).orderBy(score, key)
    ranked = df.filter(F.col(text).isNotNull() & F.col(group).isNotNull() & F.col(score).isNotNull()).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= n)
    item = F.concat(F.lit("Example "), F.col("n"), F.lit(":\n"), F.col(text))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("t")))), lambda x: x["t"]), "\n\n")
    return ranked.groupBy(group).agg(F.left(block, F.lit(most_chars)).alias("block"))


def topic_of_instruction(t: Column) -> Column:
    """An essay topic for an instruction; the first rule that matches, else the instruction."""
    rule = lambda p: rf"(?is)^{p}$"
    got = lambda p, i=1: F.trim(F.regexp_extract(t, rule(p), i))
    explain, describe, compare, should, what = r"Explain\s+(.+)", r"Describe\s+(.+)", r"Compare\s+(.+?)\s+(?:and|to|with)\s+(.+)", r"Should\s+(.+)", r"What\s+(?:is|are)\s+(.+)"
    return (
        F.when(t.rlike(rule(explain)), F.concat(F.lit("the nature and implications of "), got(explain)))
        .when(t.rlike(rule(describe)), F.concat(got(describe), F.lit(" and its significance")))
        .when(t.rlike(rule(compare)), F.concat(F.lit("the relative merits of "), got(compare), F.lit(" versus "), got(compare, 2)))
        .when(t.rlike(rule(should)), F.concat(F.lit("whether "), got(should)))
        .when(t.rlike(rule(what)), F.concat(got(what), F.lit(" and what it means")))
        .otherwise(t)
    )


def variants(prompt: Column) -> Column:
    """Up to three variants of a prompt, each by one phrase substitution."""
    each = F.array(*[F.replace(prompt, F.lit(a), F.lit(b)) for a, b in SUBSTITUTIONS])
    return F.slice(F.filter(each, lambda v: v != prompt), 1, 3)


def unpivot(df: DataFrame, keys: list[str], columns: dict[str, str], name: str, value: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).alias(value)) for label, c in columns.items()])
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def score_bucket(score: Column, k: int) -> Column:
    """floor(clamped score * k), at most k - 1."""
    return F.when(score.isNotNull(), F.least(F.lit(k - 1), F.floor(clamp01(score) * k)).cast("int"))


def ternary(score: Column, low: float = 0.33, high: float = 0.66) -> Column:
    return F.when(score.isNotNull(), F.when(score < low, 0).when(score < high, 1).otherwise(2))


def softmax(logits: Column) -> Column:
    """Softmax of an array of doubles."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def expected_bucket(p: Column) -> Column:
    """Sum of p_i * i / (k - 1)."""
    weighted = F.transform(p, lambda x, i: x * i)
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / (F.size(p) - 1)


def combined_reward(score: Column, fluency: Column, ratio: Column, alpha: float, beta: float, gamma: float) -> Column:
    length = F.when(ratio.between(0.40, 1.60), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(ratio - 1.0)))
    return alpha * (1 - score) + beta * fluency + gamma * length


def fitness(slop: Column, similarity: Column, ok: Column, weight: float = 0.3) -> Column:
    return F.when(ok, F.round(-slop + weight * similarity, 6)).otherwise(F.lit(float("-inf")))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~(F.isnan(x) | (F.abs(x) == float("inf"))), x)


def length_band(n: Column) -> Column:
    return F.concat(F.lit("Length: between "), F.floor(n * 0.85).cast("int"), F.lit(" and "), F.floor(n * 1.15).cast("int"), F.lit(" words"))


def prompt_with_context(instruction: Column, context: Column) -> Column:
    return F.when(X.strip(X.present(context)) == "", instruction).otherwise(F.concat(instruction, F.lit("\n\nContext: "), context))


def human_and_ai(df: DataFrame, key: str, human: str, ai: str) -> DataFrame:
    """Two rows per record: the human text with score 0 and the other with score 1."""
    both = F.array(F.struct(F.col(human).alias("text"), F.lit(0.0).alias("score")), F.struct(F.col(ai).alias("text"), F.lit(1.0).alias("score")))
    return df.select(key, F.explode(both).alias("r")).select(key, "r.*")


def clamp01(x: Column) -> Column:
    """x held in [0, 1]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
