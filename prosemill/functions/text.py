"""Text metrics as Column expressions: JVM-side, no Python in the path.

Most functions take arrays that are computed once per row (``words``,
``tokens``, ``lines``, ``ngrams``) so that several metrics share them. All
accept null and empty texts: metrics of an absent text are 0 unless stated.
``WHITE`` keeps to the ASCII white space that every SQL engine agrees on; pass
``WHITE_UNICODE`` for Unicode white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f]+"
WHITE_UNICODE = r"(?U)\s+"
TOKEN = r"[\p{L}\p{N}_]+"

# Word lists and patterns of the metric definitions.
STOPWORDS = """the a an to in on for of and or is are be by with as your you that this it if when how what why can should use write explain give provide very really
just also so""".split()
KEYWORD_STOPWORDS = """the a an to in on for of and or is are be by with as your you that this it if when how what why can should use write explain give provide""".split()
INSTRUCTION_ECHO = [
    r"write\s+(in|with|clearly|using)", r"use\s+short\s+sentences", r"be\s+concise", r"avoid\s+vague", r"use\s+concrete\s+examples",
    r"stay\s+on\s+topic", r"plain\s+paragraphs", r"direct\s+and\s+specific", r"do\s+not\s+use", r"prefer\s+direct", r"output\s+format",
    r"constraints?\s*:", r"style\s+and\s+clarity",
]
WRITING_ADVICE = [
    r"you\s+should", r"it'?s\s+important\s+to", r"make\s+sure\s+to", r"try\s+to\s+(write|use|avoid|be)", r"remember\s+to",
    r"focus\s+on\s+(being|writing|using)", r"aim\s+to\s+(be|write|provide)", r"ensure\s+that\s+(your|you)", r"when\s+writing",
    r"in\s+your\s+(response|answer|writing|explanation)", r"when\s+explaining", r"a\s+good\s+(explanation|answer)\s+(is|should)",
    r"to\s+write\s+(clearly|well)", r"best\s+practice\s+is",
]
OFF_TASK_GENERIC = [
    r"good\s+writing", r"clear\s+communication", r"effective\s+explanation", r"the\s+key\s+is\s+to", r"best\s+approach\s+is", r"general\s+rule",
    r"in\s+general\s*[,.]", r"writing\s+tip", r"how\s+to\s+write", r"how\s+to\s+explain", r"tips?\s+for\s+(writing|explaining)",
]
FILLERS = ["like", "you know", "um", "uh", "well", "so", "actually"]
VAGUE_TERMS = "good nice great interesting effective various things stuff really very overall basically".split()
BULLET = r"^([-*•·][ \t\n\r\f]|[0-9]+[.)][ \t\n\r\f])"
LIST_MARK = r"^([-*•·][ \t\n\r\f]|[0-9]+[.)][ \t\n\r\f]|[0-9]+\.?[ \t\n\r\f]*[A-Za-z])"
PUNCTUATION = ".,;:!?\"'()-[]{}"
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
REFUSAL = r"(?i)\b(i cannot|i can't|as an ai|i'm an ai|i am an ai|ethical guidelines)\b"
BOILERPLATE_STARTS = [
    "sure", "here is", "here's", "certainly", "of course", "title:", "abstract:", "i'd be happy", "i am happy", "i'm happy", "i have:",
    "continuation:", "continued:", "essay:",
]


def present(text: Column) -> Column:
    """The text, or an empty one for null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column, white: str = WHITE) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(present(text), white), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(present(text)), F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    """Trimmed non-empty lines."""
    trimmed = F.transform(F.split(present(text), r"\n"), strip)
    return F.filter(trimmed, lambda x: x != "")


def strip(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def normalize(text: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(present(text), WHITE, " "))


def word_count(text: Column, white: str = WHITE) -> Column:
    return F.size(words(text, white)).cast("long")


def ngrams(ws: Column, n: int) -> Column:
    """n-grams of an array of words, each joined by a space; empty if there are fewer than n."""
    starts = F.sequence(F.lit(1), F.size(ws) - (n - 1))
    return F.when(F.size(ws) >= n, F.transform(starts, lambda i: F.array_join(F.slice(ws, i, n), " "))).otherwise(F.array().cast("array<string>"))


def gram_hashes(ws: Column, n: int) -> Column:
    """64-bit hashes of the n-grams of an array of words: for counting distinct ones without building strings."""
    starts = F.sequence(F.lit(1), F.size(ws) - (n - 1))
    grams = F.transform(starts, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(n)]))
    return F.when(F.size(ws) >= n, grams).otherwise(F.array().cast("array<bigint>"))


def once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """keep and the named columns, each computed once per row.

    Chained projections would be merged and a shared array computed again for
    every metric that uses it; the one-element explode keeps them apart.
    """
    made = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*keep, F.explode(made).alias("__m")).select(*keep, "__m.*")


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a.cast("double") / F.greatest(b.cast("double"), F.lit(1.0))


def _capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def matched_length(text: Column, pattern: str) -> Column:
    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))


def removed_length(text: Column, letters: str) -> Column:
    """Number of characters of text that are among letters."""
    return F.length(text) - F.length(F.translate(text, letters, ""))


# ---- structure ---------------------------------------------------------------------------------


def share_of_lines(ls: Column, pattern: str) -> Column:
    return ratio(F.size(F.filter(ls, lambda x: x.rlike(pattern))), F.size(ls))


def bullet_like_line_ratio(ls: Column) -> Column:
    return share_of_lines(ls, BULLET)


def list_marker_ratio(ls: Column) -> Column:
    return share_of_lines(ls, LIST_MARK)


def line_start_symbol_ratio(ls: Column) -> Column:
    return share_of_lines(ls, r"^[^\p{L}]")


def repeated_dash_ratio(text: Column) -> Column:
    """Characters in dash runs; a single em dash counts, a single hyphen doesn't."""
    return _capped(ratio(matched_length(present(text), "-{2,}|—+"), F.length(present(text))))


def repeated_quote_ratio(text: Column) -> Column:
    t = present(text)
    return _capped(ratio((count_matches(t, '""') + count_matches(t, "''")) * 2, F.length(t)))


def tilde_ratio(text: Column) -> Column:
    return ratio(removed_length(present(text), "~"), F.length(present(text)))


def abnormal_punctuation_density(text: Column, ls: Column) -> Column:
    return _capped(
        0.35 * bullet_like_line_ratio(ls) + 0.15 * repeated_dash_ratio(text) + 0.10 * repeated_quote_ratio(text)
        + 0.10 * _capped(tilde_ratio(text) * 20) + 0.30 * line_start_symbol_ratio(ls)
    )


def structural(text: Column, ls: Column) -> dict[str, Column]:
    """The seven structural metrics by name."""
    return {
        "bullet_like_line_ratio": bullet_like_line_ratio(ls),
        "repeated_dash_ratio": repeated_dash_ratio(text),
        "repeated_quote_ratio": repeated_quote_ratio(text),
        "tilde_ratio": tilde_ratio(text),
        "list_marker_ratio": list_marker_ratio(ls),
        "line_start_symbol_ratio": line_start_symbol_ratio(ls),
        "abnormal_punctuation_density": abnormal_punctuation_density(text, ls),
    }


# ---- repetition and surface --------------------------------------------------------------------


def repetition_ratio(ws: Column, n: int = 2) -> Column:
    """n for each n-gram seen before, per word; 0 below 2n words. May exceed 1."""
    repeats = F.greatest(F.size(ws) - (n - 1), F.lit(0)) - F.size(F.array_distinct(gram_hashes(ws, n)))
    return F.when(F.size(ws) < 2 * n, 0.0).otherwise(ratio(repeats * n, F.size(ws)))


def repeated_token_fraction(ws: Column) -> Column:
    return ratio(F.size(ws) - F.size(F.array_distinct(ws)), F.size(ws))


def punctuation_ratio(text: Column) -> Column:
    return ratio(removed_length(present(text), PUNCTUATION), F.length(present(text)))


def punct_density(text: Column) -> Column:
    """Share of characters that are ASCII punctuation."""
    return ratio(removed_length(present(text), ASCII_PUNCTUATION), F.length(present(text)))


def caps_ratio(text: Column) -> Column:
    t = present(text)
    return ratio(count_matches(t, r"\p{Lu}"), count_matches(t, r"\p{L}"))


def filler_loop_score(text: Column, phrases: list[str] = FILLERS) -> Column:
    """Sum over runs of two or more of the same filler of min(1, words / 5), at most 1."""
    t, total = F.lower(present(text)), F.lit(0.0)
    for p in phrases:
        runs = F.regexp_extract_all(t, F.lit(rf"(?:\b{p}\b[ \t\n\r\f]*){{2,}}"), F.lit(0))
        total = total + F.aggregate(runs, F.lit(0.0), lambda a, x: a + F.least(F.lit(1.0), F.size(words(x)) / F.lit(5.0)))
    return _capped(total)


def pattern_hits(text: Column, patterns: list[str]) -> Column:
    t, hits = F.lower(present(text)), F.lit(0)
    for p in patterns:
        hits = hits + F.when(t.rlike(p), 1).otherwise(0)
    return hits


def instruction_echo_ratio(text: Column) -> Column:
    return _capped(pattern_hits(text, INSTRUCTION_ECHO) / F.lit(max(len(INSTRUCTION_ECHO) * 0.2, 1)))


def writing_advice_ratio(text: Column) -> Column:
    return _capped(pattern_hits(text, WRITING_ADVICE) / F.lit(max(len(WRITING_ADVICE) * 0.25, 1)))


def off_task_generic_ratio(text: Column) -> Column:
    return _capped(pattern_hits(text, OFF_TASK_GENERIC) / F.lit(max(len(OFF_TASK_GENERIC) * 0.3, 1)))


def generic_phrase_ratio(text: Column, ws: Column, phrases: list[str]) -> Column:
    """Occurrences of phrases as plain substrings, per word, at most 1."""
    t, hits = F.lower(present(text)), F.lit(0)
    for p in phrases:
        p = p.lower()
        hits = hits + ((F.length(t) - F.length(F.replace(t, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return _capped(ratio(hits, F.size(ws)))


def length_penalty(n: Column, least: int, most: int) -> Column:
    """Linear outside [least, most]."""
    return F.when(n < least, (least - n) / F.lit(float(max(least, 1)))).when(n > most, (n - most) / F.lit(float(max(most, 1)))).otherwise(0.0)


# ---- relevance and quality ---------------------------------------------------------------------


def task_keywords(instruction: Column, most: int = 10) -> Column:
    """First distinct lower-case words of three or more letters that aren't stopwords."""
    found = F.filter(tokens(instruction), lambda t: t.rlike("^[a-z]{3,}$"))
    stop = F.array(*map(F.lit, KEYWORD_STOPWORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w))), 1, most)


def task_relevance(text: Column, keywords: Column) -> Column:
    """Share of keywords found in the text; 1 without keywords."""
    t = F.lower(present(text))
    found = F.size(F.filter(keywords, lambda k: F.contains(t, k)))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(ratio(found, F.size(keywords)))


def prompt_copy_ratio(out_tokens: Column, prompt_tokens: Column) -> Column:
    """1.5 times the share of the output's distinct tokens that the prompt has, at most 1."""
    mine = F.array_distinct(out_tokens)
    return _capped(ratio(F.size(F.array_intersect(mine, prompt_tokens)), F.size(mine)) * 1.5)


def semantic(text: Column, out_tokens: Column, prompt_tokens: Column, keywords: Column) -> dict[str, Column]:
    """The semantic metrics by name."""
    echo, advice, generic = instruction_echo_ratio(text), writing_advice_ratio(text), off_task_generic_ratio(text)
    copied, relevance = prompt_copy_ratio(out_tokens, prompt_tokens), task_relevance(text, keywords)
    return {
        "instruction_echo_ratio": echo, "writing_advice_ratio": advice, "off_task_generic_ratio": generic,
        "prompt_copy_ratio": copied, "task_relevance_score": relevance,
        "semantic_meta_score": _capped((echo + advice + generic) / 3.0 + 0.3 * copied),
        "semantic_off_task_score": _capped((1.0 - relevance) + 0.5 * generic),
    }


def information_density(toks: Column) -> Column:
    """Half distinct, half non-stopword share, scaled down for short texts."""
    n = F.size(toks).cast("double")
    stop = F.array(*map(F.lit, STOPWORDS))
    distinct = ratio(F.size(F.array_distinct(toks)), F.size(toks))
    content = ratio(F.size(F.filter(toks, lambda t: ~F.array_contains(stop, t))), F.size(toks))
    factor = F.when(n <= 3, 0.0).when(n < 15, (n - 3) / 12.0).otherwise(F.least(F.lit(1.0), n / 80.0))
    return _unit((0.5 * distinct + 0.5 * content) * factor)


def sentence_length_score(text: Column) -> Column:
    """1 for mean sentence lengths of 5 to 40 words, less outside."""
    lengths = F.filter(F.transform(F.split(present(text), "[.!?]+"), lambda s: F.size(words(s))), lambda n: n > 0)
    mean = ratio(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), F.size(lengths))
    score = F.when(mean < 5, mean / 5.0).when(mean > 40, F.greatest(F.lit(0.0), 1.0 - (mean - 40) / 40.0)).otherwise(1.0)
    return F.when(F.size(lengths) == 0, 0.0).otherwise(score)


def clarity(text: Column, abnormal: Column, repetition: Column, echo: Column) -> Column:
    score = 0.4 * sentence_length_score(text) + 0.2 * _unit(1.0 - abnormal) + 0.2 * _unit(1.0 - 2.0 * repetition) + 0.2 * _unit(1.0 - 2.0 * echo)
    return F.when(strip(present(text)) == "", 0.0).otherwise(_unit(score))


def completeness(text: Column, toks: Column, keywords: Column) -> Column:
    relevance, density = task_relevance(text, keywords), information_density(toks)
    score = F.when(F.size(keywords) == 0, density).when(relevance > 0, relevance).otherwise(_unit(0.3 * density))
    return F.when(strip(present(text)) == "", 0.0).otherwise(score)


def quality(info: Column, clear: Column, complete: Column, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> Column:
    a, b, c = weights
    return _unit((info * a + clear * b + complete * c) / max(1e-6, a + b + c))


def ngram_repetition(toks: Column, n: int = 3) -> Column:
    """1 - distinct / total n-grams; 0 without n-grams."""
    total = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    return F.when(total == 0, 0.0).otherwise(1.0 - ratio(F.size(F.array_distinct(gram_hashes(toks, n))), total))


def distinct_n(toks: Column, n: int = 2) -> Column:
    return ratio(F.size(F.array_distinct(gram_hashes(toks, n))), F.greatest(F.size(toks) - (n - 1), F.lit(0)))


def lightweight_style(text: Column, toks: Column) -> Column:
    vague = F.array(*map(F.lit, VAGUE_TERMS))
    share = ratio(F.size(F.filter(toks, lambda t: F.array_contains(vague, t))), F.size(toks))
    bonus = F.when(present(text).rlike("[:;]"), 0.1).otherwise(0.0)
    score = _unit(0.65 * F.least(F.size(toks) / F.lit(20.0), F.lit(1.0)) + bonus - 1.5 * share)
    return F.when(F.size(toks) == 0, 0.0).otherwise(score)


# ---- cleaning ----------------------------------------------------------------------------------


def trim_window(text: Column, least: int, most: int) -> Column:
    """Null below ``least`` words; the first ``most`` words joined by spaces above; else the text."""
    w = words(text)
    return F.when(F.size(w) > most, F.array_join(F.slice(w, 1, most), " ")).when(F.size(w) >= least, text)


def clean_title(raw: Column) -> Column:
    t = strip(F.regexp_replace(strip(present(raw)), "^[\"']|[\"']$", ""))
    return strip(F.regexp_replace(t, r"(?i)^(?:title|subject):[ \t\n\r\f]*", ""))


def clean_rewrite(raw: Column) -> Column:
    t = F.regexp_replace(strip(present(raw)), r"(?i)^(rewrite|rewritten prompt|new prompt)[ \t\n\r\f]*[:\-][ \t\n\r\f]*", "")
    return normalize(F.regexp_replace(t, r"^[0-9]+[).:-][ \t\n\r\f]*", ""))


def strip_boilerplate(text: Column) -> Column:
    """Without the first paragraph if it opens like an assistant's preface."""
    t = strip(present(text))
    first = F.lower(strip(F.split(t, "\n\n", 2)[0]))
    opens = F.lit(False)
    for p in BOILERPLATE_STARTS:
        opens = opens | first.startswith(p)
    rest = F.when(F.instr(t, "\n\n") > 0, F.substr(t, F.instr(t, "\n\n") + 2)).otherwise(F.lit(""))
    return strip(F.when(opens, rest).otherwise(t))


def normalize_answer(text: Column) -> Column:
    """Collapsed white space, no trailing dots, lower case."""
    return F.lower(F.regexp_replace(normalize(text), r"\.+$", ""))


def canonical_template(prompt: Column, topic: Column) -> Column:
    """The topic replaced by {topic}: exact occurrences, else the first in any case."""
    p, t = present(prompt), present(topic)
    at = F.instr(F.lower(p), F.lower(t))
    first = F.concat(F.substr(p, F.lit(1), at - 1), F.lit("{topic}"), F.substr(p, at + F.length(t)))
    return F.when(t == "", p).when(F.contains(p, t), F.replace(p, t, F.lit("{topic}"))).when(at > 0, first).otherwise(p)
