"""Synthetic slop: seeded rule transforms, labelled variants, corruptions and their datasets.

Random choices come from a generator seeded with the row's key, so a row gives
the same result on any partition. Rules run on Arrow batches; the deterministic
parts are Column expressions.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

# Word lists and probabilities of the rules.
FILLER_PHRASES = [
    "you know", "like", "basically", "I mean", "kind of", "sort of", "um", "uh", "to be honest", "at the end of the day", "well", "so",
    "actually", "literally", "right", "anyway", "or whatever", "and stuff", "things like that",
]
VAGUE_PHRASES = ["in practice", "in general", "in many cases", "to some extent", "in some sense", "to a degree", "by and large", "for the most part", "in principle"]
HEDGES = [
    "might", "perhaps", "possibly", "somewhat", "generally", "often", "could be", "tends to", "usually", "typically", "maybe", "sometimes",
    "fairly", "rather", "quite", "relatively", "broadly", "largely",
]
OPENERS = [
    "In today's world,", "It's important to note that", "At the end of the day,", "When you think about it,", "The reality is that",
    "It goes without saying that", "As we all know,", "In this day and age,", "Needless to say,", "Having said that,", "That being said,",
    "When it comes down to it,", "The fact of the matter is",
]
GENERIC_NOUNS = {
    "car": "vehicle", "cars": "vehicles", "doctor": "professional", "doctors": "professionals", "hospital": "facility", "hospitals": "facilities",
    "company": "organization", "companies": "organizations", "employee": "person", "employees": "people", "customer": "person", "customers": "people",
    "student": "individual", "students": "individuals", "teacher": "professional", "teachers": "professionals", "computer": "device", "computers": "devices",
    "phone": "device", "phones": "devices", "problem": "situation", "problems": "situations", "solution": "approach", "solutions": "approaches",
    "result": "outcome", "results": "outcomes", "idea": "concept", "ideas": "concepts", "book": "resource", "books": "resources", "movie": "content",
    "movies": "content", "restaurant": "place", "restaurants": "places", "house": "place", "houses": "places", "city": "area", "cities": "areas",
    "country": "region", "countries": "regions",
}
PRESETS = {
    "easy": {"filler": 0.25, "hedge": 0.2, "repeat": 0.15, "noun": 0.3, "opener": 0.2, "vague": 0.0},
    "medium": {"filler": 0.12, "hedge": 0.1, "repeat": 0.08, "noun": 0.15, "opener": 0.1, "vague": 0.0},
    "hard": {"filler": 0.0, "hedge": 0.12, "repeat": 0.0, "noun": 0.2, "opener": 0.0, "vague": 0.15},
}
UNHEDGED = {"the", "a", "an", "and", "or", "but"}

Labelled = list[tuple[str, int]]


def generic_nouns(words: Column) -> Column:
    """Words joined, listed nouns replaced by their general term; punctuation after a replaced noun is lost."""
    nouns = F.create_map(*[F.lit(x) for pair in GENERIC_NOUNS.items() for x in pair])

    def swap(w: Column) -> Column:
        to = nouns[F.rtrim(F.lower(w), F.lit(".,;:!?"))]
        upper = F.concat(F.upper(F.left(to, F.lit(1))), F.substr(to, F.lit(2)))
        return F.coalesce(F.when(w.rlike(r"^\p{Lu}"), upper).otherwise(to), w)

    return F.array_join(F.transform(words, swap), " ")


def _insert(words: Labelled, rng: random.Random, p: float, phrases: list[str], before: bool, skip: set[str] = frozenset()) -> Labelled:
    out: Labelled = []
    for i, (w, label) in enumerate(words):
        extra = []
        if (before or i < len(words) - 1) and w.lower() not in skip and rng.random() < p:
            extra = [(x, 1) for x in rng.choice(phrases).split()]
        out += [*extra, (w, label)] if before else [(w, label), *extra]
    return out


def _nouns(words: Labelled, rng: random.Random, p: float) -> Labelled:
    out: Labelled = []
    for w, label in words:
        to = GENERIC_NOUNS.get(w.lower().rstrip(".,;:!?"))
        out.append((to.capitalize() if w[0].isupper() else to, 1) if to and rng.random() < p else (w, label))
    return out


def _repeat(words: Labelled, rng: random.Random, p: float) -> Labelled:
    ends = [i + 1 for i, (w, _) in enumerate(words) if w[-1] in ".!?"]
    starts = [0, *ends]
    if len(ends) < 2 or rng.random() >= p:
        return words
    k = rng.randrange(len(ends))
    copy = [(w, 1) for w, _ in words[starts[k] : ends[k]]]
    at = rng.choice(starts)
    return words[:at] + copy + words[at:]


def _opener(words: Labelled, rng: random.Random, p: float) -> Labelled:
    if not words or rng.random() >= p:
        return words
    first, label = words[0]
    return [(x, 1) for x in rng.choice(OPENERS).split()] + [(first[0].lower() + first[1:], label)] + words[1:]


def sloppify(text: str, seed: str, difficulty: str = "easy") -> tuple[str, list[int]]:
    """(text, a 0/1 label per word): the preset's rules in seeded order."""
    words: Labelled = [(w, 0) for w in text.split()]
    if not words:
        return "", []
    p, rng = PRESETS[difficulty], random.Random(seed)
    rules: list[Callable[[Labelled], Labelled]] = [
        lambda x: _insert(x, rng, p["filler"], FILLER_PHRASES, False) if len(x) >= 3 else x,
        lambda x: _insert(x, rng, p["vague"], VAGUE_PHRASES, True) if len(x) >= 3 else x,
        lambda x: _insert(x, rng, p["hedge"], HEDGES, True, UNHEDGED),
        lambda x: _repeat(x, rng, p["repeat"]),
        lambda x: _nouns(x, rng, p["noun"]),
        lambda x: _opener(x, rng, p["opener"]),
    ]
    rng.shuffle(rules)
    for rule in rules:
        words = rule(words)
    return " ".join(w for w, _ in words), [label for _, label in words]


LABELLED = StructType([StructField("text", StringType()), StructField("labels", ArrayType(IntegerType()))])


def sloppified(text: Column, key: Column, difficulty: str, copy: int = 0) -> Column:
    """struct(text, labels) of the rule transform; null text gives null."""

    @F.arrow_udf(LABELLED)
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        made = [(None, None) if t is None else sloppify(t, f"{k}|{difficulty}|{copy}", difficulty) for t, k in zip(texts.to_pylist(), keys.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int32()))], ["text", "labels"])

    return run(text, key.cast("string"))


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, mode, text): the presets and chained presets of each text, without repeats or the text itself."""
    t, k = F.col(text), F.col(key)
    d = df.select(key, text, *[sloppified(t, k, m)["text"].alias(f"__{m}") for m in PRESETS])
    d = d.withColumns({f"__{a}_{b}": sloppified(F.col(f"__{a}"), k, b, 1)["text"] for a, b in (("easy", "hard"), ("medium", "easy"), ("hard", "medium"))})
    modes = [c for c in d.columns if c.startswith("__")]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m[2:]).alias("mode"), F.col(m).alias("text")) for i, m in enumerate(modes)])
    norm = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    e = d.select(key, norm(F.col(text)).alias("__own"), F.explode(rows).alias("r")).select(key, "__own", "r.i", "r.mode", norm(F.col("r.text")).alias("text"))
    e = e.filter("text IS NOT NULL AND text <> __own")
    return e.groupBy(key, "text").agg(F.min(F.struct("i", "mode")).alias("m")).select(key, F.col("m.mode").alias("mode"), "text")


def token_examples(df: DataFrame, key: str, text: str, difficulties: list[str], least_words: int = 4) -> DataFrame:
    """(key, text, labels, difficulty): each clean text with labels 0, and one labelled variant per difficulty."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    base = df.filter(F.col(text).isNotNull()).withColumn("__w", words).filter(F.size("__w") >= least_words)
    clean = F.struct(F.array_join("__w", " ").alias("text"), F.array_repeat(F.lit(0), F.size("__w")).alias("labels"), F.lit("clean").alias("difficulty"))
    made = base.select(key, "__w", *[sloppified(F.col(text), F.col(key), x).alias(f"__{x}") for x in difficulties])
    rows = F.array(clean, *[F.struct(F.col(f"__{x}.text").alias("text"), F.col(f"__{x}.labels").alias("labels"), F.lit(x).alias("difficulty")) for x in difficulties])
    return made.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def repeat_first_gram(words: Column, n: int = 10, times: int = 3) -> Column:
    """The text with its first n words repeated in front."""
    gram = F.slice(words, 1, n)
    return F.array_join(F.concat(*[gram] * times, words), " ")


def filler_prefix(text: Column) -> Column:
    return F.concat(F.lit("Basically, you know, "), text)


def corrupted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, text): shuffled words, repeated gram, filler prefix, a quarter of the words doubled (by hash)."""
    w = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    seeded = F.transform("__w", lambda x, i: F.struct(F.xxhash64(F.col(key), i, x).alias("h"), i.alias("i"), x.alias("x")))
    shuffled = F.array_join(F.transform(F.array_sort(seeded), lambda s: s["x"]), " ")
    doubled = F.array_join(F.flatten(F.transform("__w", lambda x, i: F.when(F.pmod(F.xxhash64(F.col(key), i, x), F.lit(4)) == 0, F.array(x, x)).otherwise(F.array(x)))), " ")
    d = df.filter(F.col(text).isNotNull()).withColumn("__w", w)
    kinds = {"shuffle": shuffled, "repeat_gram": repeat_first_gram(F.col("__w")), "filler_prefix": filler_prefix(F.col(text)), "duplicate": doubled}
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("text")) for k, c in kinds.items()])
    return d.select(key, F.explode(rows).alias("r")).select(key, "r.*")


NUMBER = re.compile(r"\d+(?:[.,]\d+)?")


def corrupt_number(answer: str, seed: str) -> str:
    """The answer with its numbers changed by a seeded amount, years by a few; without numbers, unchanged."""
    rng = random.Random(seed)

    def other(m: re.Match) -> str:
        raw = m.group()
        if re.fullmatch(r"1[0-9]{3}|20[0-9]{2}", raw):
            return str(int(raw) + rng.choice([-7, -3, -2, -1, 1, 2, 3, 7]))
        value = float(raw.replace(",", "."))
        new = value * rng.choice([0.5, 0.8, 1.2, 2.0]) + rng.choice([0, 1])
        return f"{new:.{len(raw.split('.')[1])}f}" if "." in raw else str(int(new) if int(new) != int(value) else int(value) + 1)

    return NUMBER.sub(other, answer)


def fake_answers(df: DataFrame, key: str, question: str, answer: str, n: int) -> DataFrame:
    """(key, text, real): one true row and n with corrupted answers, as Q: ... [SEP] A: ..."""

    @F.arrow_udf(ArrayType(StringType()))
    def fakes(answers: pa.Array, keys: pa.Array) -> pa.Array:
        return pa.array([None if a is None else [corrupt_number(a, f"{k}|{i}") for i in range(n)] for a, k in zip(answers.to_pylist(), keys.to_pylist())], pa.list_(pa.string()))

    d = df.select(key, question, answer, fakes(F.col(answer), F.col(key).cast("string")).alias("__f"))
    real = F.array(F.struct(F.col(answer).alias("a"), F.lit(1).alias("real")))
    rows = F.concat(real, F.transform("__f", lambda a: F.struct(a.alias("a"), F.lit(0).alias("real"))))
    e = d.select(key, question, F.explode(rows).alias("r"))
    return e.select(key, F.concat(F.lit("Q: "), F.col(question), F.lit(" [SEP] A: "), F.col("r.a")).alias("text"), "r.real")


# Slots a prompt specification can change, with alternatives.
SLOT_CHOICES = {
    "tone": ["plain", "direct", "neutral", "warm"], "audience": ["general readers", "students", "experts"],
    "output_format": ["plain paragraphs", "one short paragraph"], "reasoning_style": ["step by step", "from examples"],
}


def mutate_spec(spec: dict[str, str], seed: str, strength: int = 1) -> tuple[dict[str, str], list[str]]:
    """(changed specification, changed slots): ``strength`` slots take another of their choices."""
    rng = random.Random(seed)
    out, changed = dict(spec), []
    for slot in rng.sample(sorted(SLOT_CHOICES), min(strength, len(SLOT_CHOICES))):
        others = [c for c in SLOT_CHOICES[slot] if c != spec.get(slot)]
        out[slot] = rng.choice(others)
        changed.append(slot)
    return out, changed


RULES = {
    "fillers": lambda w, r, p: _insert(w, r, p, FILLER_PHRASES, False) if len(w) >= 3 else w,
    "vague": lambda w, r, p: _insert(w, r, p, VAGUE_PHRASES, True) if len(w) >= 3 else w,
    "hedging": lambda w, r, p: _insert(w, r, p, HEDGES, True, UNHEDGED),
    "repeat": _repeat,
    "nouns": _nouns,
    "opener": _opener,
}


def single_rule(text: Column, key: Column, rule: str, p: float) -> Column:
    """struct(text, labels) of one rule at probability p."""

    @F.arrow_udf(LABELLED)
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        made = [None if t is None else RULES[rule]([(w, 0) for w in t.split()], random.Random(f"{k}|{rule}"), p) for t, k in zip(texts.to_pylist(), keys.to_pylist())]
        out = [pa.array([None if m is None else " ".join(w for w, _ in m) for m in made], pa.string()), pa.array([None if m is None else [x for _, x in m] for m in made], pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(out, ["text", "labels"])

    return run(text, key.cast("string"))


def mutated_spec(spec_json: Column, key: Column, strength: int) -> Column:
    """A specification as JSON with ``strength`` slots changed, and their names under "changed"."""
    import json

    @F.arrow_udf(StringType())
    def run(specs: pa.Array, keys: pa.Array) -> pa.Array:
        out = []
        for s, k in zip(specs.to_pylist(), keys.to_pylist()):
            spec, changed = mutate_spec(json.loads(s) if s else {}, f"{k}|{strength}", strength)
            out.append(json.dumps(spec | {"changed": changed}, sort_keys=True, ensure_ascii=False))
        return pa.array(out, pa.string())

    return run(spec_json, key.cast("string"))
