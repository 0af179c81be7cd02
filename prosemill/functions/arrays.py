"""Arrays of tokens, labels, scores and vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x.cast("double"))


def mean(xs: Column) -> Column:
    """Mean of an array; 0 if empty."""
    return F.coalesce(F.try_divide(total(xs), F.size(xs).cast("double")), F.lit(0.0))


def masked(xs: Column, mask: Column | None) -> Column:
    """The values whose mask is 1; all of them without a mask."""
    if mask is None:
        return xs
    both = F.zip_with(xs, mask, lambda x, m: F.when(m == 1, x))
    return F.filter(both, lambda x: x.isNotNull())


def pool(xs: Column, reduction: str, fraction: float = 0.1, mask: Column | None = None) -> Column:
    """Token scores to one score: mean, sum, max, or topk (mean of the top fraction, at least one).

    The number of top tokens is taken from the unmasked length, so padding
    can't enter a short text's score.
    """
    v = masked(xs, mask)
    if reduction == "sum":
        return total(v)
    if reduction == "max":
        return F.coalesce(F.array_max(v).cast("double"), F.lit(0.0))
    if reduction == "topk":
        k = F.greatest(F.lit(1), F.floor(F.size(v) * fraction)).cast("int")
        return mean(F.slice(F.reverse(F.array_sort(v)), F.lit(1), k))
    return mean(v)


def bottom_k(xs: Column, k: int, mask: Column | None = None) -> Column:
    """Mean of the k smallest unmasked values."""
    return mean(F.slice(F.array_sort(masked(xs, mask)), 1, k))


def label_any(labels: Column) -> Column:
    """1 if any label is 1, ignoring IGNORE."""
    return F.when(F.exists(labels, lambda x: x == 1), 1).otherwise(0)


def label_majority(labels: Column) -> Column:
    """1 if more than half of the labels are 1, ignoring IGNORE."""
    return F.when(mean(F.filter(labels, lambda x: x != IGNORE)) > 0.5, 1).otherwise(0)


def chunks(xs: Column, size: int, stride: int | None = None, most: int | None = None) -> Column:
    """Overlapping slices of an array, until it is covered; one slice if it is short, none if empty."""
    stride = stride or size // 2
    n = F.size(xs)
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / float(stride)).cast("int") + 1)
    if most is not None:
        count = F.least(count, F.lit(most))
    starts = F.sequence(F.lit(0), count - 1)
    return F.when(n > 0, F.transform(starts, lambda i: F.slice(xs, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def pad(xs: Column, length: int, value: int) -> Column:
    """xs cut or padded to a length."""
    return F.slice(F.concat(xs, F.array_repeat(F.lit(value), length)), 1, length)


def char_chunks(text: Column, size: int) -> Column:
    """Fixed-size slices of a text's characters."""
    n = F.ceil(F.length(text) / float(size)).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def labels_from_spans(offsets: Column, spans: Column) -> Column:
    """1 for tokens (start, end) whose midpoint lies in a span, else 0; tokens of no width get IGNORE."""
    def label(o: Column) -> Column:
        mid = (o["start"] + o["end"]) / 2.0
        return F.when(o["start"] == o["end"], IGNORE).when(F.exists(spans, lambda s: (mid >= s["start"]) & (mid < s["end"])), 1).otherwise(0)

    return F.transform(offsets, label)


def prompt_mask(prompt_size: Column, ids: Column, length: int) -> Column:
    """Labels equal to ids, IGNORE on the prompt's positions and on padding."""
    kept = F.transform(F.slice(ids, 1, length), lambda x, i: F.when(i < prompt_size, F.lit(IGNORE)).otherwise(x))
    return pad(kept, length, IGNORE)


def align_labels(labels: Column, n_words: Column) -> Column:
    """Word labels fitted to n_words positions: copied, cut, or filled with IGNORE."""
    return F.slice(F.concat(labels, F.array_repeat(F.lit(IGNORE), n_words)), F.lit(1), F.greatest(n_words, F.lit(0)))


def kl_mean(p: Column, q: Column) -> Column:
    """Sum of p log(p / q) over two arrays of probabilities; terms with p = 0 are 0."""
    terms = F.zip_with(p, q, lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(0.0))
    return total(terms)


def unit(v: Column) -> Column:
    """A vector scaled to length 1; unchanged if it is 0."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def composite_drift(semantic: Column, rouge: Column, bert: Column, slop: Column, gate: float, weights: tuple[float, float, float] = (1.0, 0.35, 0.5)) -> Column:
    """Weighted drift components, counted only where slop is at or below the gate."""
    a, b, c = weights
    return F.when(slop <= gate, a * semantic + b * (1 - rouge) + c * (1 - bert)).otherwise(0.0)


def fluency(log_probabilities: Column) -> Column:
    """Mean log-probability of a text's tokens (minus the mean loss); null for none."""
    n = F.size(log_probabilities)
    return F.when(n > 0, F.aggregate(log_probabilities, F.lit(0.0), lambda s, x: s + x) / n)


def perplexity(log_probabilities: Column) -> Column:
    return F.exp(-fluency(log_probabilities))


def greedy_match(candidate: Column, reference: Column) -> dict[str, Column]:
    """precision, recall and f1 of two arrays of token vectors: each token counts its best cosine on the other side."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = lambda a, b: F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    best = lambda mine, others: F.transform(mine, lambda a: F.array_max(F.transform(others, lambda b: cosine(a, b))))
    mean = lambda values, n: F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / n
    p, r = mean(best(candidate, reference), F.size(candidate)), mean(best(reference, candidate), F.size(reference))
    return {"precision": p, "recall": r, "f1": F.try_divide(2 * p * r, p + r)}
