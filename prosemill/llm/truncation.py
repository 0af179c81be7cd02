"""Text cut off by field limits or in transfer (problem 3).

Two kinds of evidence decide whether a text is unfinished.

* Near-copies. Every text's last full five-word shingle is looked up among the
  shingles of all texts (those that pass a Bloom filter of the looked-up ones;
  hits are joined exactly), where behind it stand at most as many new shingles as
  a near-copy can lack, however often words repeat. Texts meet by keys of the shingle and what stands
  behind it, so only such as go on behind another's end, or end in a longer word,
  are compared, and by the prefix of their shingles in hash order, which no pair of
  similarity 0.8 fails to share. A text that is shown to be cut by one of the
  smallest and largest partners of a group is settled; the others meet all their
  partners. The result is that of aligning every pair: a text was cut if any
  copy of shingle similarity 0.8 goes on within the sentence or the word, and was
  left out at a sentence's end (``whole``) if all that go on do so with a
  new sentence. Exact copies are one text throughout.
* Closing words. The rest is scored by how the text closes: a remnant of a cut
  or no closing mark means unfinished; lines that close a text without a mark
  (list items, tags, counts, sign-offs, headings) mean finished; behind a full
  stop, the closing word's terminality decides, the smoothed share of its
  occurrences in the corpus behind which a sentence really ends ("etc." often,
  "approx." never). Counts are over all texts, pre-aggregated in the map stage.

Texts are read in canonical form, so a cut in look-alike or full-width spelling
counts the same. Defined results: null, blank and placeholder texts are never
unfinished (state ``empty``); repeated keys count once; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from prosemill.llm.canonical import screen_key_text
from prosemill.session import durable

SHINGLE, SIMILARITY = 5, 0.8
TERMINAL = 0.5  # least terminality of a closing word

# Contents that stand for nothing.
PLACEHOLDERS = {
    "null", "none", "nil", "nan", "na", "n/a", "n.a.", "n. a.", "tbd", "todo", "empty", "undefined", "missing", "blank", "unknown",
    "no output", "no response", "no text", "no content", "no answer", "placeholder", "not available", "lorem ipsum",
    "keine angabe", "k. a.", "k.a.", "leer", "kein text", "sin respuesta", "vacío", "sin texto", "néant", "aucun", "vide",
}
# Abbreviations a sentence doesn't close with.
OPEN_ABBREVIATIONS = {
    "approx", "e.g", "i.e", "vs", "mr", "mrs", "ms", "dr", "prof", "cf", "z.b", "d.h", "bzw", "vgl", "sog",
    "u.a", "p.ej", "sr", "sra", "p.ex", "c.-à-d", "a.m", "p.m", "pp", "dept",
}
AMBIGUOUS = {"no", "nr", "st", "fig", "ca", "gen", "rev", "vol", "est"}
SENTENCE_MARKS = ".!?。！？؟।॥።‼⁇⁈⁉"
STEM_END = "…,;:(-"
CLOSERS = "\"'”’»›“)]}*_`>~」』）】"
TOPIC_LABELS = {"topic", "thema", "tema", "sujet", "subject", "theme", "título", "title"}
SIGN_OFF = re.compile(r"^(?:[—–―]|--)\s*\S|^(?:yours|sincerely|best|kind|warm)\b.{0,40}$|^(?:mit freundlichen|viele grüße|atentamente|cordialement)\b", re.I)
ITEM = re.compile(r"^(?:[-*•‣·+–]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+\S")
TAGS = re.compile(r"^(?:#[\w-]+[\s,;]*)+$")
COUNT = re.compile(r"^\(?\s*(?:[^\W\d_][\w .-]{0,30}[:=]\s*[\d.,]+\s*%?|\[?[\d.,]+\s+[^\W\d_]+)\s*\]?\)?$")
MARKUP = re.compile(r"(?:\s*(?:</?[a-zA-Z][^<>]{0,40}>|&[a-zA-Z#0-9]{2,8};))+$")


SIGNS = "()[]{}<>*\"'`_-–—.…/\\#~ \t\n"


LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))


def is_placeholder(text: str) -> bool:
    """Blank, or only a sign for a missing value."""
    bare = text.strip(SIGNS)
    if len(bare) > LONGEST_PLACEHOLDER:
        return False
    return not bare or bare.lower() in PLACEHOLDERS or text.strip().lower() in PLACEHOLDERS


def strip_pictures(s: str) -> str:
    """s without trailing pictographs and white space."""
    end = len(s)
    while end and (s[end - 1].isspace() or ord(s[end - 1]) in (0xFE0F, 0x200D) or 0x2600 <= ord(s[end - 1]) <= 0x27BF or 0x1F000 <= ord(s[end - 1]) <= 0x1FAFF):
        end -= 1
    return s[:end]


def ending(text: str | None, topic: str | None = None) -> tuple[str, str | None]:
    """How a canonical text closes: (empty | closed | cut | marked, closing word if marked)."""
    if text is None or is_placeholder(text):
        return "empty", None
    body = text.rstrip()
    if body.endswith("```"):
        return "closed", None
    lines = body.rsplit("\n", 1)
    last = lines[-1].strip()
    if len(lines) > 1:
        label, colon, value = last.partition(":")
        if colon and label.strip(" *_#").lower() in TOPIC_LABELS:
            value = value.strip(" *_\"'.").casefold()
            known = (topic or "").strip().casefold()
            return ("cut" if not value or known != value and known.startswith(value) else "closed"), None
        if TAGS.match(last) or COUNT.match(last) or SIGN_OFF.match(last):
            return "closed", None
        if last.startswith("#") and not last.endswith(("…", "...", "[...]", ",", "(")):
            return "closed", None
        if last.isupper() and len(last.split()) <= 8 and not lines[0].rstrip().isupper() and last[-1].isalnum():
            return "closed", None
        if ITEM.match(last) and last[-1].isalnum():
            return "closed", None
        if last[0] == "|" and last[-1] == "|":
            return "closed", None
    if body[-1] in ">;":
        body = MARKUP.sub("", body)
    body = strip_pictures(body)
    bare = body.rstrip(CLOSERS + " \n")
    if not bare:
        return "closed", None
    if bare.endswith(("…", "..", "[")) or body.rstrip("])}").endswith(("…", "...")):
        return "cut", None
    if bare[-1] not in SENTENCE_MARKS:
        return "cut", None
    if bare[-1] != ".":
        return "marked", None
    return "marked", closing_key(bare.rsplit(None, 2)[-2:])


def closing_key(ws: list[str]) -> str:
    """The closing word; one that is a word as often as an abbreviation comes with the word before."""
    last = core(ws[-1])
    return f"{core(ws[-2])} {last}" if last in AMBIGUOUS and len(ws) > 1 else last


def core(word: str) -> str:
    """The closing word without outer marks, lower-cased; numbers are one class."""
    w = word.strip(CLOSERS + "([{«“‘¿¡" + SENTENCE_MARKS + ",;:").lower()
    return "<number>" if w and not any(c.isalpha() for c in w) else w


AFTER_STOP = "\"'”’)*]"
BEFORE_WORD = "\"'“(*["


def closing_counts(texts: list[str]) -> Counter:
    """(core, ends) -> occurrences of full stops inside the texts; ends: what follows begins a sentence."""
    found: Counter = Counter()
    cores: dict[str, str] = {}
    for t in texts:
        ws, fresh = t.split(), set()  # all words, and the numbers of those that begin a line
        if "\n" in t:
            n = 0
            for line in t.split("\n"):
                fresh.add(n)
                n += len(line.split())
        for i in [i for i, w in enumerate(ws[:-1]) if "." in w]:
            bare = ws[i].rstrip(AFTER_STOP)
            if bare[-1:] == "." and len(bare) > 1:
                head = ws[i + 1].lstrip(BEFORE_WORD)[:1]
                if head:
                    key = cores.get(bare)
                    if key is None:
                        key = cores[bare] = core(bare)
                    if i and key in AMBIGUOUS:
                        key = closing_key(ws[i - 1 : i + 1])
                    found[key, i + 1 in fresh or not (head.islower() or head.isdigit())] += 1
    return found


def terminality(texts: DataFrame, text: str) -> DataFrame:
    """(word, terminality) over all texts; a row per distinct word before a full stop."""

    def count(batches):
        for b in batches:
            found = closing_counts([x for x in b.column(0).to_pylist() if x])
            words = sorted({w for w, _ in found})
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words, pa.string()), "ends": pa.array([found[w, True] for w in words], pa.int64()), "goes_on": pa.array([found[w, False] for w in words], pa.int64())}
            )

    d = texts.select(text).mapInArrow(count, "word string, ends long, goes_on long").groupBy("word").agg(F.sum("ends").alias("e"), F.sum("goes_on").alias("g"))
    return d.select("word", "e", "g")


def closing_score(word: Column, e: Column, g: Column) -> Column:
    """Terminality of a closing word from its counts, smoothed by what kind of word it is."""
    abbreviation = word.isin(*sorted(OPEN_ABBREVIATIONS))
    number = word == "<number>"
    pair = word.contains(" ")
    ends = F.when(abbreviation, 0.2).when(number | pair, 1.0).otherwise(2.0)
    weight = F.when(abbreviation, 4.0).when(number | pair, 1.5).otherwise(2.1)
    return (F.coalesce(e, F.lit(0)) + ends) / (F.coalesce(e, F.lit(0)) + F.coalesce(g, F.lit(0)) + weight)


# ---- near-copies -------------------------------------------------------------------------------


def shingle_hashes(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each five-word shingle; words are the rows' 64-bit word hashes, one after another."""
    if len(words) < SHINGLE:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(words) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - SHINGLE + 1 + k]
    h ^= h >> np.uint64(29)
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = row[: len(h)] == row[SHINGLE - 1 :]
    return row[: len(h)][inside], h[inside]


def text_digest(text: Column) -> Column:
    return F.xxhash64(F.lit(29), text)


SPACES = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]  # what str.split() splits at
IS_SPACE = np.isin(np.arange(256), [c for c in SPACES if c < 128])
WIDE_SPACES = {n: np.array([int.from_bytes(e, "big") for c in SPACES if len(e := chr(c).encode()) == n]) for n in (2, 3)}
BYTES = np.random.default_rng(29).integers(1, 2**64, 256, dtype=np.uint64)  # a value of each byte


def word_hashes(text: pa.Array, part: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words per text) of UTF-8 texts; a hash's last eight bits are those of the word's first byte."""
    found = [_word_hashes(text.slice(lo, part)) for lo in range(0, len(text), part)]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def _word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    text = text.fill_null("").cast(pa.large_string())
    _, offsets, data = text.buffers()
    cuts = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    if cuts[0] == cuts[-1]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(text), dtype=np.int64)
    raw, cuts = np.frombuffer(data, dtype=np.uint8)[cuts[0] : cuts[-1]], cuts - cuts[0]
    gap = IS_SPACE[raw]
    for n, lead in ((2, raw == 0xC2), (3, (raw >= 0xE1) & (raw <= 0xE3))):
        at = np.flatnonzero(lead)
        if len(at):
            at = at[np.isin(sum(raw[at + k].astype(np.int64) << 8 * (n - 1 - k) for k in range(n)), WIDE_SPACES[n])]
            gap[at[:, None] + np.arange(n)] = True
    fresh = np.zeros(len(raw) + 1, dtype=bool)  # behind a space or at a text's begin
    fresh[cuts] = True
    fresh[1:] |= gap
    begin = np.flatnonzero(fresh[:-1] & ~gap)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(text), dtype=np.int64)
    at = np.arange(begin[0], len(raw)) - np.repeat(begin, np.diff(begin, append=len(raw)))
    power = np.cumprod(np.full(int(at.max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    value = BYTES[raw[begin[0] :]] * power[at]
    value[gap[begin[0] :]] = 0
    h = np.add.reduceat(value, begin - begin[0])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return (h & ~np.uint64(255)) | raw[begin], np.diff(np.searchsorted(begin, cuts))


SMALL = 200_000  # rows of a few numbers that may be broadcast


def counted(few: DataFrame) -> DataFrame:
    """few as a side of a join: broadcast if its rows are counted to be few, else by a shuffle."""
    rows = durable(few)
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows.hint("merge")


def attach(wide: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """wide with few's columns, null where few has no row."""
    return wide.join(counted(few), key, "left")


def matching(wide: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """wide's rows whose key is among few's."""
    return wide.join(counted(few), key, "left_semi")


def texts_of(source: DataFrame, digests: DataFrame) -> DataFrame:
    """(d, text) of those digests, once each."""
    return matching(source, digests, "d").dropDuplicates(["d"])


SEGMENT, MOST_BITS, PROBES = 2**23, 2**29, 4  # bits of a part of the filter, bits in all: a fuller filter lets more through and loses nothing


def _bits(cells: np.ndarray, size: int, part: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(segment, bits within it) of each cell in a filter of so many bits."""
    h = cells.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    segment = ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)) % np.uint64(max(1, size // part))
    step = (h >> np.uint64(17)) | np.uint64(1)
    return segment.astype(np.int64), [((h + np.uint64(k) * step) % np.uint64(min(size, part))).astype(np.int64) for k in range(PROBES)]


def bloom_filter(cells: DataFrame, cell: str, part: int = SEGMENT, most: int = MOST_BITS) -> np.ndarray:
    """The bytes of a filter that every cell passes, built in parts by the executors."""
    size = 2**16
    while size < min(most, 16 * cells.count()):
        size *= 2

    def segments(batches):
        for b in batches:
            c = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"segment": _bits(c, size, part)[0], "cell": c})

    def build(group: pa.Table) -> pa.Table:
        flags = np.zeros(min(size, part), dtype=bool)
        for at in _bits(group.column("cell").to_numpy(), size, part)[1]:
            flags[at] = True
        return pa.table({"segment": group.column("segment")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    parts = cells.select(cell).mapInArrow(segments, "segment long, cell long").groupBy("segment").applyInArrow(build, "segment long, bits binary").collect()
    width = min(size, part) // 8
    whole = np.zeros(size // 8, dtype=np.uint8)
    for r in parts:
        whole[r["segment"] * width : (r["segment"] + 1) * width] = np.frombuffer(r["bits"], dtype=np.uint8)
    return whole


def passing(bits: np.ndarray, cells: np.ndarray, part: int = SEGMENT) -> np.ndarray:
    """Numbers of the cells that may be in the filter."""
    size = len(bits) * 8
    segment, probes = _bits(cells, size, part)
    base, left = segment * min(size, part), np.arange(len(cells))
    for at in probes:
        i = base[left] + at[left]
        left = left[(bits[i >> 3] >> (i & 7).astype(np.uint8)) & 1 > 0]
    return left


def _key(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def short_keys(words: list[str]) -> list[int]:
    """What a longer copy must have: the last full shingle with the last word behind it, or with a word that goes on behind its stem."""
    anchor, stem = words[-SHINGLE - 1 : -1], words[-1].rstrip(CLOSERS + SENTENCE_MARKS + STEM_END)
    return [_key("=", *anchor, words[-1])] + ([_key("<", *anchor, stem)] if stem else [])


def long_keys(words: list[str], at: int) -> list[tuple[int, bool]]:
    """(key, whether it shows a cut) of the shorter copies that end at word ``at``."""
    anchor, word = words[at - SHINGLE : at], words[at]
    found = [(_key("<", *anchor, word[:k]), True) for k in range(1, len(word)) if word[k].isalnum()]
    return found + ([(_key("=", *anchor, word), goes_on_within(words, at))] if at < len(words) - 1 else [])


FORM = "d long, n int, prefix array<long>, short array<long>, long array<struct<key:long,cut:boolean>>"


def next_cells(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Cells of shingles and the first byte of the word behind each, which a cut word still has."""
    return (h ^ ((words & np.uint64(255)) + np.uint64(1)) * np.uint64(0xC4CEB9FE1A85EC53)).view(np.int64)


def ends_met(source: DataFrame) -> DataFrame:
    """(d, spots) of the texts that have the cell of another's end or whose own another has: the places of the words behind it, -1 for the own end."""

    def ends(batches):
        for b in batches:
            words, sizes = word_hashes(b.column("text"))
            row = np.flatnonzero(sizes > SHINGLE + 1)
            six = words[np.cumsum(sizes)[row, None] + np.arange(-SHINGLE - 1, 0)]
            _, h = shingle_hashes(six[:, :SHINGLE].reshape(-1), np.full(len(row), SHINGLE))
            yield pa.RecordBatch.from_pydict({"cell": next_cells(h, six[:, SHINGLE]), "d": b.column("d").to_numpy(zero_copy_only=False)[row], "last": six[:, SHINGLE].view(np.int64)})

    own = durable(source.select("d", "text").mapInArrow(ends, "cell long, d long, last long"))
    shared = source.sparkSession.sparkContext.broadcast(bloom_filter(own, "cell"))

    def inner(batches):
        for b in batches:
            words, sizes = word_hashes(b.column("text"))
            row, h = shingle_hashes(words, sizes)
            count = np.bincount(row, minlength=len(sizes))
            begin = np.cumsum(count) - count
            at = np.arange(len(row)) - begin[row]
            inside = np.flatnonzero((at < count[row] - 2) & (count[row] >= 3))
            cell = next_cells(h[inside], words[(np.cumsum(sizes) - sizes)[row[inside]] + at[inside] + SHINGLE])
            left = passing(shared.value, cell)
            seen = np.zeros(len(h) + 1, dtype=np.int64)  # distinct shingles up to each place, over all rows
            fresh = np.isin(row, row[inside[left]]).nonzero()[0]
            order = fresh[np.lexsort((h[fresh], row[fresh]))]
            seen[1:][order[np.r_[True, (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])][: len(order)]]] = 1
            seen = np.cumsum(seen)
            hit = inside[left]
            end = seen[(begin + count)[row[hit]]]
            last = in_tail(end - seen[hit + 1], end - seen[begin[row[hit]]])
            hit, left = hit[last], left[last]
            yield pa.RecordBatch.from_pydict({"cell": cell[left], "d": b.column("d").to_numpy(zero_copy_only=False)[row[hit]], "spot": at[hit] + SHINGLE})

    passed = source.select("d", "text").mapInArrow(inner, "cell long, d long, spot long")
    cells = own.groupBy("cell").agg(F.min("last").alias("lo"), F.max("last").alias("hi"))
    hits = durable(passed.join(cells.hint("merge"), "cell", "left_semi"))
    live = cells.filter("lo <> hi").select("cell").unionByName(hits.select("cell")).distinct()
    spots = matching(own, live, "cell").select("d", F.lit(-1).cast("long").alias("spot")).unionByName(hits.select("d", "spot"))
    return spots.groupBy("d").agg(F.collect_set("spot").alias("spots"))


def forms_of(few: DataFrame) -> DataFrame:
    """(FORM) of texts with spots: number of distinct shingles, the prefix of these in hash order, keys as the shorter and as the longer text."""

    def forms(batches):
        for b in batches:
            words, sizes = word_hashes(b.column("text"))
            row, h = shingle_hashes(words, sizes)
            cuts = np.searchsorted(row, np.arange(len(sizes) + 1))
            out: dict[str, list] = {"n": [], "prefix": [], "short": [], "long": []}
            for i, (text, spots) in enumerate(zip(b.column("text").to_pylist(), b.column("spots").to_pylist())):
                ws, own = text.split(), np.unique(h[cuts[i] : cuts[i + 1]])
                out["n"].append(len(own))
                out["prefix"].append(own[: len(own) - ceil(SIMILARITY * len(own) - 1e-9) + 1].view(np.int64).tolist())
                out["short"].append(short_keys(ws) if -1 in spots else [])
                out["long"].append([{"key": k, "cut": c} for k, c in {x for s in spots for x in long_keys(ws, s if s >= 0 else len(ws) - 1)}])
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), pa.array(out["n"], pa.int32()), *[pa.array(out[c], pa.list_(pa.int64())) for c in ("prefix", "short")], pa.array(out["long"], LONG_TYPE)],
                ["d", "n", "prefix", "short", "long"],
            )

    return few.select("d", "text", "spots").mapInArrow(forms, FORM)


LONG_TYPE = pa.list_(pa.struct([("key", pa.int64()), ("cut", pa.bool_())]))


def partners(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(x, y sides) a row per key and prefix shingle: (key, p, x, ix, nx), (key, p, y, iy, ny, cut)."""
    x = forms.select(F.col("d").alias("x"), F.col("n").alias("nx"), "prefix", F.explode("short").alias("key")).distinct()
    y = forms.select(F.col("d").alias("y"), F.col("n").alias("ny"), "prefix", F.explode("long").alias("k")).groupBy("y", "ny", "prefix", F.col("k.key").alias("key")).agg(F.max("k.cut").alias("cut"))
    keys = x.select("key", F.col("x").alias("d"), F.lit(True).alias("short")).unionByName(y.select("key", F.col("y").alias("d"), F.lit(False).alias("short")))
    both = keys.groupBy("key").agg(F.max("short").alias("a"), F.min("short").alias("b"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    live = counted(both.filter("a AND NOT b AND lo <> hi").select("key"))
    x = x.join(live, "key", "left_semi").select("key", "x", "nx", F.posexplode("prefix").alias("ix", "p"))
    y = y.join(live, "key", "left_semi").select("key", "y", "ny", "cut", F.posexplode("prefix").alias("iy", "p"))
    return durable(x), durable(y)


def aligned_end(short: str, long: str) -> str | None:
    """Where a text stops in one that goes on: cut | whole | None if they aren't near-copies there."""
    a, b = short.split(), long.split()
    if len(a) < SHINGLE + 2:
        return None
    sa, sb = ({tuple(x[i : i + SHINGLE]) for i in range(len(x) - SHINGLE + 1)} for x in (a, b))
    same = len(sa & sb)
    if same < SIMILARITY * (len(sa) + len(sb) - same):
        return None
    anchor = a[-SHINGLE - 1 : -1]
    spots = [i + SHINGLE for i in range(len(b) - SHINGLE) if b[i : i + SHINGLE] == anchor]
    tail = tail_begin([tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)]) + SHINGLE if spots else 0
    spots = [i for i in spots if i >= tail]
    if not spots:
        return None
    at = min(spots, key=lambda i: abs(i - (len(a) - 1)))
    mine, theirs = a[-1], b[at]
    if mine == theirs:
        return None if at == len(b) - 1 else "cut" if goes_on_within(b, at) else "whole"
    stem = mine.rstrip(CLOSERS + SENTENCE_MARKS + STEM_END)
    return "cut" if stem and theirs.startswith(stem) and len(theirs) > len(stem) and theirs[len(stem)].isalnum() else None


def in_tail(new, distinct):
    """Whether a copy of a text that ends at a place can have so many of its distinct shingles only behind it: one may be the shorter text's last."""
    return new - 1 <= distinct - SIMILARITY * distinct + 1e-9


def tail_begin(shingles: list) -> int:
    """The first place of a text at which a near-copy can end while the text goes on with what the copy doesn't have."""
    distinct, seen = len(set(shingles)), set()
    for i, x in enumerate(shingles):
        seen.add(x)
        if in_tail(distinct - len(seen), distinct):
            return i
    return len(shingles)


def goes_on_within(words: list[str], at: int) -> bool:
    """Whether the sentence goes on behind word ``at``."""
    ends = words[at].rstrip(CLOSERS)[-1:] in tuple(SENTENCE_MARKS)
    head = words[at + 1].lstrip("\"'“(*[")[:1]
    return not ends or head.islower() or head.isdigit()


def aligned_ends(texts: DataFrame, d: str, text: str) -> DataFrame:
    """(d, aligned): cut if any near-copy shows the text goes on, whole if those that go on do so only with new sentences."""

    @F.arrow_udf("string")
    def align(short: pa.Array, long: pa.Array) -> pa.Array:
        return pa.array([aligned_end(x, y) for x, y in zip(short.to_pylist(), long.to_pylist())], pa.string())

    source = texts.select(F.col(d).alias("d"), F.col(text).alias("text"))
    spots = durable(ends_met(source))
    few = durable(texts_of(source, spots.select("d")).join(spots.hint("merge"), "d"))
    xs, ys = partners(durable(forms_of(few)))

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (few.select(F.col("d").alias(c), F.col("text").alias(f"t{c}")) for c in "xy")
        found = pairs.join(a.hint("merge"), "x").join(b.hint("merge"), "y").select("x", align("tx", "ty").alias("aligned")).filter("aligned IS NOT NULL")
        return found.groupBy("x").agg(F.min("aligned").alias("aligned"))

    cut = lambda f: f(F.when(F.col("cut"), F.col("y")))
    three = F.array_distinct(F.array_compact(F.array(cut(F.min), cut(F.max), F.min(F.when(~F.col("cut"), F.col("y"))))))
    groups = durable(ys.groupBy("key", "p").agg(three.alias("ys"), F.count("*").alias("n")))
    first = durable(xs.select("key", "p", "x").join(groups.hint("merge"), ["key", "p"]).select("x", F.explode("ys").alias("y")).filter("x <> y").distinct())
    found = durable(verified(first))
    more = groups.filter(F.col("n") > F.size("ys")).select("key", "p")
    if not more.isEmpty():
        left = xs.join(found.hint("merge"), "x", "left").filter("aligned IS NULL OR aligned <> 'cut'").join(more.hint("merge"), ["key", "p"], "left_semi")
        share = F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.col("nx") + F.col("ny")) - 1e-6  # shingles that such a pair has in common at least
        fits = (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= share) & (F.col("x") != F.col("y")) & (F.col("cut") | F.col("aligned").isNull())
        rest = left.join(ys.hint("merge"), ["key", "p"]).filter(fits).select("x", "y").distinct().join(first.hint("merge"), ["x", "y"], "left_anti")
        found = found.unionByName(verified(durable(rest))).groupBy("x").agg(F.min("aligned").alias("aligned"))
    return found.select(F.col("x").alias(d), "aligned")


# ---- verdict -----------------------------------------------------------------------------------

ENDING = StructType([StructField("state", StringType()), StructField("word", StringType())])


@F.arrow_udf(ENDING)
def _ending_udf(text: pa.Array, topic: pa.Array) -> pa.Array:
    found = [ending(t, k) for t, k in zip(text.to_pylist(), topic.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([s for s, _ in found], pa.string()), pa.array([w for _, w in found], pa.string())], ["state", "word"])


def closings(df: DataFrame, key: str, text: str, topic: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """(key, extra..., text in canonical form, state, word, digest): how each record's text closes; one row per key."""
    extra = extra or []
    t = F.col(topic) if topic else F.lit(None).cast("string")
    d = df.select(F.col(key).alias("key"), F.col(text).alias("raw"), t.alias("topic"), *extra).dropDuplicates(["key"])
    d = closings_of(d.withColumn("text", screen_key_text(F.col("raw"))).drop("raw"), "text", "topic")
    return d.select(F.col("key").alias(key), *extra, "text", "state", "word", "digest")


def closings_of(d: DataFrame, text: str, topic: str) -> DataFrame:
    """d with state, word and digest: how its text, already in canonical form, closes."""
    d = d.withColumn("__end", _ending_udf(text, topic))
    return d.withColumn("state", F.col("__end.state")).withColumn("word", F.col("__end.word")).withColumn("digest", text_digest(F.col(text))).drop("__end")


def judge(closed: DataFrame, key: str) -> DataFrame:
    """(key, state, terminality, aligned, decider, unfinished) from ``closings``.

    ``decider`` is what the verdict rests on: alignment, closing word, closing
    mark (or its want), closing line, or empty. A line that closes a text
    without a mark stays closed even if a copy has more of them. ``closed`` is
    read several times; pass a durable table.
    """
    filled = closed.filter("state <> 'empty'")
    d = closed.select(key, "state", "word", "digest").join(terminality(filled, "text").hint("merge"), "word", "left")
    d = d.withColumn("terminality", F.when(F.col("word").isNotNull(), closing_score(F.col("word"), F.col("e"), F.col("g"))))
    d = d.join(aligned_ends(filled, "digest", "text").hint("merge"), "digest", "left")
    cut = (F.col("aligned") == "cut") & F.col("state").isin("cut", "marked")
    open_word = (F.col("state") == "marked") & (F.coalesce("terminality", F.lit(1.0)) < TERMINAL)
    verdict = F.when(F.col("state") == "empty", False).otherwise(F.coalesce(cut, F.lit(False)) | (F.col("state") == "cut") | open_word)
    decider = (
        F.when(F.col("state") == "empty", "empty").when(cut, "alignment").when(F.col("state") == "closed", "closing line")
        .when((F.col("state") == "marked") & F.col("word").isNotNull(), "closing word").otherwise("closing mark")
    )
    return d.select(key, "state", F.round("terminality", 4).alias("terminality"), "aligned", decider.alias("decider"), verdict.alias("unfinished"))
