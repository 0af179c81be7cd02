"""One spelling for texts that look alike (problem 4).

Arrow text is copied to numpy code-point arrays once per batch; every step is a
table gather, an offset computation or a segment operation over those arrays.
There is no per-row string call.

Two levels share the machinery:

* ``canonical_text`` gives the readable canonical form: full-width, half-width
  and styled letters become plain, compatibility ligatures are spelt out, marks
  are decomposed, put in canonical order and composed again, invisible
  characters vanish, every kind of space becomes one space, line ends become
  ``\\n``, and letters of a foreign script that look like Latin ones are
  replaced where they stand in a word with Latin letters.
* ``screen_key_text`` additionally replaces look-alike letters everywhere, so a
  whole word written in look-alike letters compares equal too. It is meant for
  comparison, not for reading.

Defined results: null stays null; empty stays empty; a text of only invisible
characters or spaces becomes empty. Case, visible accents, punctuation and line
breaks are kept apart. Runs of spaces count as one space and spaces at the end
of a line are dropped, since neither can be seen reliably.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v", "ɡ": "g",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "υ": "u",
    "γ": "y", "κ": "k", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J", "η": "n", "τ": "t", "χ": "x", "ω": "w",
    # Armenian, Cherokee, Latin extras
    "օ": "o", "Օ": "O", "ո": "n", "ս": "u", "հ": "h", "Տ": "S", "Լ": "L", "ց": "g", "զ": "q", "յ": "j",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P",
    "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "ı": "i", "ɑ": "a", "ⅼ": "l", "Ⅰ": "I",
}

# Code-point ranges that draw nothing.
INVISIBLE = [
    (0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C),
    (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE0FFF),
]
# Ranges whose compatibility decomposition is only another spelling of the same
# drawn letters: digraph and presentation ligatures, Roman numerals.
SPELT_OUT = [(0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xFB00, 0xFB4F)]
NEWLINES = [0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029]
TOP = sys.maxunicode + 1
SHIFT = 21


def _inside(cp: int, ranges: list[tuple[int, int]]) -> bool:
    return any(a <= cp <= b for a, b in ranges)


class Tables:
    """Lookup tables over all code points, built by rule from the Unicode data."""

    def __init__(self) -> None:
        self.one = np.arange(TOP, dtype=np.uint32)
        self.size = np.ones(TOP, dtype=np.uint8)
        self.start = np.zeros(TOP, dtype=np.int64)
        self.ccc = np.zeros(TOP, dtype=np.uint8)
        flat: list[int] = []
        pairs: dict[int, int] = {}
        for cp in [*range(0x80, 0x33480), *range(0xE0000, 0xE0FFF + 1)]:
            if 0xD800 <= cp <= 0xDFFF:
                continue
            c = chr(cp)
            if k := unicodedata.combining(c):
                self.ccc[cp] = k
            if (to := self._fold(cp, c)) != c:
                if len(to) == 1:
                    self.one[cp] = ord(to)
                else:
                    self.size[cp], self.start[cp] = len(to), len(flat)
                    flat += map(ord, to)
            if 0xAC00 <= cp <= 0xD7A3:
                k = (cp - 0xAC00) % 28
                first = cp - k if k else 0x1100 + (cp - 0xAC00) // 588
                second = 0x11A7 + k if k else 0x1161 + (cp - 0xAC00) % 588 // 28
                pairs[first << SHIFT | second] = cp
            elif (d := unicodedata.decomposition(c)) and d[0] != "<" and " " in d:
                first, second = (int(x, 16) for x in d.split())
                if unicodedata.normalize("NFC", chr(first) + chr(second)) == c:
                    pairs[first << SHIFT | second] = cp
        for cp in [*range(0, 0x09), *range(0x0E, 0x20), 0x7F]:
            self.size[cp] = 0
        for cp in NEWLINES:
            self.one[cp], self.size[cp] = 0x0A, 1
        self.one[0x09] = 0x20
        self.flat = np.array(flat or [0], dtype=np.uint32)
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_key, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], dtype=np.uint32)
        self.follows = np.zeros(TOP, dtype=bool)  # unmarked letters that join the one before
        seconds = (keys & ((1 << SHIFT) - 1)).astype(np.int64)
        self.follows[seconds[self.ccc[seconds] == 0]] = True
        self.alike = np.arange(TOP, dtype=np.uint32)
        for a, b in LOOKALIKES.items():
            self.alike[ord(a)] = ord(b)
        self.is_alike = self.alike != np.arange(TOP, dtype=np.uint32)
        self.latin = np.zeros(TOP, dtype=bool)
        self.letter = np.zeros(TOP, dtype=bool)
        for cp in range(0x2FFF):
            c = chr(cp)
            if unicodedata.category(c)[0] in "LM":
                self.letter[cp] = True
                self.latin[cp] = "LATIN" in unicodedata.name(c, "")
        self.latin &= ~self.is_alike

    @staticmethod
    def _fold(cp: int, c: str) -> str:
        if _inside(cp, INVISIBLE):
            return ""
        if unicodedata.category(c) in ("Zs",):
            return " "
        d = unicodedata.decomposition(c)
        tag = d[1 : d.index(">")] if d[:1] == "<" else ""
        if tag in ("wide", "narrow", "font") or tag == "compat" and _inside(cp, SPELT_OUT):
            return unicodedata.normalize("NFD", unicodedata.normalize("NFKD", c))
        return unicodedata.normalize("NFD", c)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


class Batch:
    """The code points of a batch of texts, with the row of each."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
        self.n = len(texts)
        self.valid = np.ones(self.n, dtype=bool) if not texts.null_count else texts.is_valid().to_numpy(zero_copy_only=False)
        _, offsets, data = texts.buffers()
        if not self.n or data is None:
            self.cps, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(self.n, dtype=np.int64)
            return
        offs = np.frombuffer(offsets, dtype=np.int32, count=self.n + 1 + texts.offset)[texts.offset :].astype(np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
        seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.counts = np.diff(seen[offs - offs[0]])
        self.cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def keep(self, mask: np.ndarray) -> None:
        rows = self.rows()[mask]
        self.cps, self.counts = self.cps[mask], np.bincount(rows, minlength=self.n)

    def to_arrow(self) -> pa.Array:
        cps = self.cps
        data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
        width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(self.counts)])]
        mask = pa.py_buffer(np.packbits(self.valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.string(), self.n, [mask, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def _expand(b: Batch, t: Tables) -> None:
    """Fold every code point through the tables; rows grow and shrink by offsets."""
    cps = b.cps
    size = t.size[cps].astype(np.int64)
    joiner = (cps == 0x200D) | (cps == 0x200C)
    if joiner.any():  # joiners inside pictographs and Arabic or Indic words are seen
        before, after = np.concatenate([[0], cps[:-1]]), np.concatenate([cps[1:], [0]])
        drawn = lambda x: (x >= 0x2600) & (x <= 0x27BF) | (x >= 0x1F000) & (x < 0xE0000) | (x == 0xFE0F)
        shaped = lambda x: (x >= 0x600) & (x < 0x1100)
        seen = joiner & (drawn(before) & drawn(after) | shaped(before) & shaped(after))
        size[seen] = 1
    crlf = (cps == 0x0A) & (np.concatenate([[0], cps[:-1]]) == 0x0D)
    if len(cps) and crlf.any():
        starts = np.concatenate([[0], np.cumsum(b.counts)])[:-1]
        at_start = np.zeros(len(cps), dtype=bool)
        at_start[starts[b.counts > 0]] = True
        size[crlf & ~at_start] = 0
    rows = np.repeat(b.rows(), size)
    out = np.repeat(t.one[cps], size)
    if len(many := np.flatnonzero(size > 1)):
        ends = np.cumsum(size)
        length = size[many]
        inner = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(ends[many] - length, length) + inner] = t.flat[np.repeat(t.start[cps[many]], length) + inner]
    b.cps, b.counts = out, np.bincount(rows, minlength=b.n)


def _pair(t: Tables, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composed code point of each pair, or 0."""
    key = first.astype(np.int64) << SHIFT | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t.pair_key, key), len(t.pair_key) - 1)
    return np.where(t.pair_key[at] == key, t.pair_to[at], 0).astype(np.uint32)


def _compose(b: Batch, t: Tables) -> None:
    """Canonical order of marks, then composition by rank of mark, all rows at once."""
    cps = b.cps.copy()
    ccc = t.ccc[cps]
    if ccc.any():
        first = np.zeros(len(cps), dtype=bool)
        starts = np.concatenate([[0], np.cumsum(b.counts)])[:-1]
        first[starts[b.counts > 0]] = True
        segment = np.cumsum((ccc == 0) | first) - 1
        head = np.flatnonzero((ccc == 0) | first)
        marks = np.flatnonzero((ccc > 0) & ~first)
        order = np.lexsort((marks, ccc[marks], segment[marks]))
        cps[marks] = cps[marks[order]]
        ccc = t.ccc[cps]
        of = segment[marks]
        rank = np.arange(len(marks)) - np.searchsorted(of, of)
        gone = np.zeros(len(cps), dtype=bool)
        last = np.zeros(len(head), dtype=np.uint8)
        by_rank = np.argsort(rank, kind="stable")
        bounds = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2)) if len(marks) else []
        for k in range(len(bounds) - 1):
            m = marks[by_rank[bounds[k] : bounds[k + 1]]]
            s = segment[m]
            to = _pair(t, cps[head[s]], cps[m])
            ok = (to > 0) & (last[s] < ccc[m]) & (ccc[head[s]] == 0)
            cps[head[s[ok]]], gone[m[ok]] = to[ok], True
            last[s[~ok]] = ccc[m[~ok]]
        b.cps = cps
        b.keep(~gone)
        cps = b.cps.copy()
    for _ in range(2):  # a vowel joins its consonant, then a final consonant both
        follows = t.follows[cps]
        if not follows.any():
            break
        first = np.zeros(len(cps), dtype=bool)
        starts = np.concatenate([[0], np.cumsum(b.counts)])[:-1]
        first[starts[b.counts > 0]] = True
        at = np.flatnonzero(follows & ~first)
        to = _pair(t, cps[at - 1], cps[at])
        at, to = at[to > 0], to[to > 0]
        if not len(at):
            break
        alone = np.concatenate([[True], np.diff(at) > 1])
        at, to = at[alone], to[alone]
        cps[at - 1] = to
        mask = np.ones(len(cps), dtype=bool)
        mask[at] = False
        b.cps = cps
        b.keep(mask)
        cps = b.cps.copy()


def _letters(b: Batch, t: Tables, everywhere: bool) -> None:
    """Replace look-alike letters; unless everywhere, only in words that hold Latin letters too."""
    cps = b.cps
    alike = t.is_alike[cps]
    if not alike.any():
        return
    if not everywhere:
        letter = t.letter[cps] | t.is_alike[cps]
        word = np.cumsum(np.concatenate([[True], (letter[1:] != letter[:-1]) | (np.diff(b.rows()) > 0)])) - 1
        mixed = np.bincount(word, weights=t.latin[cps]) > 0
        alike &= mixed[word]
    out = cps.copy()
    out[alike] = t.alike[cps[alike]]
    b.cps = out


def _spaces(b: Batch) -> None:
    """One space for a run; none at the ends of lines and texts."""
    cps = b.cps
    if not len(cps):
        return
    rows = b.rows()
    space = cps == 0x20
    edge = space | (cps == 0x0A)
    new = np.concatenate([[True], rows[1:] != rows[:-1]])
    last = np.concatenate([new[1:], [True]])
    after_edge = np.concatenate([[True], edge[:-1]]) | new
    before_break = np.concatenate([cps[1:] == 0x0A, [True]]) | last
    drop = space & after_edge
    # a run that meets a line end or the text's end goes as a whole
    run = np.cumsum(np.concatenate([[True], (space[1:] != space[:-1]) | new[1:]])) - 1
    ends = np.zeros(run[-1] + 1, dtype=bool)
    ends[run[space & before_break]] = True
    b.keep(~(drop | space & ends[run]))
    # leading and trailing line breaks aren't seen either
    cps, rows = b.cps, b.rows()
    if not len(cps):
        return
    solid = np.flatnonzero(cps != 0x0A)
    lo, hi = np.full(b.n, len(cps)), np.full(b.n, -1)
    lo[rows[solid[::-1]]] = solid[::-1]
    hi[rows[solid]] = solid
    at = np.arange(len(cps))
    b.keep((at >= lo[rows]) & (at <= hi[rows]))


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> list[tuple[int, int]]:
    """Row ranges of at most most_bytes of text (or one row), so that array work needs bounded memory."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(texts):
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + most_bytes, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


# Texts without any of these are in canonical form already.
UNTIDY = r"[^\x20-\x7e\n]|  | \n|\n |^[ \n]|[ \n]$"


def canonicalize(texts: pa.Array, everywhere: bool) -> pa.Array:
    """Canonical form of a batch; everywhere: look-alike letters in every word."""
    texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    untidy = pc.fill_null(pc.match_substring_regex(texts, UNTIDY), False)
    if pc.sum(untidy).as_py():
        some = texts.filter(untidy)
        return pc.replace_with_mask(texts, untidy, pa.concat_arrays([_canonicalize(some.slice(lo, hi - lo), everywhere) for lo, hi in slices(some)]))
    return texts


def _canonicalize(texts: pa.Array, everywhere: bool) -> pa.Array:
    t, b = tables(), Batch(texts)
    if len(b.cps) and int(b.cps.max()) > 0x7E or len(b.cps) and int(b.cps.min()) < 0x20:
        _expand(b, t)
        if everywhere or len(b.cps) and int(b.cps.max()) > 0x2FF:
            _letters(b, t, everywhere)
        _compose(b, t)
    _spaces(b)
    return b.to_arrow()


@F.arrow_udf(StringType())
def _canonical_udf(texts: pa.Array) -> pa.Array:
    return canonicalize(texts, False)


@F.arrow_udf(StringType())
def _screen_udf(texts: pa.Array) -> pa.Array:
    return canonicalize(texts, True)


def canonical_text(text: Column) -> Column:
    """Readable canonical form of a text column."""
    return _canonical_udf(text)


def screen_key_text(text: Column) -> Column:
    """Comparison form: equal for texts that read the same on screen."""
    return _screen_udf(text)


def digest(*cols: Column) -> Column:
    """A 128-bit digest of the columns as two longs."""
    return F.struct(F.xxhash64(F.lit(11), *cols).alias("a"), F.xxhash64(F.lit(29), *cols).alias("b"))


def screen_classes(df: DataFrame, key: str, text: str, by: list[str] | None = None) -> DataFrame:
    """(by..., key, screen_id, spelling_id) of every record with visible text.

    Records with equal screen_id read the same; with equal spelling_id they are
    spelt the same. Only digests leave the map stage, never texts. A key that
    is delivered again counts once; null and invisible texts are left out.
    """
    by = by or []
    d = df.select(*by, key, F.col(text).alias("__t")).filter(F.col("__t").isNotNull())
    d = d.withColumn("__c", screen_key_text(F.col("__t"))).filter(F.col("__c") != "")
    return d.select(*by, key, digest(F.col("__c")).alias("screen_id"), F.xxhash64(F.col("__t")).alias("spelling_id")).distinct()


def lookalike_pairs(classes: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Pairs (by..., key_a, key_b) that read the same but are spelt differently.

    Classes with a single spelling are dropped by an aggregate with map-side
    combine before the join, so groups of exact copies never meet themselves.
    """
    several = (
        classes.groupBy(*by, "screen_id")
        .agg(F.min("spelling_id").alias("__lo"), F.max("spelling_id").alias("__hi"))
        .filter("__lo <> __hi")
        .select(*by, "screen_id")
    )
    d = classes.join(several.hint("merge"), [*by, "screen_id"], "left_semi")
    a = d.select(*by, "screen_id", F.col(key).alias("key_a"), F.col("spelling_id").alias("__sa"))
    b = d.select(*by, "screen_id", F.col(key).alias("key_b"), F.col("spelling_id").alias("__sb"))
    return a.join(b.hint("merge"), [*by, "screen_id"]).filter("key_a < key_b AND __sa <> __sb").select(*by, "key_a", "key_b").distinct()


def lookalike_classes(classes: DataFrame, key: str, by: list[str]) -> DataFrame:
    """(by..., key, class_id, spellings): per record the least key that reads the same, and the number of spellings of the class.

    The form of the pairs for groups of any size: a row per record.
    """
    spelt = classes.groupBy(*by, "screen_id", "spelling_id").agg(F.min(key).alias("__least"))
    found = spelt.groupBy(*by, "screen_id").agg(F.min("__least").alias("class_id"), F.count("*").alias("spellings"))
    return classes.select(*by, key, "screen_id").distinct().join(found.hint("merge"), [*by, "screen_id"]).select(*by, key, "class_id", "spellings")
