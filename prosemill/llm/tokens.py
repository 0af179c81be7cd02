"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

The merges are compiled, one after another, into a deterministic tokenization
automaton. A state stands for what may follow the token just read. The gadget
of a merge ``u v -> w`` takes the arc ``v`` out of the state behind ``u`` and
adds a state behind ``w``: ``w`` may be read wherever ``u`` could at that time,
and behind it goes on what could go on behind ``v`` at that time. Later merges
edit the new state without touching the old ones, so a state is kept as (state
copied, time of the copy) plus its own cut arcs; 50,000 explicit states with up
to 50,000 arcs each would not fit, this takes a few MB. An arc exists iff the
walk through the copies meets no cut that was older than the copy.

Over bytes the automaton is determinised as words come: a state per word
prefix, a transition table (state, byte) -> state, and on each state the arc
label (the last token of that prefix) with the state where that token began.
Encoding a word is a run over the table; its ids are the labels met on the way
back, and decoding concatenates the labels' bytes. Only distinct words of a
batch are run; everything per occurrence is an Arrow dictionary gather.

Null and empty texts give an empty list of ids.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

DEFAULT_TOKENIZERS = os.environ.get("PROSEMILL_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"

# Fixed value: the vocabulary's published word-splitting pattern. (?U) gives \s
# its Unicode meaning in Java.
SPLIT = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_STATES = 2_000_000  # states, arcs and word ids that a worker remembers


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TokenAutomaton:
    """Deterministic automaton over tokens, built by one gadget per merge."""

    def __init__(self, letters: list[bytes]) -> None:
        self.label = list(letters)  # bytes of each token's arc
        self.born = [0] * len(letters)  # time of the gadget that made it
        self.parts: list[tuple[int, int]] = [(-1, -1)] * len(letters)
        self.cut: dict[tuple[int, int], int] = {}  # arc out of a state -> time it was cut
        self.time = 0

    def add_merge(self, u: int, v: int, token: int | None = None) -> int:
        """Apply the gadget of u v -> w; gives w."""
        self.time += 1
        self.cut.setdefault((u, v), self.time)
        if token is not None and token < len(self.label):  # another way to a token that exists
            return token
        self.label.append(self.label[u] + self.label[v])
        self.born.append(self.time)
        self.parts.append((u, v))
        return len(self.label) - 1

    def has_arc(self, left: int, right: int) -> bool:
        """Whether the state behind ``left`` has the arc ``right``."""
        cut, born, parts = self.cut, self.born, self.parts
        before = self.time + 1  # cuts before this time count
        while True:
            if cut.get((left, right), before) < before:
                return False
            a, b = born[left], born[right]
            if a > b:  # the state behind left was copied from the one behind its second half
                before, left = a, parts[left][1]
            elif b:  # right stands where its first half stood; at the same time the left merge goes first
                before, right = (b + 1 if b > a else a), parts[right][0]
                if a == b:
                    before, left = a, parts[left][1]
            else:
                return True


class WordRunner:
    """Byte-level transition table over the automaton, grown by the words it meets."""

    def __init__(self, automaton: TokenAutomaton, ids: list[int]) -> None:
        self.automaton, self.ids = automaton, ids
        self.token_of: dict[bytes, int] = {}
        for token, word in enumerate(automaton.label):
            self.token_of.setdefault(word, token)
        self.longest = max(map(len, self.token_of))
        self.reset()

    def reset(self) -> None:
        self.next: dict[int, int] = {}  # state << 8 | byte -> state
        self.emits: list[int] = [-1]
        self.back: list[int] = [0]
        self.done: dict[str, list[int]] = {}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.held = 0

    def full(self) -> bool:
        """Whether the table has grown to its bound: states, arcs looked up, words and their ids together."""
        return len(self.emits) + len(self.arcs) + self.held > MAX_STATES

    def _grow(self, state: int, path: list[int], word: bytes, end: int) -> int:
        """The state of word[:end], whose shorter prefixes are the states in path."""
        emits, arcs = self.emits, self.arcs
        for begin in range(max(0, end - self.longest), end):
            token = self.token_of.get(word[begin:end])
            if token is None:
                continue
            if begin:
                pair = emits[path[begin]], token
                ok = arcs.get(pair)
                if ok is None:
                    ok = arcs[pair] = self.automaton.has_arc(*pair)
                if not ok:
                    continue
            new = len(emits)
            emits.append(token)
            self.back.append(path[begin])
            self.next[state << 8 | word[end - 1]] = new
            return new
        raise ValueError("a byte has no token")

    def encode(self, text: str) -> list[int]:
        if (found := self.done.get(text)) is not None:
            return found
        if self.full():  # also in the middle of a batch; what is forgotten is worked out again
            self.reset()
        word = text.encode("utf-8", "surrogatepass")
        state, path, step = 0, [0], self.next
        for at, byte in enumerate(word):
            to = step.get(state << 8 | byte)
            state = self._grow(state, path, word, at + 1) if to is None else to
            path.append(state)
        out = []
        while state:
            out.append(self.ids[self.emits[state]])
            state = self.back[state]
        out.reverse()
        self.done[text] = out
        self.held += 1 + len(out)
        return out


@lru_cache(maxsize=2)
def runner(path: str) -> WordRunner:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    letters = byte_letters()
    automaton = TokenAutomaton([bytes([b]) for b in range(256)])
    token = {letters[b]: b for b in range(256)}
    ids = [vocab[x] for x in letters]
    for merge in model["merges"]:
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        w = automaton.add_merge(token[u], token[v], token.get(u + v))
        if u + v not in token:
            token[u + v] = w
            ids.append(vocab[u + v])
    return WordRunner(automaton, ids)


def encode_words(words: pa.Array, path: str) -> pa.Array:
    """list<string> of pre-split words -> list<int32> of ids."""
    run = runner(path)
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = words.flatten()
    coded = flat.dictionary_encode()
    each = [run.encode(x) for x in coded.dictionary.to_pylist()]
    length = np.fromiter(map(len, each), np.int64, len(each))
    ids = np.fromiter((i for x in each for i in x), np.int32, int(length.sum()))
    index = coded.indices.to_numpy(zero_copy_only=False)
    begin, n = (np.cumsum(length) - length)[index], length[index]
    total = int(n.sum())
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(total)
    per_row = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), pa.array(ids[at] if total else ids[:0]))


def decode_ids(ids: list[int], path: str) -> str:
    """The text of a list of ids, by emitting the arcs' labels."""
    run = runner(path)
    label = {i: run.automaton.label[t] for t, i in enumerate(run.ids)}
    return b"".join(label[i] for i in ids).decode("utf-8", "replace")


def vocabulary_path(tokenizers: str | None = None, name: str = BYTE_BPE) -> str:
    return os.path.join(tokenizers or DEFAULT_TOKENIZERS, name)


def token_ids(text: Column, tokenizers: str | None = None) -> Column:
    """ids (array<int>) of a text column by the byte-level vocabulary.

    Words are split by a regular expression in the JVM and encoded in Arrow
    batches; null and empty texts give an empty list.
    """
    path = vocabulary_path(tokenizers)

    @F.arrow_udf(ArrayType(IntegerType()))
    def encode(words: pa.Array) -> pa.Array:
        return encode_words(words, path)

    return encode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0)))


def token_counts(text: Column, tokenizers: str | None = None) -> Column:
    """Number of tokens of a text column; 0 for null and empty texts."""
    path = vocabulary_path(tokenizers)

    @F.arrow_udf(IntegerType())
    def count(words: pa.Array) -> pa.Array:
        return encode_words(words, path).value_lengths()

    return count(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPLIT), F.lit(0)))


def encode_corpus(df: DataFrame, key: str, text: str, tokenizers: str | None = None) -> DataFrame:
    """(key, ids) of every record. No shuffle: one scan, one Python stage."""
    return df.select(key, token_ids(F.col(text), tokenizers).alias("ids"))
