"""Abusive, hateful or sexual content (problem 8).

A factorization machine scores sentences over hashed terms: words, pairs of
neighbouring words and classes of words (insults, groups of people, second
person, sexual terms, violence). Its pairwise part learns what additive
weights miss: an insult is harmless next to "the word ... once named" and not
next to "you"; a group is harmless unless it meets "vermin". A document's score
is that of its worst sentence.

Labels are per document and a few are wrong, so training alternates: the
sentences that the present machine finds worst stand for a positive document,
every sentence of a negative one is negative; documents that the fitted machine
contradicts strongly are set aside. Nothing but the labels teaches it: there
are no written examples. The labelled sample is bounded (``most_positive`` and
``most_negative`` documents, drawn by hash, and ``most_sentences`` of the plain
sentences of negative documents, weighted for those left out); all documents
are scored over their whole text.

Texts are folded to canonical form, lower case and base letters in whole
batches of code points; words are hashed by segment sums. Disguised spellings
(digits and signs for letters, stretched letters, letters set apart, letters
masked by stars) are found by array tests; only those tokens are spelt out one
by one, and their plain readings become further terms of their sentence.

Defined results: null, empty and wordless texts score 0 and are not flagged;
equal texts get equal scores; repeated rows are scored each; without any
labelled document only texts with several listed words can be flagged.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.canonical import Batch, canonicalize, slices

DIM, FACTORS = 1 << 17, 6
MOST_POSITIVE, MOST_NEGATIVE, MOST_SENTENCES = 4000, 8000, 24000  # bounds of the training sample
LEAST_CUT, USUAL_CUT, MOST_CUT = 0.03, 0.1, 0.3  # range of the threshold that training finds

# Word classes of general dictionaries, in base letters. They are features, and the labels decide what they weigh.
CLASSES = {
    "insult": """idiot idiots moron morons imbecile imbeciles cretin cretins jackass dimwit bastard bastards bitch whore slut scum asshole assholes prick
        dumbass loser coward pig swine filth parasite parasites vermin trash garbage subhuman worthless pathetic stupid disgusting retard goddamn wanker twat cunt
        idioten vollidiot schwachkopf arschloch arschlocher hurensohn schlampe miststuck abschaum dreck ungeziefer untermenschen wichser
        connard connards salope salaud batard ordure ordures abruti debile pute merde vermine
        cabron cabrones mierda imbecil gilipollas puta zorra escoria basura maldito idiota idiotas cerdo cerdos""",
    "sexual": """cock pussy tits ass dick nude nudes naked sex sexual fuck fucked fucking cum orgasm porn nipples horny erotic blowjob
        fickte ficken gefickt nackt schwanz titten muschi bite chatte baise baiser nue seins queue desnudo desnuda follar polla tetas cono""",
    "violence": """kill killed die beat beaten kick hit punch stab burn burned choke hang shoot smash rot
        schlagen verrecken umbringen totschlagen crever casser tuer frapper matar golpear ahorcar""",
    "people": """women men foreigners immigrants refugees migrants muslims jews christians blacks whites gays natives gypsies
        auslander fluchtlinge frauen manner zuwanderer etrangers immigres refugies femmes hommes extranjeros inmigrantes refugiados mujeres hombres""",
    "you": "you your yours u du dich dir dein deine deinen deinem ihr euch euer tu te toi ton ta tes vous votre vos tus ti usted ustedes eres vosotros",
}
# Plain readings of signs that stand for letters.
SIGNS = {"@": "a", "4": "a", "€": "e", "3": "e", "!": "i", "1": "il", "|": "il", "0": "o", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g", "6": "g", "2": "z"}

@lru_cache(maxsize=1)
def fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """(code point -> lower-case base letter, code point -> kind: 0 space, 1 letter, 2 digit, 3 sign for a letter, 4 sentence mark, 5 other)."""
    size = 0x20000
    fold = np.arange(size, dtype=np.uint32)
    kind = np.full(size, 5, dtype=np.uint8)
    for cp in [*range(0x250), *range(0x370, 0x590), *range(0x1E00, 0x2000)]:
        c = chr(cp)
        low = c.lower()
        base = unicodedata.normalize("NFD", low)
        fold[cp] = ord(base[0]) if base else cp
        kind[cp] = 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 5
    for cp in range(0x590, size):
        if not 0xD800 <= cp <= 0xDFFF and kind[cp] == 5:
            c = chr(cp)
            kind[cp] = 0 if c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 5
    fold[ord("ø")] = fold[ord("Ø")] = ord("o")
    for c in "@€!|$+*":
        kind[ord(c)] = 3
    for c in ".?…。！？\n":
        kind[ord(c)] = 4
    return fold, kind


POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(512)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_word(word: str) -> np.uint64:
    """The hash that the array path gives a word of base letters."""
    with np.errstate(over="ignore"):
        cps = np.array([ord(c) for c in word], dtype=np.uint64)
        return mix(np.array([(cps * POWERS[np.arange(len(cps)) % 512]).sum(dtype=np.uint64)]))[0]


@lru_cache(maxsize=1)
def class_table() -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of listed words, class number of each)."""
    found = sorted((int(hash_word(w)), i) for i, ws in enumerate(CLASSES.values()) for w in set(ws.split()))
    return np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found])


@lru_cache(maxsize=1)
def listed_words() -> dict[int, set[str]]:
    """The listed words by length."""
    found: dict[int, set[str]] = {}
    for ws in CLASSES.values():
        for w in ws.split():
            found.setdefault(len(w), set()).add(w)
    return found


CLASS_HASH = [np.uint64(0x1234567 + 7919 * i) for i in range(len(CLASSES))]
PRIOR = {"insult": 3.0, "sexual": 2.0}  # where training starts from: such words are a sign until the labels say otherwise
MASKED_HASH, DISGUISED_HASH = np.uint64(0xABCDEF01), np.uint64(0xABCDEF77)


def readings(token: str) -> tuple[list[str], bool]:
    """(plain readings of a token that may be disguised, whether letters are masked)."""
    t = token.strip(".,;:?\"'()[]{}«»“”’…-_")
    t = t[:-1] if t.endswith("!") and t[:-1].isalpha() else t
    if re.search(r"[a-z]\*{2,}[a-z]", t):
        return [], True
    t = t.replace("*", "")
    out: set[str] = set()
    parts = re.split(r"[._\-*~ ]", t)
    if len(parts) >= 3 and all(len(p) <= 1 for p in parts):
        t = "".join(parts)
        out.add(t)
    letters = sum(c.isalpha() for c in t)
    if letters and any(c in SIGNS for c in t):
        spots = [SIGNS.get(c, c) for c in t]
        if sum(len(x) > 1 for x in spots) <= 3:
            out |= {"".join(x) for x in itertools.product(*spots)}
        else:  # too many to spell out: the two plainest, and the listed words among all of them
            out |= {"".join(x[0] for x in spots), "".join(x[-1] for x in spots)}
            out |= {w for w in listed_words().get(len(t), ()) if all(c in x for c, x in zip(w, spots))}
    for x in [*out, t]:
        if re.search(r"([a-z])\1\1", x):
            out |= {re.sub(r"([a-z])\1{2,}", r"\1", x), re.sub(r"([a-z])\1{2,}", r"\1\1", x)}
    return sorted(x for x in out if x.isalpha() and x != token), False


class Sentences:
    """Term hashes of all sentences of a batch: ``terms`` with ``of`` (sentence), and ``doc`` of each sentence."""

    def __init__(self, texts: pa.Array) -> None:
        fold, kinds = fold_tables()
        b = Batch(canonicalize(texts, True))
        self.docs = b.n
        cps = b.cps
        n = len(cps)
        if not n:
            self._empty()
            return
        row = b.rows()
        small = np.minimum(cps, 0x1FFFF)
        kind = kinds[small]
        low = fold[small].astype(np.uint64)
        first = np.concatenate([[True], row[1:] != row[:-1]])
        gap_after = np.concatenate([(kind[1:] == 0) | first[1:] | (kind[1:] == 5), [True]])
        mark = (kind == 4) | (cps == 0x21)
        ends = mark & (gap_after | (cps == 0x0A)) | (cps == 0x0A)
        begins = first | np.concatenate([[False], ends[:-1]])
        sentence = np.cumsum(begins) - 1
        self.doc = row[begins]
        word = (kind == 1) | (kind == 2)
        start = np.flatnonzero(word & np.concatenate([[True], ~word[:-1]]) | word & first)
        if not len(start):
            self._empty(self.doc)
            return
        index = np.cumsum(np.bincount(start, minlength=n)) - 1
        at = np.flatnonzero(word)
        inner = at - start[index[at]]
        with np.errstate(over="ignore"):
            raw = low[at] * POWERS[inner % 512]
            h = mix(np.add.reduceat(raw, np.searchsorted(at, start)))
        of = sentence[start]
        terms, where = [h], [of]
        extra = self._disguised(cps, low, kind, word, first, sentence)
        if extra:
            terms.append(np.array([x for x, _ in extra], dtype=np.uint64))
            where.append(np.array([s for _, s in extra], dtype=np.int64))
        known, number = class_table()
        every, place = np.concatenate(terms), np.concatenate(where)
        hit = np.minimum(np.searchsorted(known, every), len(known) - 1)
        is_known = known[hit] == every
        terms.append(np.array(CLASS_HASH, dtype=np.uint64)[number[hit[is_known]]])
        where.append(place[is_known])
        together = of[1:] == of[:-1]
        with np.errstate(over="ignore"):
            pairs = mix(h[:-1] * np.uint64(31) + h[1:])[together]
        self.terms = (np.concatenate(terms) % np.uint64(DIM)).astype(np.int32)
        self.of = np.concatenate(where).astype(np.int32)
        self.words = len(h)  # these come first, in order of their sentences
        self.pairs = (pairs % np.uint64(DIM)).astype(np.int32)
        self.pairs_of = of[1:][together].astype(np.int32)

    def _empty(self, doc: np.ndarray | None = None) -> None:
        none = np.zeros(0, dtype=np.int64)
        self.doc = none if doc is None else doc
        self.terms = self.of = self.pairs = self.pairs_of = none
        self.words = 0

    @staticmethod
    def _disguised(cps, low, kind, word, first, sentence) -> list[tuple[np.uint64, int]]:
        """(hash, sentence) of the plain readings of tokens that may be disguised."""
        solid = kind != 0
        solid[cps == 0x0A] = False
        begin = np.flatnonzero(solid & (np.concatenate([[True], ~solid[:-1]]) | first))
        if not len(begin):
            return []
        after = np.concatenate([(~solid)[1:] | first[1:], [True]])
        end = np.flatnonzero(solid & after) + 1
        letter = kind == 1
        run = np.zeros(len(cps), dtype=bool)
        run[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & ~first[2:] & ~first[1:-1]
        inside = np.concatenate([solid[1:] & ~first[1:] & (word[1:] | (kind[1:] == 3)), [False]])
        sign = (kind == 3) & inside | (kind == 2)
        count = lambda m: np.add.reduceat(m.astype(np.int32), begin)
        letters, signs, runs = count(letter), count(sign), count(run)
        dots = count((cps == 0x2E) | (cps == 0x5F) | (cps == 0x2D))
        odd = (letters > 0) & ((signs > 0) | (runs > 0) | (dots >= 2) & (letters >= 3) & (letters <= dots + 1))
        out: list[tuple[np.uint64, int]] = []

        def add(token: str, where: int) -> None:
            plain, masked = readings(token)
            if masked:
                out.append((MASKED_HASH, where))
            for p in plain:
                out.append((hash_word(p), where))
            if plain:
                out.append((DISGUISED_HASH, where))

        for i in np.flatnonzero(odd):
            add("".join(map(chr, low[begin[i] : end[i]])), int(sentence[begin[i]]))
        single = (letters == 1) & (count(word) == 1)
        if single.any():  # letters set apart by spaces, marks beside them or not
            at = np.flatnonzero(single)
            group = np.concatenate([[0], np.cumsum((np.diff(at) > 1) | (sentence[begin[at[1:]]] != sentence[begin[at[:-1]]]))])
            sizes = np.bincount(group)
            for g in np.flatnonzero(sizes >= 4):
                mine = at[group == g]
                plain = "".join(chr(low[begin[i] + int(letter[begin[i] : end[i]].argmax())]) for i in mine)
                out += [(hash_word(plain), int(sentence[begin[mine[0]]])), (DISGUISED_HASH, int(sentence[begin[mine[0]]]))]
        return out

    def __len__(self) -> int:
        return len(self.doc)


class FactorizationMachine:
    """Linear weights of terms and word pairs, and factors of terms for their interactions."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.bias = -4.0
        self.w = np.zeros(DIM, dtype=np.float32)
        for name, weight in PRIOR.items():
            self.w[int(CLASS_HASH[list(CLASSES).index(name)] % np.uint64(DIM))] = weight
        self.u = np.zeros(DIM, dtype=np.float32)  # of word pairs
        self.v = (rng.standard_normal((DIM, FACTORS)) * 0.05).astype(np.float32)

    @staticmethod
    def _sums(values: np.ndarray, s: Sentences) -> np.ndarray:
        """Sums over sentences of the rows of values, one for each term."""
        out = np.zeros((len(s), values.shape[1]), dtype=np.float32)
        of = s.of[: s.words]
        if s.words:
            starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[starts]] = np.add.reduceat(values[: s.words], starts, axis=0)
        if s.words < len(s.of):
            np.add.at(out, s.of[s.words :], values[s.words :])
        return out

    def margins(self, s: Sentences) -> np.ndarray:
        v = self.v[s.terms]
        own = np.concatenate([v, (self.w[s.terms] - 0.5 * np.einsum("nf,nf->n", v, v))[:, None]], axis=1)
        sums = self._sums(own, s)
        z = self.bias + sums[:, -1].astype(np.float64) + 0.5 * np.einsum("nf,nf->n", sums[:, :-1], sums[:, :-1])
        return z + np.bincount(s.pairs_of, weights=self.u[s.pairs], minlength=len(s))

    def probabilities(self, s: Sentences) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(s), -30, 30)))

    def fit(self, s: Sentences, y: np.ndarray, weight: np.ndarray, epochs: int = 30, rate: float = 0.18, l2: float = 2e-3) -> FactorizationMachine:
        """Full-batch adaptive gradient steps on the weighted logistic loss, over the terms that occur."""
        n = len(s)
        used, terms = np.unique(s.terms, return_inverse=True)
        used_p, pairs = np.unique(s.pairs, return_inverse=True)
        w, u, v = self.w[used].astype(np.float64), self.u[used_p].astype(np.float64), self.v[used].astype(np.float32)
        gw, gu, gv, gb = np.full(len(used), 1e-3), np.full(len(used_p), 1e-3), np.full(v.shape, 1e-3), 1e-3
        total = weight.sum()
        for _ in range(epochs):
            mine = v[terms]
            sums = self._sums(mine, s)
            squares = np.bincount(s.of, weights=np.einsum("nf,nf->n", mine, mine), minlength=n)
            z = self.bias + np.bincount(s.of, weights=w[terms], minlength=n) + np.bincount(s.pairs_of, weights=u[pairs], minlength=n)
            z += 0.5 * ((sums**2).sum(axis=1) - squares)
            g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / total * 100
            at = g[s.of]
            dw = np.bincount(terms, weights=at, minlength=len(used)) + l2 * w
            du = np.bincount(pairs, weights=g[s.pairs_of], minlength=len(used_p)) + l2 * u
            gw += dw**2
            gu += du**2
            for f in range(FACTORS):
                dv = np.bincount(terms, weights=at * (sums[s.of, f] - mine[:, f]), minlength=len(used)) + 5 * l2 * v[:, f]
                gv[:, f] += dv**2
                v[:, f] -= (rate * dv / np.sqrt(gv[:, f])).astype(np.float32)
            w -= rate * dw / np.sqrt(gw)
            u -= rate * du / np.sqrt(gu)
            db = g.sum()
            gb += db**2
            self.bias -= rate * db / np.sqrt(gb)
        self.w[used], self.u[used_p], self.v[used] = w, u, v
        return self


def select(s: Sentences, keep: np.ndarray) -> Sentences:
    """The sentences that keep picks, renumbered."""
    out = Sentences.__new__(Sentences)
    number = (np.cumsum(keep) - 1).astype(np.int32)
    out.docs, out.doc = s.docs, s.doc[keep]
    t, p = keep[s.of], keep[s.pairs_of]
    out.terms, out.of = s.terms[t], number[s.of[t]]
    out.words = int(t[: s.words].sum())
    out.pairs, out.pairs_of = s.pairs[p], number[s.pairs_of[p]]
    return out


def _sentences(texts: list[str], labels: np.ndarray) -> tuple[Sentences, np.ndarray]:
    """(sentences of all texts, whether a sentence holds a listed word), read slice by slice."""
    array = pa.array(texts, pa.string())
    parts, listed = [], []
    numbers = [int(h % np.uint64(DIM)) for h in CLASS_HASH[:4]]
    docs = sentences = 0
    for lo, hi in slices(array):
        s = Sentences(array.slice(lo, hi - lo))
        mark = np.zeros(len(s), dtype=bool)
        mark[s.of[np.isin(s.terms, numbers)]] = True
        listed.append(mark)
        parts.append((s.doc + lo, s.terms[: s.words], s.of[: s.words] + sentences, s.terms[s.words :], s.of[s.words :] + sentences, s.pairs, s.pairs_of + sentences))
        sentences += len(s)
        docs = hi
    whole = Sentences.__new__(Sentences)
    doc, words, of, more, more_of, pairs, pairs_of = (np.concatenate(x) for x in zip(*parts))
    whole.docs, whole.doc, whole.words = docs, doc, len(words)
    whole.terms, whole.of, whole.pairs, whole.pairs_of = np.concatenate([words, more]), np.concatenate([of, more_of]), pairs, pairs_of
    return whole, np.concatenate(listed)


def _fit(s: Sentences, y: np.ndarray, use: np.ndarray, share: np.ndarray) -> FactorizationMachine:
    pos, neg = max(1.0, (y * share)[use].sum()), max(1.0, share[use & (y == 0)].sum())
    weight = np.where(y == 1, min(30.0, max(1.0, 0.1 * neg / pos)), 1.0) * share
    return FactorizationMachine().fit(select(s, use), y[use], weight[use])


def _worst(p: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    best = np.zeros(n)
    np.maximum.at(best, doc, p)
    return best


def _clean_cut(positive: np.ndarray, negative: np.ndarray, each: float) -> float:
    """The score with the best balance of positive against (threefold) negative documents above it; a negative one stands for each."""
    if not len(positive):
        return USUAL_CUT
    at = np.unique(np.concatenate([positive, [MOST_CUT]]))
    gain = (positive[None] >= at[:, None]).sum(axis=1) - 3 * each * (negative[None] >= at[:, None]).sum(axis=1)
    return float(np.clip(at[gain.argmax()] * 0.98, LEAST_CUT, 0.9))


def train(texts: list[str], toxic: list[int], each: float = 1.0, rounds: int = 3, most_sentences: int = MOST_SENTENCES) -> FactorizationMachine:
    """A machine from document labels, with the threshold it should be used at (``cut``).

    A negative document stands for ``each`` of them. Sentence labels come from
    machines fitted on the other half of the documents, so a mislabelled
    document can't vouch for itself: a sentence of a positive document counts as
    harmful only if it scores where documents are mostly labelled positive (see
    ``_clean_cut``). ``held`` of the machine are the scores that documents got
    from machines that hadn't seen them.
    """
    if not texts:  # nothing to learn from: the starting weights, at the highest threshold
        machine = FactorizationMachine()
        machine.cut, machine.held = MOST_CUT, np.zeros(0)
        return machine
    labels = np.array(toxic, dtype=np.int64)
    s, listed = _sentences(texts, labels)
    y_doc = labels[s.doc]
    plain = np.random.default_rng(7).permutation(np.flatnonzero((y_doc == 0) & ~listed))
    pick = (y_doc == 1) | listed
    pick[plain[:most_sentences]] = True
    stands_for = (np.where((y_doc == 0) & ~listed, max(1.0, len(plain) / most_sentences), 1.0) * np.where(y_doc == 0, each, 1.0))[pick]
    s = select(s, pick)
    y_doc = labels[s.doc]
    half = (s.doc * 7919 // 13) % 2
    # at first every sentence of a positive document stands for it, each with its share
    y, use = y_doc.astype(float), np.ones(len(s), dtype=bool)
    share = np.where(y_doc == 1, 1 / np.maximum(1, np.bincount(s.doc, minlength=s.docs)[s.doc]), stands_for)
    held = np.zeros(len(s))
    cuts = [0.05, 0.05]
    for _ in range(rounds):
        for f in (0, 1):
            machine = _fit(s, y, use & (half != f), share)
            held[half == f] = machine.probabilities(select(s, half == f))
        share = stands_for
        best = _worst(held, s.doc, s.docs)
        y, use = np.zeros(len(s)), np.zeros(len(s), dtype=bool)
        for f in (0, 1):
            mine = half == f
            calm, loud = np.unique(s.doc[mine & (y_doc == 0)]), np.unique(s.doc[mine & (y_doc == 1)])
            cuts[f] = _clean_cut(best[loud], best[calm], each)
            harmful = mine & (y_doc == 1) & (held > cuts[f])
            y[harmful], use[harmful] = 1, True
            use |= mine & (y_doc == 0) & (held < 0.9)
    machine = _fit(s, y, use, share)
    # between what nearly all negative documents stay below and what the harmful reach; few labels, near the usual place
    found, calm = best[np.unique(s.doc[y == 1])], np.unique(s.doc[y_doc == 0])
    low = float(np.quantile(found, 0.02)) if len(found) else USUAL_CUT
    seen = np.sqrt(max(cuts) * max(low, max(cuts)))
    trust = len(calm) / (len(calm) + 1000)
    machine.cut = float(np.clip(np.exp(trust * np.log(seen) + (1 - trust) * np.log(USUAL_CUT)), LEAST_CUT, MOST_CUT))
    machine.held = best
    return machine


def score_texts(machine: FactorizationMachine, texts: pa.Array) -> np.ndarray:
    """The worst sentence's probability of each text."""
    out = np.zeros(len(texts))
    for lo, hi in slices(texts):
        s = Sentences(texts.slice(lo, hi - lo))
        if len(s):
            p = machine.probabilities(s)
            p[np.bincount(s.of, minlength=len(s)) == 0] = 0
            starts = np.flatnonzero(np.concatenate([[True], s.doc[1:] != s.doc[:-1]]))
            out[lo + s.doc[starts]] = np.maximum.reduceat(p, starts)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> tuple[list[str], list[int], float]:
    """(texts, labels, negative documents that each negative one stands for) of a bounded sample, drawn by hash.

    Its keys are few enough to broadcast.
    """
    order = F.xxhash64(F.lit(19), key)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, label)
    ids = known.filter(F.col(label) == 1).orderBy(order).limit(most_positive).unionByName(known.filter(F.col(label) == 0).orderBy(order).limit(most_negative))
    negative = known.filter(F.col(label) == 0).count()
    rows = docs.select(key, text).filter(F.col(text).isNotNull()).join(F.broadcast(ids), key).orderBy(order, text).select(text, label).collect()
    return [r[0] for r in rows], [int(r[1]) for r in rows], max(1.0, negative / most_negative)


def score_documents(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, keep: list[str] | None = None, most_positive: int = MOST_POSITIVE, most_negative: int = MOST_NEGATIVE) -> DataFrame:
    """docs' key and kept columns with ``score`` (0..1) and ``flagged``."""
    machine = train(*labelled_sample(docs, labels, key, text, label, most_positive, most_negative))
    machine.held = None  # the tasks need no scores of the sample
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(machine)  # a fixed size, about 5 MB

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(score_texts(shared.value, texts), 6))

    d = docs.select(key, *(keep or []), score(F.col(text)).alias("score"))
    return d.withColumn("flagged", F.col("score") >= machine.cut)
