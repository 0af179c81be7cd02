"""Broken prompt and response pairs (problem 5).

A response is cut into clauses (sentences and lines). A linear-chain conditional
random field tags each clause as answer, refusal, echo of the question, foreign
language or unfinished, from what the clause shows: cues of declining, overlap
with the question, its language against the question's, its place, and whether
the text breaks off there (problem 3's terminality). The pair's defect follows
from how much of the response each tag covers.

The field is trained in the session on a bounded sample (parameter
``train_rows``, pairs drawn by hash): responses without any sign of a defect are taken as
answers, and each defect is made from them by construction (cut off, replaced
by another language's response, by the question, by a refusal). Every record
is tagged.

Defined results: null, blank and placeholder responses are ``empty``; a null or
blank question makes no language or copy defect, and nor does a question that
the field itself reads as a refusal make a language defect; a record has at most one
defect, in the order empty, refusal, copy, language, truncated. Repeated keys
count once.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_right
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemill.llm.crf import CRF, pad
from prosemill.llm.truncation import is_placeholder

LABELS = ["answer", "refusal", "echo", "foreign", "unfinished"]
TRAIN_ROWS = 600
WIDTH = 12

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for on with as was are by be this from at not his her they we you has have which an or but their its who what so than every between".split(),
    "de": "der die das und ist den dem des ein eine einen einem von mit nicht für auf im zu sich aber auch wie wird war wer dass noch nur oder bei zum zur über seit jeder man es wenn".split(),
    "fr": "le la les et est un une des du que pour dans qui sur pas ne au aux ce cette il elle je vous nous mais ou avec par son sa ses à été depuis si chaque entre y n'y qu'un".split(),
    "es": "el la los las y es un una que en por con para del se su al lo como más pero sus le este esta fue ni entre cada desde si no yo era hay sobre sin también".split(),
    "it": "il lo gli e è un una che per con del della non si nel sono come più ma anche di questo questa alla dei delle ogni tra".split(),
    "pt": "o os as e é um uma que em por com para do da não se no na mais mas como dos das ao foi este esta cada entre há".split(),
    "nl": "de het een en van ik te dat die in is niet op aan met voor er maar om ook dan zijn naar bij uit nog wordt elke tussen".split(),
}
# How a text asks for a language, by name.
LANGUAGE_NAMES = {
    "en": ["english", "englisch", "englischer", "anglais", "inglés", "inglese", "inglês"],
    "de": ["german", "deutsch", "deutscher", "allemand", "alemán", "tedesco", "alemão"],
    "fr": ["french", "französisch", "französischer", "français", "francés", "francese", "francês"],
    "es": ["spanish", "spanisch", "spanischer", "espagnol", "español", "castellano", "spagnolo", "espanhol"],
    "it": ["italian", "italienisch", "italien", "italiano"],
    "pt": ["portuguese", "portugiesisch", "portugais", "portugués", "português"],
    "nl": ["dutch", "niederländisch", "néerlandais", "neerlandés"],
}
NAMED = {name: code for code, names in LANGUAGE_NAMES.items() for name in names}
NAMED_WORDS = frozenset(NAMED)
ASKED = re.compile(r"\b(?:in|auf|en|into|to|use|using)\s+(?:plain\s+|the\s+|simple\s+)?(\w+)", re.I)

# Verbs that name what a refusal won't do.
DOING = r"(?:help|assist|writ\w*|do\b|provid\w*|produc\w*|creat\w*|compl\w*|fulfil\w*|answer\w*|continu\w*|generat\w*|support|offer|engage|respond|draft\w*|discuss|go\b|proceed|take|share|make)"
REFUSAL_CUES = [
    rf"\bi(?:'m|’m| am)?\s+(?:really |simply |just |afraid i )?(?:can(?:not|'t|’t| not)|could(?:n't|n’t| not)|won(?:'t|’t)|will not|would(?:n't|n’t| not)|must not|may not|don(?:'t|’t)|do not|(?:not |un)able to|not going to|not (?:permitted|allowed|willing|comfortable))\b(?:\s+\w+){{0,3}}?\s+{DOING}",
    r"\bi(?:'m|’m| am)?\s+(?:must|have to|need to|will|would|respectfully|shall|politely)?\s*(?:decline|refuse|stop here|pass on)\b",
    r"\bi(?:'d|’d| would)\s+(?:rather|prefer)\s+(?:not|to not)\b",
    r"\bdon(?:'t|’t)\s+feel\s+comfortable\b|\bnot comfortable\b",
    r"^\W*(?:i(?:'m|’m| am)\s+(?:very |so )?sorry|sorry|my apologies|apologies|unfortunately|regrettably|i apologi[sz]e)\b(?! to (?:say|report|hear))",
    r"\b(?:guidelines|policy|policies|rules)\b(?! of\b).{0,40}\b(?:allow|permit|follow|prevent|forbid|prohibit|against)|\bagainst (?:the|my) (?:rules|guidelines|policy|policies|principles)\b",
    r"\b(?:as|being) an? (?:ai|language model|assistant|artificial intelligence)\b(?:,| (?:language )?(?:model|assistant),?) (?=i\b|my\b)",
    r"\b(?:off[- ]limits|outside (?:of )?what i can|beyond what i can|not something i can|isn(?:'t|’t) something i|no way to do that|not going to fulfil)\b",
    r"\b(?:this|that|the) (?:kind of (?:piece|text|request)|request|topic|task|subject)\b.{0,30}\b(?:off limits|falls outside|declined|cannot be|can(?:'t|’t) be|not possible|am not)\b|\bfor this request\b",
    r"\bno (?:text|essay|answer|content) (?:will|can) be\b|\bmy answer is no\b|\bi have to stop here\b",
    r"\blet(?:'s|’s| us) talk about (?:something|anything) else\b",
    r"\bwould not be (?:right|appropriate) for me\b|\bwouldn(?:'t|’t) be (?:right|appropriate) for me\b",
    # German, French, Spanish, Italian, Portuguese, Dutch
    r"\b(?:tut mir leid|leider (?:kann|muss|darf|ist)|entschuldigung|ich (?:kann|darf|möchte|werde|will) (?:\w+ ){0,5}nicht\b|(?:kann|darf|möchte|werde) ich (?:\w+ ){0,4}(?:nicht|nichts|kein\w*)\b|ablehnen|als sprachmodell|als ki\b|nicht weiterhelfen|lieber nicht)",
    r"(?:\bdésolée?\b|\bje (?:ne |n')(?:peux|suis|puis|veux|souhaite|rédige|peut)|\bje (?:dois|préfère) (?:\w+ )?(?:refuser|décliner|ne pas)|\ben tant que (?:modèle|ia|assistant)|\bimpossible de (?:vous|t')\s*aider|\bmalheureusement\b.{0,20}\b(?:peux|puis)\b)",
    r"(?:\blo siento\b|\bno (?:puedo|podré|voy a|me es posible|redacto|escribo|debo)\b|\bdebo (?:rechazar|negarme|declinar)|\bprefiero no\b|\bcomo (?:modelo|ia|asistente)\b|\blamentablemente\b|\bme niego\b)",
    r"(?:\bmi dispiace\b|\bnon posso\b|\bpreferisco non\b|\bcome modello\b|\bsinto muito\b|\bdesculpe\b|\bnão posso\b|\bprefiro não\b|\bcomo modelo\b|\bhet spijt me\b|\bik kan (?:\w+ ){0,3}niet\b|\bals taalmodel\b)",
]
CUES = [re.compile(c) for c in REFUSAL_CUES]  # for lower-case clauses
ANY_CUE = re.compile("|".join(f"(?:{c})" for c in REFUSAL_CUES))
# Every cue needs one of these words, and every offer one of those.
CUE_WORDS = frozenset(
    """i i'm i’m i'd i’d i'll i’ll i've sorry apologies apologize apologise unfortunately regrettably guidelines policy policies rules principles ai assistant model limits
    outside beyond isn't isn’t something way fulfil request topic task subject kind text essay content answer talk right comfortable stop
    leid leider entschuldigung ich ablehnen sprachmodell ki weiterhelfen lieber désolé désolée je modèle ia malheureusement impossible tant
    siento no debo prefiero como lamentablemente niego dispiace non preferisco come modello sinto desculpe não prefiro modelo spijt ik taalmodel
    artificial language""".split()
)
OFFER_WORDS = frozenset("if turn ask instead happy frag hablemos parlons stattdessen cambio place".split())
REDIRECT = re.compile(r"\b(?:if you like, i can|you could turn to|please ask (?:about|me)|ask me (?:about|for)|instead\b.*$|happy to help with|frag lieber|hablemos mejor|parlons plutôt|stattdessen|en cambio|à la place)", re.I)
# Refusals and replies that only sound like one, for training.
REFUSALS = [
    "I'm sorry, but I can't write this.", "I cannot help with that request.", "I am unable to continue with this task.", "As an AI, I do not produce such texts.",
    "Unfortunately I can't assist you here.", "I must refuse.", "I would rather not answer.", "My policies prevent me from writing it.", "I won't be writing this essay.",
    "This topic is off limits for me.", "Sorry, I have to decline.", "I'm not allowed to create that.", "No essay will be provided.",
    "Es tut mir leid, das kann ich nicht schreiben.", "Leider darf ich dabei nicht helfen.", "Ich kann diesen Text nicht verfassen.", "Das muss ich ablehnen.",
    "Je suis désolé, je ne peux pas écrire cela.", "Je dois refuser.", "En tant que modèle, je ne peux pas répondre.",
    "Lo siento, no puedo escribir esto.", "Debo rechazar esta tarea.", "Como modelo, no puedo ayudar.", "Mi dispiace, non posso aiutare.", "Desculpe, não posso ajudar.",
]
OFFERS = ["You could turn to another subject.", "Please ask about something else instead.", "If you like, I can write about a garden.", "Frag lieber nach etwas anderem.", "Hablemos mejor de otra cosa.", "Parlons plutôt d'autre chose."]
SOUNDS_LIKE = [
    "I cannot remember a summer that was so long.", "I can't think of a better road.", "I'm sorry to say that the bridge was closed.", "The council declined to help the farmers.",
    "He could not help the painters.", "As a result, the town can't sleep.", "As an AI critic put it, the play is dull.", "Ich kann mich nicht erinnern.", "Le maire ne peut pas dormir.", "El alcalde no quiere hablar.",
]

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
# What ends a clause: marks before white space, or a line's end; one set of characters begins all, which is found fast.
END = re.compile(r"[.!?。！？\n](?:(?<=\n)|(?<!\n)[.!?。！？]*[\"'”’»)\]*]*(?=\s|$))")
APART = {i: " " for i in range(1, 128) if not chr(i).isalnum() and chr(i) != "'"}  # 0 stands for a clause's end
LETTER = re.compile(r"[^\W_]")


def language(ws: list[str]) -> str | None:
    """The language whose function words fill most of ws; another script is named by it; None if unclear."""
    if not ws:
        return None
    if max(ws) >= "\u0370":
        other = [w for w in ws if w >= "\u0370"]
        if len(other) * 2 > len(ws):
            return f"script-{max(ord(w[0]) for w in other) >> 8}"
    packed = sum(map(COUNTED.get, ws, repeat(0)))
    if not packed:
        return None
    count = [packed >> 32 * k & 0xFFFFFFFF for k in range(len(FUNCTION_WORDS))]
    top = max(count)
    return list(FUNCTION_WORDS)[count.index(top)] if count.count(top) == 1 else None


def clauses(low: str) -> list[list[str]]:
    """The words of each clause that has some."""
    if low.isascii() and "\0" not in low:
        parts = END.sub("\0", low).translate(APART).split("\0")
        each = (WORD.findall(p) if "'" in p else p.split() for p in parts) if "'" in low else map(str.split, parts)
    else:
        each = map(WORD.findall, END.split(low))
    return [ws for ws in each if ws] or [[]]


class Reading:
    """A text's words by clause, and what else is asked of it, worked out once for all its uses."""

    def __init__(self, text: str | None) -> None:
        self.blank = not text or is_placeholder(text)
        self.low = (text or "").lower()
        self.each = clauses(self.low)
        self.words = list(chain.from_iterable(self.each))
        self.set = set(self.words)
        self._raw = None

    def raw(self, i: int) -> str:
        """Clause i as it is written, in lower case."""
        if self._raw is None:
            ends = [0, *(m.end() for m in END.finditer(self.low)), len(self.low)]
            parts = [self.low[x:y] for x, y in zip(ends, ends[1:])]
            self._raw = [p.strip() for p in parts if LETTER.search(p)] or [self.low]
        return self._raw[i]

    @cached_property
    def triples(self) -> list[tuple[str, str, str]]:
        return list(zip(self.words, self.words[1:], self.words[2:]))

    @cached_property
    def runs(self) -> set[tuple[str, str, str]]:
        return set(self.triples)

    @cached_property
    def lang(self) -> str | None:
        return language(self.words)

    @cached_property
    def cues(self) -> list[int]:
        """Number of cues of declining in each clause; 2 stands for more."""
        stem = not CUE_WORDS.isdisjoint(self.set) and any(s in self.low for s in CUE_STEMS)
        if not stem and (CUE_WORDS.isdisjoint(self.set) or not may_decline(self.set)):
            return [0] * len(self.each)
        return [0 if CUE_WORDS.isdisjoint(w) or not stem and not may_decline(set(w)) else cues_of(self.raw(i)) for i, w in enumerate(self.each)]

    @cached_property
    def offers(self) -> list[int]:
        if OFFER_WORDS.isdisjoint(self.set) or not may_offer(self.set):
            return [0] * len(self.each)
        return [int(not OFFER_WORDS.isdisjoint(w) and may_offer(set(w)) and bool(REDIRECT.search(self.raw(i)))) for i, w in enumerate(self.each)]

    @cached_property
    def asked(self) -> set[str]:
        return set() if NAMED_WORDS.isdisjoint(self.set) else {NAMED[m] for m in ASKED.findall(self.low) if m in NAMED}


# Every function word as one in 32 bits of each language that has it.
COUNTED = {w: sum(1 << 32 * k for k, own in enumerate(FUNCTION_WORDS.values()) if w in own) for ws in FUNCTION_WORDS.values() for w in ws}

# Words without which no cue is found, alone or with another one; stems may go on.
CUE_STEMS = ["entschuldigung", "ablehnen"]
CUE_ALONE = frozenset(
    """comfortable sorry apologies unfortunately regrettably apologise apologize guidelines policy policies rules principles ai model assistant intelligence limits fulfil request talk
    tut leider ich als lieber nicht désolé désolée je tant impossible malheureusement siento puedo podré voy posible redacto escribo debo prefiero como lamentablemente niego
    dispiace posso preferisco modello sinto desculpe prefiro spijt ik taalmodel""".split()
)
CUE_PAIRS = [
    (frozenset(a.split()), frozenset(b.split()))
    for a, b in [
        ("i", "t not cannot unable outside beyond something " + " ".join(x + y for x in ["", "must", "to", "will", "would", "respectfully", "shall", "politely"] for y in ("decline", "refuse", "stop", "pass"))),
        ("piece text topic task subject", "limits falls declined cannot t not"), ("no", "text essay answer content way"), ("me", "right appropriate"),
    ]
]
OFFER_ALONE = frozenset("ask instead frag hablemos parlons stattdessen cambio".split())
OFFER_PAIRS = [(frozenset([a]), frozenset([b])) for a, b in [("if", "like"), ("turn", "could"), ("happy", "help"), ("place", "la")]]


def may_have(ws: set[str], alone: frozenset[str], pairs: list[tuple[frozenset[str], frozenset[str]]]) -> bool:
    """Whether ws, also split at apostrophes, have a word of alone or words of both sides of a pair."""
    if not alone.isdisjoint(ws):
        return True
    ws = ws.union(*[re.split("['’]", w) for w in ws if "'" in w or "’" in w])
    return not alone.isdisjoint(ws) or any(not a.isdisjoint(ws) and not b.isdisjoint(ws) for a, b in pairs)


def may_decline(ws: set[str]) -> bool:
    """Whether a clause of these words, unless it has a stem, can have a cue."""
    return may_have(ws, CUE_ALONE, CUE_PAIRS)


def may_offer(ws: set[str]) -> bool:
    return may_have(ws, OFFER_ALONE, OFFER_PAIRS)


def cues_of(clause: str) -> int:
    """Number of cues of declining in a lower-case clause; 2 stands for more."""
    if not ANY_CUE.search(clause):
        return 0
    found = 0
    for c in CUES:
        if c.search(clause):
            found += 1
            if found == 2:
                break
    return found


# Feature numbers: one block per kind, one feature per bucket.
BLOCKS = {"bias": 1, "cues": 3, "offer": 2, "echo": 5, "run": 4, "lang": 4, "whole": 3, "place": 4, "broken": 2, "size": 3, "echo_all": 3, "early": 2}
OFFSET = {k: sum(list(BLOCKS.values())[:i]) for i, k in enumerate(BLOCKS)}
FEATURES = sum(BLOCKS.values())


def _bucket(x: float, cuts: list[float]) -> int:
    return bisect_right(cuts, x)


NO_QUESTION = Reading(None)


# A clause's features as one number: a digit per kind, in the order of the features.
KINDS = ["cues", "offer", "run", "echo", "lang", "place", "broken", "early", "whole", "size", "echo_all", "bias"]
STEP = {k: int(np.prod([BLOCKS[x] for x in KINDS[:i]], dtype=np.int64)) for i, k in enumerate(KINDS)}
OFFER, RUN, ECHO, LANG, PLACE, BROKEN, EARLY, WHOLE, SIZE, ECHO_ALL = (STEP[k] for k in KINDS[1:-1])


def unfold(numbers: np.ndarray) -> np.ndarray:
    """Feature numbers (n, kinds) of clauses."""
    return np.stack([OFFSET[k] + numbers // STEP[k] % BLOCKS[k] for k in KINDS], axis=1).astype(np.int32)


def folded(question: Reading, answer: Reading, broken: bool, declined: bool = False) -> tuple[list[int], list[int]]:
    """(features per clause as a number, words per clause) of a response; declined: the question is itself a refusal."""
    q, a = (NO_QUESTION if question.blank else question), answer
    qset = q.set
    qlang = None if declined else q.lang
    asked = q.asked
    n = len(a.words)
    whole = a.lang
    shared = bytes(map(qset.__contains__, a.words)) if qset else bytes(n)
    # three words in a row that the question has are three shared words in a row, so these bound the shares of runs
    all_echo = 0.0
    if n < 3:
        all_echo = float(0 < n == sum(shared))
    elif 5 * sum([len(x) - 2 for x in shared.split(b"\0") if len(x) > 2]) >= 2 * (n - 2):
        all_echo = sum(map(q.runs.__contains__, a.triples)) / (n - 2)

    def relation(lang: str | None, words: int) -> int:
        if lang is None or qlang is None:
            return 0
        if lang in asked:
            return 1
        if asked and not lang == qlang:
            return 2
        return 1 if lang == qlang else 3 if words < 4 else 2

    alike = whole is not None and whole == qlang  # then no clause need be looked at alone
    early = EARLY * (a.cues[0] > 0)
    same = WHOLE * min(2, relation(whole, n)) + SIZE * _bucket(n, [40, 90]) + ECHO_ALL * _bucket(all_echo, [0.4, 0.75])
    if alike:
        same += LANG
    out, sizes = [], []
    final, lo = len(a.each) - 1, 0
    for i, (w, cues, offer) in enumerate(zip(a.each, a.cues, a.offers)):
        m = len(w)
        number = same + cues + OFFER * offer
        if have := shared.count(1, lo, lo + m):
            number += ECHO * _bucket(have / m, [0.3, 0.6, 0.8, 0.95])
            if have > 2 and have - 2 >= 0.25 * (m - 2) and shared.find(b"\1\1\1", lo, lo + m) >= 0:
                number += RUN * _bucket(sum(map(q.runs.__contains__, zip(w, w[1:], w[2:]))) / (m - 2), [0.25, 0.6, 0.9])
        if not alike:
            number += LANG * relation(language(w), m)
        if i:
            number += early + PLACE * (2 if i == final else 1)
        elif not final:
            number += PLACE * 3
        out.append(number)
        sizes.append(m or 1)
        lo += m
    if broken:
        out[-1] += BROKEN
    return out, sizes


def features(question: Reading, answer: Reading, broken: bool) -> list[list[int]]:
    """Features per clause of a response."""
    return unfold(np.array(folded(question, answer, broken)[0])).tolist()


def _broken_by_rule(text: str) -> bool:
    from prosemill.llm.truncation import ending

    return ending(text)[0] == "cut"


def training_set(rows: list[tuple[str | None, str | None]]) -> tuple[list, list]:
    """(sequences, labels) made from sampled (question, answer) rows by construction."""
    rng = np.random.default_rng(5)
    answer, refusal, echo, foreign, unfinished = range(5)
    clean: list[tuple[str, str, str | None]] = []
    for q, a in rows:
        if not q or not a or is_placeholder(a) or is_placeholder(q) or _broken_by_rule(a):
            continue
        ra, rq = Reading(a), Reading(q)
        if len(ra.words) < 12 or ra.lang is None or ra.lang != rq.lang or ra.cues[0] or sum(r in rq.runs for r in ra.triples) > 0.3 * max(1, len(ra.triples)):
            continue
        clean.append((q, a, ra.lang))
    if not clean:
        clean = [("Write an essay about the river.", "The river is wide. It has two bridges and a mill. We walked along it.", "en")]
    by_lang: dict[str, list[str]] = {}
    for _, a, lang in clean:
        by_lang.setdefault(lang, []).append(a)
    for lang, extra in {
        "en": "The river is wide and the bridge is old. We walked along it in the evening. Every house has a garden.",
        "de": "Der Fluss ist breit und die Brücke ist alt. Wir gingen am Abend an ihm entlang. Jedes Haus hat einen Garten.",
        "fr": "La rivière est large et le pont est vieux. Nous avons marché le soir. Chaque maison a un jardin.",
        "es": "El río es ancho y el puente es viejo. Caminamos por la tarde. Cada casa tiene un jardín.",
    }.items():
        by_lang.setdefault(lang, []).append(extra)
    seqs, labels = [], []

    def add(q: str | None, a: str, tag, broken: bool = False) -> None:
        f = features(Reading(q), Reading(a), broken)
        seqs.append(f)
        labels.append(tag(len(f)))

    for i, (q, a, lang) in enumerate(clean):
        add(q, a, lambda n: [answer] * n)
        if i % 3 == 0:  # the question may be missing or unfit to tell the language
            add(None, a, lambda n: [answer] * n)
            other = by_lang[sorted(by_lang)[i % len(by_lang)]]
            add(None, other[i % len(other)], lambda n: [answer] * n)
        kind = i % 6
        if kind == 0:
            head = REFUSALS[rng.integers(len(REFUSALS))]
            tail = [OFFERS[rng.integers(len(OFFERS))] for _ in range(rng.integers(0, 3))]
            mine = Reading(a)
            tail += [f"If you like, I can {mine.raw(j)}" for j in range(min(len(mine.each), int(rng.integers(0, 10))))]
            add(q, "\n\n".join([head, *tail]), lambda n: [refusal] * n)
        elif kind == 1:
            head = ["", "Sure!\n\n", "Here is the text:\n\n", "You asked: "][rng.integers(4)]
            asking = Reading(q)
            keep = [asking.raw(j) for j in range(len(asking.each))]
            text = head + " ".join(keep[: max(2, int(len(keep) * rng.uniform(0.5, 1)))])
            add(q, text.upper() if rng.random() < 0.2 else text, lambda n: [echo] * n)
        elif kind == 2:
            others = [x for x in by_lang if x != lang]
            pool = by_lang[others[rng.integers(len(others))]]
            add(q, pool[rng.integers(len(pool))], lambda n: [foreign] * n)
        elif kind == 3:
            cut = a[: int(len(a) * rng.uniform(0.3, 0.95))].rstrip(" .")
            add(q, cut, lambda n: [answer] * (n - 1) + [unfinished], True)
        elif kind == 4:
            decoy = SOUNDS_LIKE[rng.integers(len(SOUNDS_LIKE))]
            add(q, f"{decoy} {a}", lambda n: [answer] * n)
        else:
            add(q, f"{a} {Reading(q).raw(0)}", lambda n: [answer] * (n - 1) + [echo])  # a quoted phrase of the question is no echo of it
    for i, head in enumerate(REFUSALS * 4):  # every refusal, alone and with an offer, whatever the sample holds
        q = clean[i % len(clean)][0] if i % 5 else None
        add(q, head if i % 2 else f"{head} {OFFERS[i % len(OFFERS)]}", lambda n: [refusal] * n)
    return seqs, labels


WINDOW = 24


def train(rows: list[tuple[str | None, str | None]]) -> CRF:
    """The field, from whole responses; long ones are learned window by window, so that padding stays small."""
    seqs, labels, begins = [], [], []
    for f, t in zip(*training_set(rows)):
        for lo in range(0, len(f), WINDOW):
            seqs.append(f[lo : lo + WINDOW])
            labels.append(t[lo : lo + WINDOW])
            begins.append(lo == 0)
    x, lengths = pad(seqs, WIDTH)
    y = np.zeros(x.shape[:2], dtype=np.int32)
    for i, t in enumerate(labels):
        y[i, : len(t)] = t
    x[x < 0] = FEATURES
    return CRF(FEATURES, len(LABELS)).fit(x, lengths, y, np.array(begins))


def _tag(model: CRF, items: list[tuple[list[int], list[int], bool]]) -> list[tuple[str | None, dict[str, float]]]:
    """(defect or None, share of the response each tag covers) of (features per clause as a number, words per clause, broken)."""
    out: list = [None] * len(items)
    order = sorted(range(len(items)), key=lambda i: len(items[i][0]))
    kinds, which = np.unique(np.array([x for i in order for x in items[i][0]], dtype=np.int64), return_inverse=True)
    emit = model.scores(unfold(kinds)[None])[0][which.reshape(-1)]  # features are few, so most clauses look like others
    words = np.array([x for i in order for x in items[i][1]], dtype=float)
    end = 0
    for lo in range(0, len(order), 256):
        part = order[lo : lo + 256]
        lengths = np.array([len(items[i][0]) for i in part])
        begin, end = end, end + int(lengths.sum())
        inside = np.arange(lengths.max())[None] < lengths[:, None]
        scores, sizes = np.zeros((*inside.shape, len(LABELS))), np.zeros(inside.shape)
        scores[inside], sizes[inside] = emit[begin:end], words[begin:end]
        tags = model.best(scores, lengths)
        total = sizes.sum(axis=1)
        share = np.stack([(sizes * (tags == k)).sum(axis=1) / total for k in range(len(LABELS))], axis=1).tolist()
        last, first = (tags[np.arange(len(part)), lengths - 1] == 4).tolist(), tags[:, 0].tolist()
        for j, i in enumerate(part):
            cover = dict(zip(LABELS, share[j]))
            out[i] = (defect_of(cover, first[j], last[j], items[i][2]), cover)
    return out


def refusals(model: CRF, readings: list[Reading]) -> list[bool]:
    """Whether each text, read as a response of its own, is a refusal; without any cue of declining it isn't."""
    maybe = [i for i, r in enumerate(readings) if not r.blank and any(r.cues)]
    found = [False] * len(readings)
    for i, (defect, _) in zip(maybe, _tag(model, [(*folded(NO_QUESTION, readings[i], False), False) for i in maybe])):
        found[i] = defect == "refusal"
    return found


def tag_chain(model: CRF, chain: list[list[Reading]], broken: list[list[bool]]) -> list[list[tuple[str | None, dict[str, float]]]]:
    """Tags of responses in a chain: chain[0] are the first questions, chain[k] answers chain[k - 1].

    What the field says of a response is also its state as the next question.
    """
    declined = [False] * len(chain[0])  # a first question's state matters only for an answer in another language
    other = [i for i, (q, a) in enumerate(zip(chain[0], chain[1])) if not q.blank and not a.blank and q.lang and q.lang != a.lang]
    for i, no in zip(other, refusals(model, [chain[0][i] for i in other])):
        declined[i] = no
    results = []
    for asked, given, cut in zip(chain, chain[1:], broken):
        found: list = [("empty", {})] * len(given)
        at = [i for i, a in enumerate(given) if not a.blank]
        for i, r in zip(at, _tag(model, [(*folded(asked[i], given[i], bool(cut[i]), declined[i]), bool(cut[i])) for i in at])):
            found[i] = r
        declined = [r[0] == "refusal" for r in found]
        results.append(found)
    return results


def tag_batch(model: CRF, rows: list[tuple[str | None, str | None, bool]]) -> list[tuple[str | None, dict[str, float]]]:
    """(defect or None, share of the response each tag covers) of (question, answer, broken) rows."""
    return tag_chain(model, [[Reading(q) for q, _, _ in rows], [Reading(a) for _, a, _ in rows]], [[b for _, _, b in rows]])[0]


def defect_of(cover: dict[str, float], first: int, broken_tag: bool, broken: bool) -> str | None:
    """The pair's defect from the coverage of its response."""
    if first == 1 or cover["refusal"] >= 0.5:
        return "refusal"
    if cover["echo"] >= 0.6 and cover["answer"] < 0.3:
        return "copy"
    if cover["foreign"] >= 0.6:
        return "language"
    if broken and (broken_tag or cover["unfinished"] > 0):
        return "truncated"
    return None


def pair_defects(chains: DataFrame, key: str, texts: list[str], broken: list[str], train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, field, defect, refusal, echo, foreign, unfinished): a row per record and answer.

    ``texts`` are columns of which each answers the one before; field is the
    answer's column, and ``broken`` tells of each answer whether it is
    unfinished. The field is trained on ``train_rows`` pairs of the records with
    the smallest hash: a top-k, whatever the size of the table, which is
    therefore read twice; pass one on durable tables.
    """
    pair = F.struct(*[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    some = chains.select(F.xxhash64(F.lit(41), key).alias("__h"), pair.alias("__p")).orderBy("__h", "__p.t0").limit(-(-train_rows // max(1, len(texts) - 1))).collect()
    model = train([(r["__p"][i], r["__p"][i + 1]) for r in some for i in range(len(texts) - 1)])
    tags = ("refusal", "echo", "foreign", "unfinished")

    def tag(batches):
        collecting = gc.isenabled()
        gc.disable()  # readings hold no cycles, and looking for some takes a sixth of the time
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, 1000):
                    b = batch.slice(lo, 1000)
                    chain = [[Reading(t) for t in b.column(f"t{i}").to_pylist()] for i in range(len(texts))]
                    for field, found in zip(texts[1:], tag_chain(model, chain, [b.column(f"b{i}").to_pylist() for i in range(len(broken))])):
                        yield pa.RecordBatch.from_pydict({
                            key: b.column("k"), "field": pa.array([field] * b.num_rows, pa.string()), "defect": pa.array([d for d, _ in found], pa.string()),
                            **{c: pa.array([round(s.get(c, 0.0), 4) for _, s in found], pa.float64()) for c in tags},
                        })
        finally:
            if collecting:
                gc.enable()

    schema = f"{key} {dict(chains.dtypes)[key]}, field string, defect string, {', '.join(f'{c} double' for c in tags)}"
    return chains.select(F.col(key).alias("k"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(texts)], *[F.col(c).alias(f"b{i}") for i, c in enumerate(broken)]).mapInArrow(tag, schema)
