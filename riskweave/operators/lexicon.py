"""The safety lexicons as one automaton: every occurrence of every phrase of a text in one pass, each judged where it stands.

Texts pass to Python in Arrow batches as base texts. A text's words, without apostrophes and signs between them, are joined by spaces and run
once through an Aho-Corasick automaton of all phrases, so neither the plan nor the time for a text grows with the lists. Each hit knows the place of
its first and last word. The automaton is built once in each Python worker, from lists of the library and a deployment's own words.

Defined results: a null text has no hits and no findings; an empty text and one without words too; very long texts are read whole; of equal
hits each counts with its place.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cache
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assets as A
from .. import lexicons as L
from ..functions import normalise as N
from ..functions.numbers import words as plain_words

MATCH = "array<struct<kind:string,phrase:string,low:int,high:int>>"
FINDING = "array<struct<category:string,confidence:double,phrase:string>>"
JUDGED = f"struct<lever:string,findings:{FINDING}>"
#: Code points between a demand and what it leans on; words before a threat that name who acts or what excuses it; words around an insult.
REACH, BEFORE, NEAR = 4000, 8, 4
WORD = re.compile(r"[^\W_]+")
APOSTROPHES = dict.fromkeys(map(ord, "'’ʼ`"))
STARRED = re.compile(r"[a-z]+(?:[*#_]+[a-z]*)+")
PEOPLE, AGENTS = frozenset(A.PERSON_TARGETS), frozenset(A.AGENTS)
OFFERS, SERVICE = frozenset("can could may shall should might would happy glad".split()), frozenset(A.SERVICE_WORDS)
NOT = frozenset("never not dont wont didnt cant couldnt wouldnt without nobody".split())


class Hit(NamedTuple):
    kind: str
    phrase: str
    first: int  # words
    last: int
    low: int  # code points
    high: int


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words without apostrophes, with the places of their ends in the text."""
    if not any(c in text for c in "'’ʼ`"):
        if text.isascii():
            parts, starts, at = plain_words(text), [], 0
            for w in parts:
                starts.append(at := text.index(w, at))
                at += len(w)
            return parts, starts, [low + len(w) for low, w in zip(starts, parts, strict=True)]
        found = list(WORD.finditer(text))
        return [m[0] for m in found], [m.start() for m in found], [m.end() for m in found]
    kept = [i for i, c in enumerate(text) if ord(c) not in APOSTROPHES]
    found = list(WORD.finditer(text.translate(APOSTROPHES)))
    return [m[0] for m in found], [kept[m.start()] for m in found], [kept[m.end() - 1] + 1 for m in found]


def key_of(phrase: str) -> str:
    folded = phrase.lower() if phrase.isascii() else N.fold_text(phrase)
    return " " + " ".join(WORD.findall(folded.translate(APOSTROPHES))) + " "


@cache
def skeleton(word: str) -> str:
    """As functions.normalise.skeleton, of one word."""
    word = re.sub("([sctkgbd])h", r"\1", word.replace("ph", "f")).translate(str.maketrans("wzq", "vjk"))
    return re.sub(r"(.)\1+", r"\1", re.sub(r"([^\W_])[aeiou]+", r"\1", word))


class Lexicon:
    """All phrase lists in one automaton; own are a deployment's slurs, words or phrases."""

    def __init__(self, own: tuple[str, ...] = ()):
        self.machine = ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        lists = {k: L.phrases(k) for k in L.PATTERNS} | {"slur": (*L.phrases("slur"), *own)}
        for kind, phrases in [*lists.items(), *((f"native {k}", L.native(k)) for k in L.NATIVE_PATTERNS)]:
            for phrase in phrases:
                key = key_of(phrase)
                if key.strip():
                    kinds.setdefault(key, []).append((kind, phrase))
        for key, found in kinds.items():
            self.machine.add_word(key, (len(key), found))
        self.machine.make_automaton()
        single = [w for w in own if " " not in w]
        self.insults = dict.fromkeys(L.MILD, 0.74) | dict.fromkeys(L.STRONG, 0.90) | dict.fromkeys(L.INDIC, 0.94)
        self.starred = dict.fromkeys(L.STRONG, 0.90) | dict.fromkeys(single, 0.97)
        self.skeletons = {skeleton(w): w for w in (*L.INDIC, *L.STRONG) if len(skeleton(w)) >= 4}

    def hits(self, words: list[str], starts: list[int], ends: list[int]) -> list[Hit]:
        """Every occurrence of every phrase, by place."""
        at, places = 1, []
        for w in words:
            places.append(at)
            at += len(w) + 1
        out = []
        for end, (size, found) in self.machine.iter(" " + " ".join(words) + " "):
            i = bisect_left(places, end - size + 2)
            j = bisect_right(places, end - 1) - 1
            out += [Hit(kind, phrase, i, j, starts[i], ends[j]) for kind, phrase in found]
        return sorted(out, key=lambda h: (h.low, h.high, h.kind, h.phrase))


@cache
def lexicon(own: tuple[str, ...] = ()) -> Lexicon:
    return Lexicon(own)


def threatens(hit: Hit, words: list[str]) -> bool:
    """Whether the phrase stands where it threatens: someone who acts in the words before, no denial right before it; a visit that is offered there, or that a service around it explains, is none."""
    if hit.kind in ("threat", "native threat"):
        return True
    before = words[max(0, hit.first - BEFORE) : hit.first]
    if not AGENTS.intersection(before) or NOT.intersection(before[-2:]):
        return False
    if hit.kind == "visit":
        return not (OFFERS.intersection(before) or SERVICE.intersection(words[max(0, hit.first - 3 * NEAR) : hit.last + 1 + 3 * NEAR]))
    return True


def demands(hits: list[Hit], text: str) -> tuple[str, list[tuple[float, str]]]:
    """(lever, findings): what a text leans on, and its demands that lean on something illegitimate within reach: on a condition, or else on a demanding phrase."""
    levers = sorted(h.low for h in hits if h.kind == "illegitimate")
    kind = "illegitimate" if levers else "lawful" if any(h.kind == "lawful" for h in hits) else "unknown"
    if not levers:
        return kind, []

    def leans(low: int, high: int) -> bool:
        i = bisect_left(levers, low - REACH)
        return i < len(levers) and levers[i] <= high + REACH

    hard = [(0.88, m[0]) for m in re.finditer(A.CONDITIONAL, text) if leans(*m.span())] + [(0.88, h.phrase) for h in hits if h.kind == "native demand" and leans(h.low, h.high)]
    return kind, hard or [(0.78, h.phrase) for h in hits if h.kind == "demand" and leans(h.low, h.high)]


GROUP, EXCLUDED = re.compile(N.any_of(A.PROTECTED)), re.compile(A.EXCLUSION)


def excluded(text: str) -> str | None:
    """An exclusion within 24 code points of a protected group."""
    refusals = [m.span() for m in EXCLUDED.finditer(text)] if (groups := [m.span() for m in GROUP.finditer(text)]) else []
    starts = [a for a, _ in refusals]
    for low, high in groups:
        for k in (bisect_left(starts, low) - 1, bisect_left(starts, low)):
            if 0 <= k < len(refusals) and max(low, refusals[k][0]) - min(high, refusals[k][1]) <= 24:
                return text[min(low, refusals[k][0]) : max(high, refusals[k][1])]
    return None


def judged(text: str | None, lex: Lexicon) -> tuple[str, list[tuple[str, float, str]]]:
    """(lever, findings in the order of the rules): the first of each rule that holds where it stands."""
    if not text:
        return "unknown", []
    words, starts, ends = words_of(text)
    hits = lex.hits(words, starts, ends)
    of = lambda *kinds: [h.phrase for h in hits if h.kind in kinds]
    people = [i for i, w in enumerate(words) if w in PEOPLE]

    def said_to_person(i: int) -> bool:
        k = bisect_left(people, i - NEAR)
        return k < len(people) and people[k] <= i + NEAR

    insults = [(lex.insults[w], w) for i, w in enumerate(words) if w in lex.insults and said_to_person(i)]
    stars = [(c, w) for s in (STARRED.findall(text) if any(c in text for c in "*#_") else ()) for w, c in lex.starred.items() if len(w) == len(s) and re.fullmatch(re.sub("[*#_]", ".", s), w) and (c > 0.9 or people)]
    alike = [(0.94, lex.skeletons[s]) for w in words if people and w not in L.MILD and (s := skeleton(w)) in lex.skeletons]
    rude = [*((0.97, p) for p in of("slur")), *(x for x in stars if x[0] > 0.9), *sorted(insults, key=lambda x: -x[0]), *(x for x in stars if x[0] <= 0.9)] or alike
    lever, asked = demands(hits, text)
    rules = [
        ("discrimination", [(0.88, x)] if (x := excluded(text)) else []), ("harassment", rude), ("selfHarm", [(0.90, p) for p in of("selfHarm", "native selfHarm")]),
        ("threat", [(0.93, h.phrase) for h in hits if h.kind in ("threat", "threat by agent", "visit", "native threat") and threatens(h, words)]), ("sexual", [(0.88, p) for p in of("sexual", "native sexual")]),
        ("harassment", [(0.74, p) for p in of("native harassment", *(["harassment by target"] if people else []))]), ("scam", [(0.82, p) for p in of("scam", "native scam")]), ("coercion", asked),
    ]
    found: dict[str, tuple[str, float, str]] = {}
    for category, hits_of in rules:
        if hits_of:
            found.setdefault(category, (category, *hits_of[0]))
    return lever, list(found.values())


def judgements(base: Column, own: list[str] | None = None) -> Column:
    """(lever, findings) of base texts."""
    words = tuple(own or ())

    @F.pandas_udf(JUDGED)
    def run(texts: pd.Series) -> pd.DataFrame:
        lex = lexicon(words)
        return pd.DataFrame([judged(t, lex) for t in texts], columns=["lever", "findings"])

    return run(base)


def matches(text: Column, own: list[str] | None = None) -> Column:
    """Every occurrence of every phrase of the lists in a folded text, with its place in code points."""
    words = tuple(own or ())

    @F.pandas_udf(MATCH)
    def run(texts: pd.Series) -> pd.Series:
        lex = lexicon(words)
        return pd.Series([[(h.kind, h.phrase, h.low, h.high) for h in lex.hits(*words_of(t))] if t else [] for t in texts], dtype=object)

    return run(text)
