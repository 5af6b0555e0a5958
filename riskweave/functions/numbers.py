"""Number words as a grammar over classes of tokens, in one Arrow pass.

Every token has a class, and a class has its own rule, read from the classes of the tokens beside it (before any rule has been applied):

* ``core`` words, misread signs in them (``s1x``), ``glued`` ones (three and more core words on end inside a token, or a token of words and
  digits) always count;
* ``risky`` words, those of other languages, count beside any number, also a written one or a ``double``;
* ``homophone`` words, which mean something else too, count inside a dictation: beside a spelled number, or with a number on every side they have;
* ``fuzzy`` words, short words of grammar and those one edit or swap off a core word, count beside a spelled number;
* a ``modifier`` such as ``double`` repeats the next number if that has one digit, and goes.

The classes of a text are one string with a letter for each token, so each rule is one pattern over it. Defined results: null stays null; an empty
text gives an empty one; very long texts are read whole, in linear time.
"""

from __future__ import annotations

import re
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import assets as A

READ = "struct<text:string,numbers:array<struct<kind:string,digits:string>>>"
WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"[0-9]+")
KINDS = {"C": "core", "G": "glued", "R": "risky", "H": "homophone", "Z": "fuzzy", "M": "modifier", "D": "digits"}
#: Which tokens of a string of classes count; C, G and D always do.
COUNTS = re.compile(
    r"[CGD]|(?<=[CGRHZMD])R|R(?=[CGRHZMD])|(?<=[CGRHZ])[HZ]|[HZ](?=[CGRHZ])"
    r"|(?<=[MD])H(?=[MD])|(?<=[MD])H$|^H(?=[MD])"
)
LONGEST = max(map(len, A.CORE_NUMBERS))
#: Three core words on end.
THREE = re.compile("(?:" + "|".join(map(re.escape, A.CORE_NUMBERS)) + "){3}")
#: Words of this length and more are recognised with an error.
FUZZY_FROM = 4
UNLEET = str.maketrans({k: v for k, v in A.LEET.items() if k.isdigit()})


#: Every ASCII character but letters and digits, as a blank.
BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words(text: str) -> list[str]:
    """All WORDs of a text."""
    return text.translate(BLANKS).split() if text.isascii() else WORD.findall(text)


def split(token: str, digits: bool = False) -> tuple[int, int, int, str]:
    """(number of words, start, end, digits) of the stretch of a token with most core words on end, and single digits too if asked for; of several the longest, then the first."""
    best = (0, 0, 0, "")
    ending: list[tuple[int, int, str]] = [(0, i, "") for i in range(len(token) + 1)]  # words, start, digits of the best stretch that ends here
    for end in range(1, len(token) + 1):
        for low in range(max(0, end - LONGEST), end):
            value = A.CORE_NUMBERS.get(token[low:end])
            written = digits and end - low == 1 and token[low] in "0123456789"
            if value is None and not written:
                continue
            words, start, before = ending[low]
            found = (words + (not written), start, before + (token[low] if written else value))
            if (found[0], -found[1]) > (ending[end][0], -ending[end][1]):
                ending[end] = found
        words, start, value = ending[end]
        if words and (words, end - start) > (best[0], best[2] - best[1]):
            best = (words, start, end, value)
    return best


def glued(token: str) -> str | None:
    """The digits of a token of letters that holds three or more core words on end, or of six and more characters that is core words and digits only."""
    if token.isalpha():
        words, _, _, value = split(token) if len(token) >= 9 and THREE.search(token) else (0, 0, 0, "")
        return value if words >= 3 else None
    if len(token) < 6 or not re.fullmatch("[a-z0-9]+", token):
        return None
    words, start, end, value = split(token, digits=True)
    return value if words and (start, end) == (0, len(token)) else None


def near(token: str, word: str) -> bool:
    """Whether one inserted, deleted or replaced letter, or one swap of neighbours, parts two words."""
    short, long = sorted((token, word), key=len)
    if len(long) - len(short) > 1:
        return False
    at = next((i for i, (a, b) in enumerate(zip(short, long, strict=False)) if a != b), len(short))
    if len(long) > len(short):
        return short[at:] == long[at + 1 :]
    return short[at + 1 :] == long[at + 1 :] or (short[at + 2 :] == long[at + 2 :] and short[at : at + 2] == long[at : at + 2][::-1])


#: In misread(), any letter that no core word has.
OTHER = "?"


@cache
def misread() -> dict[str, str]:
    """Digits of all that near() holds for a core word of FUZZY_FROM letters and more, by the first such word."""
    letters = sorted({c for w in A.CORE_NUMBERS for c in w}) + [OTHER]
    out: dict[str, str] = {}
    for word, value in A.CORE_NUMBERS.items():
        if len(word) >= FUZZY_FROM:
            cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
            for a, b in cuts:
                found = [a + c + b for c in letters] + ([a + b[1:]] + [a + c + b[1:] for c in letters] if b else []) + ([a + b[1] + b[0] + b[2:]] if len(b) > 1 else [])
                for token in found:
                    out.setdefault(token, value)
    return out


@cache
def strange() -> re.Pattern:
    return re.compile("[^" + "".join(map(re.escape, sorted({c for w in A.CORE_NUMBERS for c in w}))) + "]")


@cache
def listed() -> dict[str, tuple[str, str]]:
    """Class and digits of every listed word; the first list that has a word decides."""
    out = {w: ("M", "") for w in A.REPEATS}
    for name, words in (("C", A.CORE_NUMBERS), ("R", A.RISKY_NUMBERS), ("H", A.HOMOPHONES), ("Z", A.FUNCTION_NUMBERS)):
        for word, value in words.items():
            out.setdefault(word, (name, value))
    return out


@lru_cache(1 << 16)
def classified(token: str) -> tuple[str, str]:
    """(class, digits) of a token; other words are W."""
    if DIGITS.fullmatch(token):
        return "D", token
    if token in listed():
        return listed()[token]
    if not token.isalpha() and (value := A.CORE_NUMBERS.get(token.translate(UNLEET))):
        return "C", value
    if len(token) >= FUZZY_FROM and token.isalpha() and token not in A.NEAR_NUMBERS:
        if len(token) <= LONGEST + 1 and (value := misread().get(strange().sub(OTHER, token))) is not None:
            return "Z", value
    value = glued(token)
    return ("G", value) if value else ("W", "")


def read_numbers(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with numbers as digits, without what parts them, other words between blanks; and the numbers as (kind, digits)."""
    tokens = words(text)
    found = [classified(t) if len(t) <= 1000 else ("D", t) if DIGITS.fullmatch(t) else ("G", v) if (v := glued(t)) else ("W", "") for t in tokens]
    classes = "".join([c for c, _ in found])
    if tokens and not classes.strip("W"):
        return f" {'  '.join(tokens)} ", []
    value: list[str | None] = [None] * len(tokens)
    for hit in COUNTS.finditer(classes):
        value[hit.start()] = found[hit.start()][1]
    for i, name in enumerate(classes[:-1]):
        if name == "M" and value[i + 1] is not None and len(value[i + 1]) == 1:
            value[i], value[i + 1] = "", value[i + 1] * A.REPEATS[tokens[i]]
    written = "".join(f" {t} " if v is None else v for t, v in zip(tokens, value, strict=True))
    return written, [(KINDS[c], v) for c, v in zip(classes, value, strict=True) if v is not None]


def _read(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else read_numbers(t) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "numbers": [r[1] for r in rows]}, dtype=object)


def numbers(text: Column) -> Column:
    """struct<text, numbers: array<struct<kind, digits>>> of a base text, a column of the rows (not of a lambda)."""
    return F.pandas_udf(_read, READ)(text)


def spelled(read: Column) -> Column:
    """Whether what numbers() read has other numbers than written ones."""
    return F.exists(read["numbers"], lambda n: n["kind"] != "digits")
