"""The lexicon automaton and the places of details, against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from riskweave import lexicons as L
from riskweave.functions import normalise as N
from riskweave.operators import extract as X
from riskweave.operators import lexicon as K
from riskweave.operators import safety as S
from riskweave.plans.moderate import decisions, moderate

from .test_cascade import message
from .test_plans import SCHEMA


def test_patterns():
    assert L.choices("a {b|c{d|}} e") == ["a b e", "a cd e", "a c e"] and L.choices("x") == ["x"]
    assert sum(len(L.phrases(k)) for k in L.PATTERNS) > 5000


def plain_hits(text, lists):
    """Every phrase at every word, by comparing words."""
    folded = "".join(" " if c == "\0" else c for c in text)
    words = [(m[0].replace("'", ""), m.start(), m.end()) for m in re.finditer(r"(?:[^\W_]|')+", folded) if m[0].strip("'")]
    out = []
    for kind, phrase in lists:
        key = K.key_of(phrase).split()
        for i in range(len(words) - len(key) + 1):
            if [w for w, _, _ in words[i : i + len(key)]] == key:
                out.append((kind, phrase, words[i][1], words[i + len(key) - 1][2]))
    return sorted(out, key=lambda h: (h[2], h[3], h[0], h[1]))


def test_hits_equal_plain_search():
    rnd = random.Random(1)
    lists = [(k, p) for k in L.PATTERNS for p in L.phrases(k)]
    lex = K.lexicon()
    for _ in range(12):
        parts = [rnd.choice([rnd.choice(lists)[1], "house", "you", "kill", "don't", "the,", "your -- kids"]) for _ in range(60)]
        text = rnd.choice([" ", ", ", ". "]).join(parts)
        got = [(h.kind, h.phrase, h.low, h.high) for h in lex.hits(*K.words_of(text)) if not h.kind.startswith("native")]
        assert got == plain_hits(text, lists)


JUDGED = [
    ("i will kill you", "threat"), ("you should kill yourself", "threat"), ("i will burn your house", "threat"), ("he said he would never hurt you", None), ("i will never hurt you", None), ("we come to your house to repair the boiler", None),
    ("i will find you, can i say watch your back", "threat"), ("can i come to your house, but i know where you live", "threat"), ("happy to find you a room, now i will find you and beat you up", "threat"), ("send me the otp code", "scam"), ("you fucker", "harassment"), ("you're a cunt", "harassment"), ("the fucker of a lamp broke and it is dark in here now", None),
    ("refund me or else i leave a bad review", None), ("refund me or else i leave fake reviews", "coercion"), ("or else " + "nothing much " * 80 + "i leak your things", "coercion"), ("or else " + "x " * 1000 + "i leak your things", "coercion"), ("or else " + "x " * 9000 + "i leak your things", None),
    ("women are vermin", "harassment"), ("no muslims please", "discrimination"), ("no pets, but muslims are welcome to ask for a quiet room", "discrimination"), ("no pets at all in this house, as my wife is allergic; muslims welcome", None), ("मैं तुम्हें मार दूंगा", "threat"), ("не хочу жить", "selfHarm"), ("the weather is nice", None), ("", None), (None, None),
]


def test_each_occurrence_is_judged_where_it_stands(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(JUDGED)], "i int, t string")
    rows = df.select("i", F.transform(S.evaluate(N.base(F.col("t"))), lambda f: f["category"]).alias("f")).collect()
    got = {r.i: r.f for r in rows}
    assert [(t, c) for i, (t, c) in enumerate(JUDGED) if (got[i] != [c] if c else got[i])] == []


def test_own_words_count(spark):
    df = spark.createDataFrame([("such a zorkling",), ("such a z*rkl*ng",), ("zorkling hill people",)], "t string")
    got = [[f.confidence for f in r.f] for r in df.select(S.evaluate(F.col("t"), ["zorkling"]).alias("f")).collect()]
    assert got == [[0.97], [0.97], [0.97]]


def test_plan_does_not_grow_with_the_list(spark):
    df = spark.createDataFrame([("x",)], "t string")
    size = lambda own: len(df.select(S.evaluate(F.col("t"), own))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(["a"]) - size([f"word{i}" for i in range(5000)])) < 50


def test_skeletons_equal_the_expression(spark):
    words = [w for w in (*L.STRONG, *L.INDIC, *L.MILD)] + ["baastaard", "phhone", "aab", "ookk"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.s for r in df.select(N.skeleton(F.col("w")).alias("s")).collect()] == [K.skeleton(w) for w in words]


MASKED = [
    ("call 98765 43210 and 98765 43210", "call ●●●●●●●●●● and ●●●●●●●●●●"), ("mail a.b@c.org or A.B@C.ORG, not xa.b@c.org", None), ("refund me or else i tell your family", "●" * 10), ("write a.b@c.org", "write " + "●" * 9), ("the house is quiet", None),
]


def test_masked_text_keeps_no_detail(spark):
    rows = spark.createDataFrame([message(i, t) for i, (t, _) in enumerate(MASKED)], SCHEMA)
    got = {int(r.message_id): r for r in decisions(moderate(rows)).select("message_id", "action", "masked_text").collect()}
    for i, (text, masked) in enumerate(MASKED):
        if masked:
            assert got[i].masked_text == masked, text
    assert "c.org" not in got[1].masked_text.lower() and got[4].masked_text is None


def plain_places(surface, view):
    return [i for i in range(len(view)) if view.startswith(surface, i)]


def test_places_and_sweep_equal_plain_search():
    rnd = random.Random(2)
    for _ in range(300):
        view = "".join(rnd.choice("ab1 ") for _ in range(40))
        part = "".join(rnd.choice("ab1") for _ in range(rnd.choice([1, 2, 3])))
        got = X.places(part, False, view, list(range(40)), view)
        for i in plain_places(part, view):
            assert any(low <= i and i + len(part) <= high and (low == 0 or view[low - 1] == " ") and (high == 40 or view[high] == " ") for low, high in got)
        found = [(rnd.choice("xy"), "s", rnd.choice([0.5, 0.6]), 0, a := rnd.randrange(20), a + rnd.randrange(1, 8)) for _ in range(rnd.randrange(1, 12))]
        kept = X.swept(found)
        inside = lambda a, b: a[0] == b[0] and b[4] <= a[4] and a[5] <= b[5]
        better = lambda a, b: (a[2], a[5] - a[4]) >= (b[2], b[5] - b[4])
        assert kept == [k for k in sorted(set(found), key=lambda d: (d[4], d[5], d[0], d[1])) if not any(o != k and inside(k, o) and better(o, k) for o in set(found))]


@pytest.mark.parametrize("text", ["98765 43210", "9 8 7 6 5 4 3 2 1 0"])
def test_phones_with_letters_between_only_where_nothing_else(text):
    view = f"98765 apples 43210 then {text}"
    assert X.places("9876543210", True, view, list(range(len(view))), view) == [(24, len(view))]
