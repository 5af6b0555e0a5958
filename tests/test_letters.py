"""The letter model: planted shifts and carriers are found, prose is left alone, scores equal plain sums."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskweave import schema
from riskweave.operators import letters as LT
from riskweave.plans.moderate import moderate

PROSE = """the house by the lake has a small garden and two quiet rooms with a view of the water. we came in the morning and the host had left fresh bread on the table. my brother told
me that the road along the river is the better way to reach the village before noon. please write to us when you know at what time your train will arrive. nine people were at
the table and seven of them had never seen the sea. the kitchen is large enough for eight guests and there are five chairs near the window. one or two of the neighbours may
come by to say hello. four of the six beds are in the front room. three keys hang behind the door. it was zero degrees when we went out after breakfast to walk through the old town.
a message for the manager is on the desk. whoever takes the last key should lock the gate and turn off the light. contact the office for a receipt and reach for the phone only at night."""


#: How often the prose is given to the model, so that pairs it lacks are rare.
TIMES = 200


@pytest.fixture(scope="module")
def model(spark):
    rows = [(s.strip(),) for s in PROSE.split(".")] * TIMES + [(None,), ("",), ("é",)]
    return LT.fit(spark.createDataFrame(rows, "t string"), "t")


def test_model_equals_plain_counts(model):
    pairs = Counter(t[i : i + 2] for t in PROSE.split(".") for i in range(len(t.strip()) - 1) for t in [t.strip()] if t[i : i + 2].isalpha())
    pairs = Counter({p: n * TIMES for p, n in pairs.items()})
    for a in LT.LETTERS:
        row = sum(n for p, n in pairs.items() if p[0] == a)
        assert list(model.pairs[LT.LETTERS.index(a)]) == [round(256 * math.log2((pairs[a + b] + 1) / (row + 26))) for b in LT.LETTERS]


def test_shifts_equal_plain_scores(spark, model):
    rng = random.Random(3)
    texts = [LT.moved(" ".join(rng.choices(PROSE.replace(".", "").split(), k=rng.randint(1, 12))), rng.randint(0, 26)) for _ in range(200)] + ["", "a", "é 12", None, "ab" * 20000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", "t", LT.unshifted(F.col("t"), model).alias("r")).orderBy("i").collect()

    def plain(text):
        at = [(LT.LETTERS.find(a), LT.LETTERS.find(b)) for a, b in zip(text, text[1:], strict=False)]
        return sum(model.pairs[a][b] for a, b in at if a >= 0 and b >= 0)

    for r in rows:
        if not r.t or not any(a.isascii() and b.isascii() and a.isalpha() and b.isalpha() for a, b in zip(r.t, r.t[1:], strict=False)):
            assert (r.r.shift, r.r.pairs, r.r.score) == (None, 0, None)
            continue
        each = [plain(LT.moved(r.t, k)) for k in range(27)]
        assert (r.r.shift, r.r.score, r.r.written, r.r.text) == (each.index(max(each)), max(each), each[0], LT.moved(r.t, each.index(max(each))))


def shifted(text, k):
    return LT.moved(text, (26 - k) % 26)


MESSAGES = [
    (shifted("nine eight seven six five four three two one zero", 13), "referentialContact", 0.80),
    (shifted("write to me on whatsapp after breakfast", 5), "referentialContact", 0.74),
    (LT.moved("reach me on telegram tonight please", LT.MIRROR), "referentialContact", 0.74),
    ("the house by the lake has a small garden", None, None),
    ("xqzv kjw pqx zzv wqk jxq", None, None),
    ("\n".join(f"{c.upper()} is the next" for c in "contactthemanager"), "referentialContact", 0.58),
    ("\n".join(f"{c.upper()} is the next" for c in "ctnaotcthetaamnre"), None, None),
]


def test_planted_messages_in_the_plan(spark, model):
    rows = [(str(i), "c", "s", datetime(2024, 1, 1), t, "standard", "inquiry", 0, False) for i, (t, _, _) in enumerate(MESSAGES)]
    messages = spark.createDataFrame(rows, schema.MESSAGE)
    with_model = {int(r.message_id): [(d.category, d.confidence) for d in r.detections] for r in moderate(messages, letters=model).select("message_id", "detections").collect()}
    for i, (text, category, confidence) in enumerate(MESSAGES):
        assert ((category, confidence) in with_model[i]) if category else with_model[i] == [], text


def test_initials_of_prose_seldom_spell(spark, model):
    rng = random.Random(1)
    words = PROSE.replace(".", " ").split()
    carriers = ["".join(rng.choice(words)[0] for _ in range(rng.randint(5, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([([c],) for c in carriers] + [([],), (None,), (["", "ab", "é1"],)], "c array<string>").select(LT.spelling(F.col("c"), model).alias("r"))
    assert rows.filter(LT.spells(F.col("r"))).count() <= 4000 / 2**LT.SPELLS + 4
    assert rows.filter("r.bits is null").count() == 3
