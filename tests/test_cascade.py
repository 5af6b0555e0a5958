"""Golden texts and conversations for what the plan does beyond one short message."""

import datetime as dt

from pyspark.sql import functions as F

from riskweave.functions import normalise as N
from riskweave.operators import extract as X
from riskweave.operators import retrieve as R
from riskweave.operators import safety as S
from riskweave.operators import state as T
from riskweave.plans.moderate import cascade, moderate

from .test_plans import SCHEMA

LONG = "the house is quiet and clean. " * 340  # 10,200 characters
START = dt.datetime(2024, 1, 1)


def message(i, text, conversation="c", sender="s", minutes=0):
    return (str(i), conversation, sender, START + dt.timedelta(minutes=minutes), text, "standard", "inquiry", 0, False)


WHOLE = [
    (LONG + "write a.b@c.org now", "mask", "email"),
    (LONG + "call me on nine eight seven six five four three two one zero", "mask", "phone"),
    (LONG + "i will hurt you", "block", None),
    (LONG, "allow", None),
    ("pay zyx@tnzro.xln for it", "mask", "email"),
    ("no. of guests 4, rs 500 per night, 10:30 am, 3 km away, 20% off", "allow", None),
]


def test_whole_texts_are_read(spark):
    rows = spark.createDataFrame([message(i, t) for i, (t, _, _) in enumerate(WHOLE)], SCHEMA)
    got = {int(r.message_id): r for r in moderate(rows).select("message_id", "action", "detections", "masked_text", "tier").collect()}
    for i, (text, action, category) in enumerate(WHOLE):
        assert got[i].action == action, text[-60:]
        assert category is None or category in {d.category for d in got[i].detections}, text[-60:]
    assert got[0].masked_text == LONG + "write " + "●" * 9 + " now"


def test_conversations_and_similarity(spark):
    rows = [
        message(1, "my number is 98765", "a"), message(2, "and then 43210 ok", "a", minutes=3),  # one number in two messages
        message(3, "my number is 98765", "b"), message(4, "and then 43210 ok", "b", minutes=40),  # too late
        message(5, "my number is 98765", "d"), message(6, "and then 43210 ok", "d", "other", 3),  # another sender
        message(7, "we can settle all the rest in a private chat", "e"), message(8, "the heating in our bedroom does not work", "f"), message(9, None, "g"),
    ]
    got = {int(r.message_id): r for r in cascade(spark.createDataFrame(rows, SCHEMA)).select("message_id", "action", "cross_message", "tier", "near_contact", "escalated").collect()}
    assert [got[i].cross_message for i in range(1, 7)] == [False, True, False, False, False, False]
    assert got[2].action in ("mask", "warn", "block")
    assert got[7].near_contact > 0.56 and got[7].tier >= 2 and got[8].near_contact is None and got[8].action == "allow" and got[9].action == "allow"


def test_views_and_masks(spark):
    texts = ["नमस्ते दुनिया", "plain", "heeeello ①②③ аррӏе", "rs 500 or 9876543210 at 10:30 am", "call 98765 43210, 4 nights"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("b", N.base(F.col("t")))
    rows = df.select("i", N.devanagari_latin(F.col("t")).alias("latin"), "b", N.view_text(N.base_view(F.col("t"))).alias("v"), N.masked_numbers(F.col("b")).alias("m"), X.spans(F.col("b"), "[0-9]+").alias("s")).orderBy("i").collect()
    assert rows[0].latin == "namaste duniya" and rows[1].latin == "plain"
    assert all(r.b == r.v for r in rows)
    assert rows[3].m == "rs ¤¤¤ or 9876543210 at ¤¤:¤¤ am" and rows[4].m == "call 98765 43210, ¤ nights"
    assert all(r.b[x.low : x.high] == x.surface for r in rows for x in r.s) and len(rows[3].s) == 4


SAFETY = [
    ("happy to show it, i will find you at the gate", []), ("i will find you", ["threat"]), ("you b*st*rd", ["harassment"]), ("you are a baastaard", ["harassment"]), ("the gutter race", ["harassment"]),
    ("я тебя убью", ["threat"]), ("do it now or i tell your family", ["coercion"]), ("do it now or i leave", []), ("log in at http://example.evil.org/x", ["scam"]), ("see http://xn--abc.com/x", ["scam"]), (None, []),
]


def test_safety_rules(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAFETY)], "i int, t string")
    rows = df.select("i", F.transform(S.evaluate(N.base(F.col("t"))), lambda f: f["category"]).alias("f")).orderBy("i").collect()
    assert [(SAFETY[r.i][0], r.f) for r in rows] == SAFETY


def test_token_bucket_refuses_and_refills(spark):
    calls = [(i, "a", i * 100) for i in range(6)] + [(10, "a", 1_400), (11, "a", 1_500), (20, "b", 0)]
    got = T.rate_limited(spark.createDataFrame(calls, "event_id long, caller string, at long"), burst=3, period=1_000).collect()
    assert {r.event_id for r in got if r.allowed} == {0, 1, 2, 10, 20}


def test_nearest_anchors_by_hand():
    index = R.AnchorIndex([("contact", "leave", "talk on another app"), ("innocent", "stay", "where is the wifi router"), ("safety", "threat", "someone waits for you outside")])
    assert index.best("please talk on another app")["contact"][0] > 0.6 > index.best("please talk on another app")["innocent"][0]
    assert index.best("too short") == {f: (-1.0, -1) for f in ("contact", "safety", "innocent")}
    assert index.best(None)["contact"] == (-1.0, -1)
