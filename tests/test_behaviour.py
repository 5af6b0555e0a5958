"""Sequences of messages: a sender whose suspicious messages pass is blocked with the next one."""

from pyspark.sql import functions as F

from riskweave.operators import abuse as B
from riskweave.plans.moderate import behavioural, cascade, moderate

from .test_cascade import START, message
from .test_plans import SCHEMA

ODD = "answer me or else it ends here"


def rows_of(spark):
    rows = [message(i, ODD, "a", minutes=i) for i in range(1, 6)]  # the fourth and fifth
    rows += [message(10 + i, ODD, f"b{i}", "t", i) for i in range(5)]  # never in one conversation
    rows += [message(20 + i, ODD, "d", "u", i * 600) for i in range(5)]  # too slow
    rows += [message(30 + i, ODD, "e", "v", i) for i in range(3)] + [message(33, "pay me or else i file a complaint", "e", "v", 4), message(34, "the weather is nice", "e", "v", 5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_the_fourth_suspicious_message_is_blocked(spark):
    verdicts = moderate(rows_of(spark)).select("message_id", "conversation_id", "sender_id", "ts", "text", "advisory", "action", "lever", "suspicions", "routes", "behavioural", "escalated", "masked_text").cache()
    got = {int(r.message_id): r for r in behavioural(verdicts).collect()}
    assert {i for i, r in got.items() if r.action == "block"} == {4, 5} == {i for i, r in got.items() if r.behavioural}
    assert got[4].masked_text == "●" * 10 and got[34].escalated and got[34].action == "allow"
    said = spark.createDataFrame([("x", "v", "report", START)], "conversation_id string, sender_id string, kind string, ts timestamp")
    got = {int(r.message_id): r for r in behavioural(verdicts, said).collect()}
    assert {i for i, r in got.items() if r.action == "block"} == {4, 5, 32} and len(got) == 20


def test_cascade_takes_a_router(spark):
    labelled = [(i, "you are a useless liar and a cheat" if i % 2 else "the room was clean and quiet", float(i % 2)) for i in range(20)]
    model = B.train(spark.createDataFrame(labelled, "doc_id long, text string, label double"))
    rows = spark.createDataFrame([message(1, "you are a useless liar"), message(2, "the room was quiet"), (None, *message(3, None)[1:])], SCHEMA)
    got = {r.message_id: r.abuse for r in cascade(rows, router=model).select("message_id", "abuse", F.col("action")).collect()}
    assert len(got) == 3 and got["1"] > got["2"]
