"""The decision store's life cycle, percentiles as a stream, and details that were missed."""

import datetime as dt
import random

from pyspark.sql import functions as F

from riskweave.functions import normalise as N
from riskweave.operators import extract as X
from riskweave.operators import metrics as M
from riskweave.operators import route as R
from riskweave.operators import state as T
from riskweave.sources import sinks as K
from riskweave.streaming import metrics as Q

DECIDED, START = "message_id string, action string, ts timestamp", dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_reserved_finalised_and_delivered(spark, tmp_path):
    path, sent = f"file://{tmp_path}/decided", f"file://{tmp_path}/sent"
    rows = lambda *r: spark.createDataFrame(list(r), DECIDED)
    K.commit_if_absent(rows(), path, ["ts"])  # an empty first commit
    got = K.finalize(rows(("a", "mask", at(1)), ("b", "allow", at(2))), path, ["ts"])
    assert {(r.message_id, r.action) for r in got.collect()} == {("a", "mask"), ("b", "allow")}
    got = K.finalize(rows(("a", "block", at(3)), ("c", "warn", at(4))), path, ["ts"])  # another writer was first
    assert got.columns == DECIDED.replace(" string", "").replace(" timestamp", "").split(", ")
    assert {(r.message_id, r.action) for r in got.collect()} == {("a", "mask"), ("c", "warn")}
    stored = spark.read.parquet(path).drop("key_part")
    calls = spark.createDataFrame([("a", 100), ("d", 100), ("e", 100)], "message_id string, at long")
    held = spark.createDataFrame([("a", 99), ("d", 99)], "message_id string, reserved_at long")
    assert {r.message_id for r in T.reservable(calls, stored, held, "message_id", ["at"], "at", 50).collect()} == {"e"}
    events = K.outbox(stored.withColumns({"reasons": F.lit("x"), "policy_version": F.lit("1")}))
    assert [r.event_id for r in K.pending(events, K.delivered(spark, sent)).collect()] == ["a", "b", "c"]
    notes = spark.createDataFrame([("a", at(10)), ("b", at(10))], "event_id string, delivered_at timestamp")
    K.mark_delivered(notes, sent)
    K.mark_delivered(notes.withColumn("delivered_at", F.col("delivered_at") + F.expr("interval 1 hour")), sent)
    assert [r.event_id for r in K.pending(events, K.delivered(spark, sent)).collect()] == ["c"]
    assert {r.delivered_at for r in K.delivered(spark, sent).collect()} == {at(10)}
    assert [r.event_id for r in K.events_since(events, F.lit(at(2))).collect()] == ["b", "c"]


def test_latest_percentiles_as_a_stream(spark, tmp_path):
    pick = random.Random(4)
    rows = [("hot" if i % 3 else pick.choice(["a", "b", None]), pick.randrange(10_000), float(pick.randrange(500)) if i % 50 else None) for i in range(900)]
    schema, folder = "route string, n_call long, seconds double", tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[300 * k : 300 * k + 300], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
    out = Q.percentiles_stream(stream, F.col("route"), F.col("n_call"), F.col("seconds"), [0.5, 0.95], keep=64)
    seen = []
    query = out.writeStream.outputMode("update").foreachBatch(lambda b, i: seen.append({r.name: tuple(r) for r in b.collect()})).trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    query.awaitTermination(200)
    last = {}
    for part in seen:
        last |= part
    assert len(seen) == 3
    for name in ("hot", "a", "b", None):
        kept = sorted((n, s) for r, n, s in rows if r == name and s is not None)[-64:]
        values = sorted(s for _, s in kept)
        assert last[name] == (name, len(kept), values[len(kept) // 2], values[int(len(kept) * 0.95)])
    hot = spark.createDataFrame(rows, schema).filter("route = 'hot' and seconds is not null").withColumn("place", F.col("n_call") * 1000 + F.col("seconds").cast("long"))
    batch = M.latest_percentiles(hot, "seconds", "place", [0.5, 0.95], keep=64).first()
    assert last["hot"][2:] == (batch.p50, batch.p95)


def test_numbers_in_groups_and_handles(spark):
    texts = ["call 9,876,543,210 now", "my whatsapp is 987 654 3210", "my insta is 98abc_1", "it costs 1,50,000, call 9876543210", "it costs 9,87,65,43,210 rupees"]
    base = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("b", N.base(F.col("t")))
    mobile = F.array_contains(R.suspicions(F.col("b"), F.col("t"), F.lit(False), F.lit(-1.0), F.lit(0.0), F.lit(-1.0), F.lit(0.0)), "contiguousMobile")
    got = base.select("i", F.transform(X.phones(F.col("b")), lambda d: d["surface"]).alias("p"), F.transform(X.handles(F.col("b")), lambda d: d["surface"]).alias("h"), mobile.alias("m")).orderBy("i").collect()
    assert got[0].p == ["9876543210"] and got[1].p == ["9876543210"] and got[1].h == [] and got[2].h == ["98abc_1"]
    assert got[3].m and not got[4].m and "9876543210" in got[3].p


def test_equal_confidences_have_one_judgement(spark):
    decisions = spark.createDataFrame([("1", "allow", 0.2, [], [], "some words")], "message_id string, action string, score double, detections array<struct<category:string,confidence:double>>, suspicions array<string>, window_text string")
    said = [("some words", "benign", None, 0.9), ("Some words!", "safety_violation", "threat", 0.9)]
    for rows in (said, said[::-1]):
        judgements = spark.createDataFrame(rows, "window_text string, decision string, category string, confidence double")
        assert [r.judgement for r in R.adjudicated(decisions, judgements).collect()] == ["safety_violation"]
