"""The conversation buffer as a stream against a plain replay, and a run that starts from a stored buffer."""

import datetime as dt
import random
import re

import pytest

from riskweave.streaming import buffers as B

START = dt.datetime(2024, 1, 1)
DIGITS = re.compile("[0-9]")


def hit(texts):
    return 10 <= sum(len(DIGITS.findall(t)) for t in texts) <= 14


def withheld(text):
    return len(DIGITS.findall(text)) >= 10


def stream_of(seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(120):
        text = rnd.choice(["98765", "43210 ok", "hello", "9876543210", "", None, "12"])
        out.append((f"c{rnd.randrange(3)}", rnd.choice("st"), f"{i:03}", START + dt.timedelta(minutes=3 * i // 2), text))
    return out


def replayed(rows, held=None):
    held, out = dict(held or {}), []
    for c, s, m, ts, text in rows:
        at = int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        before = [(t, x) for t, x in held.get((c, s), []) if t >= at - B.QUARTER]
        text = text or ""
        found = not withheld(text) and bool(before) and hit([x for _, x in before] + [text])
        out.append((c, s, m, at, text, [x for _, x in before], found))
        if not withheld(text):
            held[c, s] = [] if found else [*before, (at, text)][-B.DEPTH :]
    return sorted(out), held


@pytest.fixture
def rocks(spark):
    needed = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for key, value in needed.items():
        spark.conf.set(key, value)
    yield spark
    for key in needed:
        spark.conf.unset(key)


def run(spark, path, name, parts, stored=None):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, "conversation_id string, sender_id string, message_id string, ts timestamp, text string").coalesce(1).write.parquet(f"file://{path}/{name}/{k}")
    stream = spark.readStream.schema("conversation_id string, sender_id string, message_id string, ts timestamp, text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{path}/{name}")
    query = B.buffered(stream, hit, withheld, stored).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{path}/{name}-cp").start()
    query.awaitTermination(150)
    assert query.exception() is None
    return sorted((r.conversation_id, r.sender_id, r.message_id, r.at, r.text, list(r.buffer), r.hit) for r in spark.table(name).collect())


def test_stream_equals_replay_also_from_stored_buffers(rocks, tmp_path):
    rows = stream_of()
    want, _ = replayed(rows)
    assert any(r[6] for r in want)
    assert run(rocks, tmp_path, "all_at_once", [rows[:50], rows[50:]]) == want
    first, held = replayed(rows[:50])
    stored = rocks.createDataFrame([(c, s, t, x) for (c, s), texts in held.items() for t, x in texts], B.STORED)
    assert sorted(first + run(rocks, tmp_path, "restarted", [rows[50:]], stored)) == want
