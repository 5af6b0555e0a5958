"""Sliding sums of keyed events against the plain definition."""

import random

from pyspark.sql import functions as F

from riskweave.operators import state as T
from riskweave.streaming import actors

SCHEMA = "event_id long, sender string, conversation string, kind string, routed boolean, acted boolean, at long"


def made(seed, n):
    """Events with ties, gaps of exactly a day and a microsecond more, null keys, kinds and times, and a sender with half of all."""
    pick, rows = random.Random(seed), []
    times = [T.DAY * k // 4 + e for k in range(-9, 14) for e in (-1, 0, 0, 1)]
    for i in range(n):
        sender = "hot" if i % 2 else pick.choice(["a", "b", None])
        rows.append((i, sender, pick.choice(["x", "y", "z", None]), pick.choice(["message"] * 5 + ["report", "block", None]), pick.choice([True, False, None]), pick.choice([True, False, None]), pick.choice(times) if i % 11 else None))
    return rows


def plain(rows):
    out = {}
    for i, sender, conversation, _, _, _, at in rows:
        near = [r for r in rows if r[1] == sender and ((at is None and r[6] is None) or (at is not None and r[6] is not None and at - T.DAY <= r[6] <= at))]
        said = [r for r in near if r[3] == "message"]
        here = [r for r in said if r[2] == conversation]
        out[i] = (len(said), len({r[2] for r in said} - {None}), sum(r[3] == "report" for r in near), sum(r[3] == "block" for r in near), len(here), sum(bool(r[4] and r[5] is False) for r in here))
    return out


NAMES = ["messages", "conversations", "reports", "blocks", "repeat_target", "sub_threshold"]


def test_risk_equals_the_definition(spark):
    for seed, n in ((1, 400), (2, 60), (3, 0)):
        rows = made(seed, n)
        events = spark.createDataFrame(rows, SCHEMA).withColumns({"row": F.lit(1), "t": F.lit("kept"), "s0": F.lit(2), "messages": F.lit(-1)})  # names of its own are kept or replaced
        got = {r.event_id: r for r in T.actor_risk(events).collect()}
        assert {i: tuple(r[c] for c in NAMES) for i, r in got.items()} == plain(rows)
        assert all(r.row == 1 and r.t == "kept" and r.s0 == 2 for r in got.values())


def test_a_hot_sender_is_dealt_by_time(spark):
    events = spark.createDataFrame([(i, "hot", "x", "message", True, False, i * T.DAY // 8) for i in range(400)], SCHEMA)
    plan = T.sliding(events, ["sender"], {"n": F.lit(1)})._jdf.queryExecution().toString()
    assert "Window [sum(s0" in plan and "stretch" in plan and plan.count("Exchange hashpartitioning") <= 1


def test_a_row_is_shuffled_as_two_without_columns_that_nobody_reads(spark):
    plan = T.actor_risk(spark.createDataFrame(made(7, 40), SCHEMA)).select("event_id", *NAMES)._jdf.queryExecution()
    dealt = plan.optimizedPlan().toString()
    assert dealt.count("Generate inline") == dealt.count("Generate ") == 1 and plan.executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert "struct(event_id" not in dealt and not any(f"{c}#" in line for line in dealt.split("Generate ")[0].splitlines()[:-2] for c in ("kind", "routed", "acted"))


def test_rows_without_values_and_of_null_parts(spark):
    day = T.DAY
    rows = [(1, "a", None, 1, 0), (2, "a", "x", 0, 1), (3, "a", "x", 2, 1), (4, "a", "x", 2, 1), (5, "a", None, None, day), (6, "a", "y", 3, day), (7, "a", "y", 0, 1 + day), (8, "a", "x", 0, 2 + day), (9, None, "x", 1, 2), (10, "a", "x", 5, None), (11, "a", "z", 0, None), (12, "a", "x", 0, 3 * day), (13, "a", "x", 1, -1)]
    events = spark.createDataFrame([*rows, rows[2]], "i long, k string, p string, v long, at long")
    out = T.sliding(events, ["k"], {"all": F.col("v")}, part="p", within={"here": "all", "rows": F.lit(1)}, parts={"some": "here"})

    def plain(r):
        near = [x for x in [*rows, rows[2]] if x[1] == r[1] and ((r[4] is None and x[4] is None) or (None not in (r[4], x[4]) and r[4] - day <= x[4] <= r[4]))]
        here = [x for x in near if x[2] == r[2]]
        return (*r, sum(x[3] or 0 for x in here), len(here), sum(x[3] or 0 for x in near), len({x[2] for x in near if x[3]} - {None}))

    assert out.columns == ["i", "k", "p", "v", "at", "here", "rows", "all", "some"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(plain, [*rows, rows[2]])))
    assert T.sliding(events.limit(0), ["k"], {"all": F.col("v")}, part="p", within={"here": "all"}, parts={"some": "here"}).count() == 0


class Held:
    """A state as applyInPandasWithState hands it over."""

    hasTimedOut, exists, get = False, False, None  # noqa: N815

    def update(self, value):
        self.get, self.exists = value, True

    def getCurrentWatermarkMs(self):  # noqa: N802
        return 0 if self.get is None else min(self.get[0]) // 1000

    def setTimeoutTimestamp(self, at):  # noqa: N802
        self.timeout = at


def test_stream_counts_as_the_definition_does():
    import pandas as pd

    rows = sorted((r for r in made(5, 300) if r[1] == "hot" and r[6] is not None), key=lambda r: r[6])
    want, state, got = plain(rows), Held(), {}
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    cut = [k for k in range(1, len(rows)) if rows[k][6] != rows[k - 1][6]]
    for low, high in zip([0, *cut[5::9]], [*cut[5::9], len(rows)], strict=True):  # equal times stay in one batch
        for part in actors.fold(("hot",), iter([pd.DataFrame(rows[low:high], columns=columns)]), state):
            got |= {r.event_id: tuple(int(getattr(r, c)) for c in NAMES) for r in part.itertuples()}
    assert got == want
