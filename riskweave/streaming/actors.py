"""Streams: actor risk as keyed state, and moderated messages committed once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import DAY
from ..plans.moderate import decisions, moderate
from ..sources.sinks import commit_if_absent

STATE = "at array<long>, conversation array<string>, kind array<string>, counted array<boolean>"
RISK = "sender string, event_id long, at long, messages long, conversations int, reports long, blocks long, repeat_target long, sub_threshold long, escalating boolean"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The sender's events of the last day are the state. Old and new ones in order of time pass through one window whose counts are kept as events
    enter and leave it, so a batch costs what it holds, not its square; equal times of a batch count each other."""
    if state.hasTimedOut:
        state.remove()
        return
    held = list(zip(*state.get, strict=True)) if state.exists else []
    new = sorted(((int(r.at), r.event_id, r.conversation, r.kind, bool(r.routed and r.acted is not None and not r.acted)) for b in batches for r in b.itertuples(index=False)), key=lambda r: r[:2])
    held = sorted([*held, *((at, conversation, kind, counted) for at, _, conversation, kind, counted in new)], key=lambda h: h[0])
    kinds, here, below = Counter(), Counter(), Counter()

    def move(event: tuple, by: int) -> None:
        _, conversation, kind, counted = event
        kinds[kind] += by
        if kind == "message":
            here[conversation] += by
            below[conversation] += by * counted
            if not here[conversation]:
                del here[conversation], below[conversation]

    rows, low, high = [], 0, 0
    for at, event_id, conversation, _, _ in new:
        while high < len(held) and held[high][0] <= at:
            move(held[high], 1)
            high += 1
        while held[low][0] < at - DAY:
            move(held[low], -1)
            low += 1
        rows.append((key[0], event_id, at, kinds["message"], len(here) - (None in here), kinds["report"], kinds["block"], here[conversation], below[conversation], below[conversation] >= (2 if kinds["report"] else 3)))
        if not here[conversation]:
            del here[conversation], below[conversation]
    # late rows that the watermark lets pass look a day back from their own time
    least = min(held[-1][0], max(state.getCurrentWatermarkMs(), 0) * 1000) - DAY
    state.update(tuple(list(c) for c in zip(*(h for h in held if h[0] >= least), strict=True)))
    state.setTimeoutTimestamp(held[-1][0] // 1000 + DAY // 1000 + 1)
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RISK.split(", ")])


def actor_risk_stream(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """events as operators.state.actor_risk takes them, with a timestamp ``ts``; late rows are dropped by the watermark, rows without a time at once."""
    return events.filter("at is not null and ts is not null").withWatermark("ts", lateness).groupBy("sender").applyInPandasWithState(fold, RISK, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def moderated_stream(messages: DataFrame, path: str, checkpoint: str, lateness: str = "1 hour"):
    """Starts a query that moderates messages and commits each id once."""
    rows = decisions(moderate(messages.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["message_id"])))
    return rows.writeStream.foreachBatch(lambda batch, _: commit_if_absent(batch, path, ["ts"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conversation_counts(messages: DataFrame, lateness: str = "1 hour", window: str = "15 minutes") -> DataFrame:
    """Messages of each conversation and sender by window, for monitoring."""
    return messages.withWatermark("ts", lateness).groupBy(F.window("ts", window), "conversation_id", "sender_id").count()
