"""Conversation buffers as keyed state: the sender's last texts of a conversation that may spell something together.

A key's state is the list of its texts of the last 15 minutes, at most ``DEPTH``, in a list state whose rows expire by themselves. A message sees the
texts before it; a text that is held back for itself never enters the buffer, and a message that completes a detail (a hit) empties it, so no
detail is found twice. ``stored`` is the buffer that another run left, and becomes the initial state.

Defined results: messages of one micro-batch are taken in order of time and id; a null text is an empty one; a null time is the start of time; a message
with an earlier time than the buffer's texts sees those of the 15 minutes before it only. State stores that expire rows need
``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB one; a run over what is available now ends only with
``spark.sql.streaming.noDataMicroBatches.enabled`` false, as expiring rows ask for a batch without data again and again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.state import DEPTH, QUARTER, micros

BUFFERED = "conversation_id string, sender_id string, message_id string, at long, text string, buffer array<string>, hit boolean"
STORED = "conversation_id string, sender_id string, at long, text string"
MINUTES_MS = QUARTER // 1000


def taken(held: list[tuple[int, str]], at: int, text: str, hit: Callable[[list[str]], bool], withheld: Callable[[str], bool]) -> tuple[list[str], bool, list[tuple[int, str]]]:
    """(buffer, hit, texts held from now on) of one message."""
    before = [(t, x) for t, x in held if at - QUARTER <= t <= at][-DEPTH:]
    buffer = [x for _, x in before]
    if withheld(text):
        return buffer, False, held
    if buffer and hit([*buffer, text]):
        return buffer, True, []
    return buffer, False, [*[(t, x) for t, x in held if t >= at - QUARTER], (at, text)][-DEPTH:]


class ConversationBuffer(StatefulProcessor):
    def __init__(self, hit: Callable[[list[str]], bool], withheld: Callable[[str], bool]):
        self.hit, self.withheld = hit, withheld

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", "at long, text string", ttlDurationMs=MINUTES_MS)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        rows = sorted(zip(initialState["at"], initialState["text"], strict=True))
        self.texts.appendList([(int(t), x) for t, x in rows][-DEPTH:])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [(int(t), x) for t, x in self.texts.get()]
        batch = sorted((int(a), m or "", t or "") for part in rows for a, m, t in zip(part["at"], part["message_id"], part["text"], strict=True))
        out = []
        for at, message, text in batch:
            buffer, hit, held = taken(held, at, text, self.hit, self.withheld)
            out.append((key[0], key[1], message, at, text, buffer, hit))
        self.texts.clear()
        if held:
            self.texts.put(held)
        yield pd.DataFrame(out, columns=["conversation_id", "sender_id", "message_id", "at", "text", "buffer", "hit"])

    def close(self) -> None:
        pass


def buffered(messages: DataFrame, hit: Callable[[list[str]], bool], withheld: Callable[[str], bool], stored: DataFrame | None = None) -> DataFrame:
    """messages (a stream with conversation_id, sender_id, message_id, ts, text) with their buffers; hit judges a buffer with the new text behind it,
    withheld a text alone. stored has the columns STORED."""
    rows = messages.select("conversation_id", "sender_id", "message_id", F.coalesce(micros(F.col("ts")), F.lit(0)).alias("at"), "text")
    first = None if stored is None else stored.groupBy("conversation_id", "sender_id")
    return rows.groupBy("conversation_id", "sender_id").transformWithStateInPandas(statefulProcessor=ConversationBuffer(hit, withheld), outputStructType=BUFFERED, outputMode="Append", timeMode="ProcessingTime", initialState=first)
