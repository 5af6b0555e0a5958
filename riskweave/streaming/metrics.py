"""Percentiles of the latest samples as keyed state: what a service shows of its latencies, kept up by a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Samples that a key keeps, and rows that a task holds back before it hands them on.
KEEP, MOST = 4096, 1_000_000
SAMPLE, STATE = "name string, place long, value double", "place array<long>, value array<double>"


def latest_of(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """The latest rows of each name in a task; all others can never be among the latest of all."""
    held, n = pd.DataFrame({"name": pd.Series(dtype=object), "place": pd.Series(dtype="int64"), "value": pd.Series(dtype="float64")}), 0
    hand_on = lambda rows: pa.RecordBatch.from_pandas(rows, pa.schema([("name", pa.string()), ("place", pa.int64()), ("value", pa.float64())]), preserve_index=False)
    for batch in batches:
        held = pd.concat([held, batch.to_pandas()]) if len(held) else batch.to_pandas()
        held = held.sort_values(["place", "value"]).groupby("name", dropna=False).tail(keep)
        if len(held) > MOST:  # so many names that holding back saves nothing
            yield hand_on(held)
            held = held.iloc[:0]
    yield hand_on(held)


def percentiles_stream(samples: DataFrame, name: Column, order: Column, value: Column, points: list[float], keep: int = KEEP) -> DataFrame:
    """(name, n, p50, ...) of each name with new samples, after each micro-batch (update mode): percentiles by place floor(p n), as
    operators.metrics.latest_percentiles gives them, over the ``keep`` samples of largest order (ties: of larger value).

    The state of a name is those samples. A task hands on no more of a name than they could need, so a hot name costs one task little. Rows
    without an order or a value are no samples; a null name is a name.
    """
    columns = ["name", "n", *[f"p{int(p * 100)}" for p in points]]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get if state.exists else ([], [])
        parts = list(batches)
        place = np.concatenate([np.array(old[0], np.int64), *[b["place"].to_numpy() for b in parts]])
        number = np.concatenate([np.array(old[1], float), *[b["value"].to_numpy() for b in parts]])
        last = np.lexsort((number, place))[-keep:]
        state.update((place[last].tolist(), number[last].tolist()))
        inside = np.sort(number[last])
        yield pd.DataFrame([(key[0], len(last), *[inside[min(int(len(last) * p), len(last) - 1)] for p in points])], columns=columns)

    rows = samples.select(name.cast("string").alias("name"), order.cast("long").alias("place"), value.cast("double").alias("value")).filter("place is not null and value is not null")
    rows = rows.mapInArrow(lambda b: latest_of(b, keep), SAMPLE)
    return rows.groupBy("name").applyInPandasWithState(fold, ", ".join(["name string", "n long", *[f"{c} double" for c in columns[2:]]]), STATE, "update", GroupStateTimeout.NoTimeout)
