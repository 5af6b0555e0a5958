"""Bounds of what a Python worker holds at a time."""

import numpy as np

from riskweave.llm import common, simhash_neardup


def test_batches_and_steps_stay_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(64 << 20))
        sizes = common.in_batches(spark.range(1).selectExpr("repeat('a', 10) AS t"), lambda b: b, "t string")
        assert sizes.count() == 1 and int(spark.conf.get(key).rstrip("b")) <= 4 << 20
    finally:
        spark.conf.set(key, before)
    at = np.arange(0, 10_000_000, 1000)
    parts = list(common.steps(at))
    assert parts[0][0] == 0 and parts[-1][1] == len(at) - 1 and all(a == b for (_, a), (b, _) in zip(parts, parts[1:])) and max(at[b] - at[a] for a, b in parts) <= 500_000


def test_each_round_of_components_is_one_query(spark):
    sc = spark.sparkContext._jsc.sc()
    ended = lambda: sc.listenerBus().waitUntilEmpty(30_000) or spark._jsparkSession.sharedState().statusStore().executionsList().size()
    edges, few = spark.createDataFrame([(2, 1), (3, 2)], "a long, b long"), common.FEW
    try:
        for common_few in (few, 0):
            simhash_neardup.FEW = common_few
            before = ended()
            roots = simhash_neardup.components(edges)
            assert ended() - before <= 4  # the edges, a round, perhaps another, and one that changes nothing
            assert sorted(tuple(r) for r in roots.collect()) == [(1, 1), (2, 1), (3, 1)]
    finally:
        simhash_neardup.FEW = few


def test_rows_are_counted_as_they_are_written(spark):
    for n in (0, 5):
        df, found = common.counted(spark.range(n), "numbers")
        assert found == n == df.count()
