"""Bounds of what the plan's Python functions hold at a time."""

from riskweave.plans.moderate import moderate

from .test_cascade import message
from .test_plans import SCHEMA

KEYS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 1 << 20}


def test_the_plan_bounds_its_batches(spark):
    before = {k: spark.conf.get(k) for k in KEYS}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        moderate(spark.createDataFrame([message(1, "hello")], SCHEMA))
        assert all(0 < int(spark.conf.get(k).rstrip("b")) <= most for k, most in KEYS.items())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
