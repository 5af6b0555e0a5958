"""Sinks: an append-only decision table with first-writer-wins commits, and its outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import first_writer


#: Partitions of a decision table by its key.
PARTS = 64


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def commit_if_absent(decisions: DataFrame, path: str, order: list[str], key: str = "message_id", parts: int = PARTS) -> None:
    """Appends the first row of each key that the table does not have yet. One writer at a time; fit for foreachBatch.

    The table is partitioned by a hash of the key; a commit reads the keys of the partitions that its rows fall in. Small commits
    touch few of them, and many small files of a partition can be rewritten by themselves. A commit without rows leaves an empty table.
    """
    spark = decisions.sparkSession
    rows = first_writer(decisions, key, order).withColumn("key_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    if exists(spark, path):
        touched = [r.key_part for r in rows.select("key_part").distinct().collect()]  # at most parts numbers
        held = spark.read.schema(rows.schema).parquet(path).filter(F.col("key_part").isin(touched)).select("key_part", key)
        rows = rows.join(held, ["key_part", key], "left_anti")
    rows.write.mode("append").partitionBy("key_part").parquet(path)


def finalize(decisions: DataFrame, path: str, order: list[str], key: str = "message_id", parts: int = PARTS) -> DataFrame:
    """Commits what reservations were made for and gives the canonical decision of each key: the new one, or the one that another writer
    stored before. Reservations need no removal: operators.state.reservable asks for decided keys first."""
    commit_if_absent(decisions, path, order, key, parts)
    keys = decisions.select(key).distinct()
    return decisions.sparkSession.read.parquet(path).join(keys.withColumn("key_part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), ["key_part", key], "left_semi").drop("key_part")


def mark_delivered(events: DataFrame, path: str, parts: int = PARTS) -> None:
    """Notes events (event_id, delivered_at) as delivered; an event noted twice keeps its first time."""
    commit_if_absent(events.select("event_id", "delivered_at"), path, ["delivered_at"], "event_id", parts)


def delivered(spark: SparkSession, path: str) -> DataFrame:
    """The events noted as delivered; none before the first note."""
    kind = "event_id string, delivered_at timestamp"
    return spark.read.schema(kind).parquet(path) if exists(spark, path) else spark.createDataFrame([], kind)


def events_since(events: DataFrame, since: Column) -> DataFrame:
    """Events from a time on, delivered or not, oldest first: what state is built from again after a restart."""
    return events.filter(F.col("occurred_at") >= since).orderBy("occurred_at", "event_id")


def outbox(decisions: DataFrame) -> DataFrame:
    """An event for each decision."""
    return decisions.select(F.col("message_id").alias("event_id"), F.lit("decision").alias("kind"), F.col("ts").alias("occurred_at"), F.to_json(F.struct("message_id", "action", "reasons", "policy_version")).alias("payload"))


def pending(events: DataFrame, delivered: DataFrame, most: int = 50, failed: DataFrame | None = None) -> DataFrame:
    """The oldest events that are not delivered (a top-k report); those from the first failed one (event_id) on wait."""
    left = events.join(delivered.select("event_id"), "event_id", "left_anti")
    if failed is not None:
        stop = left.join(failed.select("event_id"), "event_id", "left_semi").agg(F.min(F.struct("occurred_at", "event_id")).alias("stop"))  # one row
        left = left.join(F.broadcast(stop), F.col("stop").isNull() | (F.struct("occurred_at", "event_id") < F.col("stop")), "left_semi")
    return left.orderBy("occurred_at", "event_id").limit(most)


def with_adjudication(decisions: DataFrame, adjudications: DataFrame) -> DataFrame:
    """decisions with the action of an adjudication, if there is one, and whether it supersedes them."""
    side = adjudications.select("message_id", F.col("action").alias("adjudicated"))
    out = decisions.join(side, "message_id", "left")
    return out.withColumn("superseded", F.coalesce(F.col("adjudicated") != F.col("action"), F.lit(False))).withColumn("effective", F.coalesce("adjudicated", "action"))
