"""Sources: NDJSON requests routed by operation, lexicon files, router weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import assets as A
from ..schema import REQUEST

TEXT_BYTES, LINE_BYTES = 8192, 32768


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value) as requests with ``ok`` and ``error``; bad and oversized lines stay as rows that are not ok."""
    rows = lines.select("value", F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("j"))
    large = (F.octet_length("value") > LINE_BYTES) | (F.octet_length("r.text") > TEXT_BYTES)
    error = F.when(large, "too_large").when(F.col("j").isNull(), "malformed").when(F.col("r.op").isNull() & F.col("r.text").isNull(), "empty")
    return rows.select("value", "r.*", error.alias("error")).withColumn("ok", F.col("error").isNull())


def read_requests(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    return parsed((spark.readStream if stream else spark.read).text(path))


def routed(requests: DataFrame) -> dict[str, DataFrame]:
    """message, signal and context rows of the requests that are ok."""
    good, op = requests.filter("ok"), F.coalesce("op", F.lit("moderate"))
    names = {"conversationID": "conversation_id", "senderID": "sender_id", "priorViolations": "prior_violations"}
    renamed = good.withColumnsRenamed(names)
    signal = renamed.filter(op.isin("report", "block")).select(F.col("id").alias("signal_id"), "op", "sender_id", "conversation_id", "ts")
    context = renamed.filter(op == "context").select("conversation_id", "ts", "stage", "trust", "prior_violations")
    message = renamed.filter(~op.isin("report", "block", "context")).select(F.col("id").alias("message_id"), "conversation_id", "sender_id", "ts", "text", known("trust", A.TRUST_OFFSETS, "standard"), known("stage", A.STAGE_OFFSETS, "inquiry"), F.coalesce("prior_violations", F.lit(0)).alias("prior_violations"), F.coalesce("advisory", F.lit(False)).alias("advisory"))
    return {"message": message, "signal": signal, "context": context}


def known(column: str, names: dict, default: str):
    return F.when(F.col(column).isin(list(names)), F.col(column)).otherwise(default).alias(column)


def read_lexicon(spark: SparkSession, path: str, seed: list[str]) -> DataFrame:
    """The seed and a file's words (a JSON array, or lines with # comments), lower-cased and distinct."""
    lines = spark.read.text(path, wholetext=True)
    array = F.from_json("value", "array<string>")
    plain = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", ""))), lambda x: x != "")
    words = lines.select(F.explode(F.when(F.ltrim("value").startswith("["), array).otherwise(plain)).alias("word"))
    return words.union(spark.createDataFrame([(w,) for w in seed], "word string")).select(F.lower("word").alias("word")).distinct()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, weight) of a file with a header ``buckets count`` and a line for each weight; refused if the count differs."""
    lines = spark.read.text(path).filter("trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("p"))
    head = lines.filter("p[0] = 'weights'").select(F.col("p")[1].cast("int").alias("n"))
    rows = lines.filter("p[0] <> 'weights'").select(F.col("p")[0].cast("int").alias("bucket"), F.col("p")[1].cast("double").alias("weight"))
    declared, read = head.first(), rows.count()
    if declared is None or declared.n != read:
        raise ValueError(f"declared {declared and declared.n} weights, read {read}")
    return rows
