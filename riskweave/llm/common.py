"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step works on inside a task.
STEP_BYTES = 500_000
#: Options of writes to a local file system, for intermediate tables only: without checksum files, and without the process that Hadoop's default starts for each file
#: to set its permissions where its native library is missing (a copy of the executor's address space for a moment). A "file:" folder on a shared mount that
#: needs those permissions should be named by another scheme; other file systems are not touched.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Bytes of an Arrow batch, and of a Parquet row group that a task holds while it writes.
BATCH_BYTES, ROW_GROUP_BYTES = 4 << 20, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's own. Only in local mode a fresh one is made where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='riskweave-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since temporary_tables() began, for each thread of the driver its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes within go at the end: for steps whose result is stored elsewhere by then."""
    before = _made.set([])
    try:
        yield
    finally:
        paths = _made.get() or []
        _made.reset(before)
        for path in paths:
            discard(spark, path)


def discard(spark: SparkSession, path: str | None) -> None:
    """Removes a table of stored(), if it is still there."""
    if path is not None:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to the shared folder, as it is read back, and where it lies: later reads survive lost executors, and lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    if path.startswith("file:"):
        writer = writer.options(**PLAIN_FILES)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    return stored(df, tag)[0]


def counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """materialize(df, tag) and its number of rows, counted as they are written: a query of its own for each count fills the driver with plans and threads."""
    seen = Observation()
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), tag)
    n = seen.get.get("n")
    return out, out.count() if n is None else n


def release(spark: SparkSession) -> None:
    """Asks the driver to collect its garbage: Spark removes the shuffle files of steps that nothing refers to any more only then, and a job of many
    steps would hold the files of all of them until memory happens to fill. Then the JVM hands back what its hundreds of short-lived threads have freed,
    which the C library would keep; a JVM without that command keeps it."""
    gc.collect()
    spark._jvm.System.gc()
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        kind = jvm.java.lang.Class.forName
        types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        pass


def in_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with batches of about ``BATCH_BYTES`` at most, where the session sets no lower bound: long texts must not
    meet in one batch by the thousand."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(df.sparkSession.conf.get(key)).rstrip("b")
    if now.isdigit() and not 0 < int(now) <= BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def spread_out(df: DataFrame) -> DataFrame:
    """df over all shuffle partitions, however few bytes it has: for small rows that cost much work each. Without keys, so no partitioning that df has already makes it void."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


KEY = ["key_none", "key_id", "key_text"]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text, KEY): docs with all its columns in one struct, so that no name clashes with a helper's, its id and
    text, and KEY, by which a row is found again: its id, null or not, and a hash of its text. ``row.*`` gives the columns back."""
    doc_id, text = quoted(id_col).cast("long"), quoted(text_col)
    key = [doc_id.isNull(), F.coalesce(doc_id, F.lit(0)), F.xxhash64(text)]
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), doc_id.alias("doc_id"), text.alias("text"), *[c.alias(k) for c, k in zip(key, KEY, strict=True)])


def unboxed(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


#: Rows up to which a table is broadcast.
FEW = 100_000


def broadcast_if_few(df: DataFrame, most: int = FEW, n: int | None = None) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; n is its number of rows where counted() told it. Else counting is cheap for what materialize() wrote."""
    return F.broadcast(df) if (df.limit(most + 1).count() if n is None else n) <= most else df


def few(df: DataFrame, tag: str, most: int = FEW) -> DataFrame:
    """materialize(df, tag), to be broadcast if it has at most so many rows."""
    out, n = counted(df, tag)
    return broadcast_if_few(out, most, n)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of an id's decimal text, mod n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its bytes and n + 1 offsets; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b
        a = b


def local_path(uri: str) -> str:
    return uri.removeprefix("file://") if uri.startswith("file:") else uri


def new_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if path.startswith("file:") or "://" not in path:
        os.makedirs(local_path(path), exist_ok=True)
    return path
