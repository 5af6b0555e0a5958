"""Line dedup by a log-template tree of fixed depth.

A line's tokens are its words, with those that hold a digit masked as a variable field. The tree's first level is the
token count, the next ``DEPTH`` levels are the leading tokens; a leaf holds lines alike in these. Within a leaf,
tokens of a position that fewer than the needed number of different lines share become variable fields too, if what stays
constant is at least ``CONSTANT`` of the line and ``LEAST_CONSTANT`` tokens. A template recurs if it stands in so many different
texts: ``SHORT_DOCS`` for a short line, ``LONG_DOCS`` for one of ``LONG`` tokens or more. Lines of recurring templates are dropped
wherever they stand.

Near copies of one document share all their lines, which are no boilerplate: near-duplicate detection keeps one of them, and
it must stay whole. So texts are told apart first: one whose words lie mostly (over ``COPY_SHARE``) in several different lines that recur word for
word is copy-like, and so is one of which a single such line is ``WHOLE_SHARE`` or more, the share from which texts are 0.8 alike; one
passage or notice that is the larger part of many texts makes no copies of them. A template recurs only if texts that are not
copy-like hold it often enough, and are at least ``OWN_SHARE`` of all that hold it. Copy-like texts lose lines of recurring templates as others do.

Scale: two passes make small rows of hashes and counts; text is moved only for lines of leaves that vary. In a third pass the
recurring lines are held in memory (at most ``MOST_HELD``, 8 bytes each) and taken out of the texts; if there are more, texts are joined
with the places of their dropped lines instead, with the same result. Tokens, lines and leaves are compared by 64-bit hashes. All groups are
counts with partial aggregation; equal texts count once, and a text once for a line however often it repeats in it.

Defined results: a null text stays null and has no line; lines of fewer than ``LEAST_TOKENS`` tokens are never
dropped; a text of nothing but dropped lines becomes empty; rows with equal texts count once and get the same result; null ids are
rows as any other; an empty table gives no rows; a very long text is read whole; further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import broadcast_if_few, in_batches, materialize, quoted, steps, table, unboxed, utf8
from .decontamination import BASE, bitmap, mixed, passing, rolled, token_bounds

DEPTH = 3
LEAST_TOKENS, LONG = 3, 20
SHORT_DOCS, LONG_DOCS = 10, 3
CONSTANT, LEAST_CONSTANT = 0.8, 6
COPY_SHARE, WHOLE_SHARE, OWN_SHARE = 0.6, 8 / 9, 0.25
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[32, *range(9, 14)]] = False
#: Recurring lines up to which they are held by each task.
MOST_HELD = 2_000_000
FIELD = 0xF1E1DF1E1DF1E1DF  # stands for the hash of a variable field


def needed(n: Column) -> Column:
    """Documents in which a template of n tokens must occur."""
    return F.when(n >= LONG, LONG_DOCS).otherwise(SHORT_DOCS)


class Lines:
    """The lines with tokens of some texts, one after the other: their place, token hashes and addresses in the tree."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        starts, ends = token_bounds(data, at, WORD_BYTE)
        self.tokens = rolled(data.astype(np.uint64) + np.uint64(1), starts, ends)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        self.tokens[digits[ends] > digits[starts]] = FIELD
        breaks = np.flatnonzero(data == 10)
        text = np.searchsorted(at, starts, side="right") - 1
        line = np.searchsorted(breaks, starts) + text
        self.first = np.flatnonzero(np.concatenate([[True], np.diff(line) > 0])) if len(line) else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(line)) if len(line) else self.first
        self.text = text[self.first]
        self.pos = line[self.first] - self.text - np.searchsorted(breaks, at[self.text])
        self.n = self.end - self.first
        self.line = rolled(self.tokens, self.first, self.end)
        self.leaf = mixed(self.n.astype(np.uint64))
        for i in range(DEPTH):
            token = self.tokens[np.minimum(self.first + i, self.end - 1)] if len(line) else self.leaf
            self.leaf = mixed(self.leaf * np.uint64(BASE) + np.where(i < self.n, token, np.uint64(0)))


def recurs(n: Column, texts: Column, own: Column) -> Column:
    """Whether a template of n tokens that stands in so many texts, ``own`` of them not copy-like, is boilerplate."""
    return (own >= needed(n)) & (own >= OWN_SHARE * texts)


def addressed(docs: DataFrame) -> DataFrame:
    """(text_key, pos, n, leaf, line, first) for each line with a token of the different texts of docs (text_key, text): line is a
    hash of its masked tokens, first whether it stands at no earlier place of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            for a, b in steps(at):
                own = Lines(data[at[a] : at[b]], at[a : b + 1] - at[a])
                first = np.zeros(len(own.line), bool)
                first[np.unique(mixed(own.line * np.uint64(BASE) + own.text.astype(np.uint64)), return_index=True)[1]] = True
                keys = batch.column(0).take(pa.array(own.text + a))
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, (own.pos.astype(np.int32), own.n.astype(np.int32), own.leaf.view(np.int64), own.line.view(np.int64), first))], ["text_key", "pos", "n", "leaf", "line", "first"])

    return in_batches(docs.select("text_key", "text"), run, "text_key long, pos int, n int, leaf long, line long, first boolean").distinct()


def lines_of_leaves(docs: DataFrame, leaves: DataFrame) -> DataFrame:
    """(leaf, line, tokens: hashes) of the lines whose leaf passes a Bloom filter of the leaves."""
    held = docs.sparkSession.sparkContext.broadcast(bitmap(leaves.select(F.col("leaf").alias("seed")), leaves.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = held.value.view(np.uint64)
        for batch in batches:
            data, at = utf8(batch.column(0))
            for a, b in steps(at):
                own = Lines(data[at[a] : at[b]], at[a : b + 1] - at[a])
                hit = passing(filled, own.leaf)
                hit = hit[own.n[hit] >= LEAST_CONSTANT]
                cuts = np.concatenate([[0], np.cumsum(own.n[hit])]).astype(np.int32)
                each = np.arange(cuts[-1]) + np.repeat(own.first[hit] - cuts[:-1], own.n[hit])
                tokens = pa.ListArray.from_arrays(pa.array(cuts), pa.array(own.tokens[each].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(own.leaf[hit].view(np.int64)), pa.array(own.line[hit].view(np.int64)), tokens], ["leaf", "line", "tokens"])

    return in_batches(docs.select("text"), run, "leaf long, line long, tokens array<long>")


def generalised(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(leaf, line) for lines that recur only as a template with more variable fields.

    counts has (leaf, line, n, texts, own, alone) of all lines: those that recur by themselves (alone) support their template too.
    """
    varied = counts.groupBy("leaf", "n").agg(F.count("*").alias("lines"), F.sum("own").alias("own"), F.count_if(~F.col("alone")).alias("open"))
    varied = materialize(varied.filter((F.col("open") > 0) & (F.col("lines") > 1) & (F.col("own") >= needed(F.col("n"))) & (F.col("n") >= LEAST_CONSTANT)).select("leaf", "n"), "varied")
    wanted = materialize(counts.join(broadcast_if_few(varied), ["leaf", "n"], "left_semi").select("leaf", "line", "n", "texts", "own", "alone"), "candidates")
    one = lines_of_leaves(docs, varied).dropDuplicates(["leaf", "line"]).join(broadcast_if_few(wanted), ["leaf", "line"])
    one = materialize(one, "lines")
    places = one.select("leaf", "line", "n", "texts", "own", "alone", F.posexplode("tokens").alias("i", "token"))
    common = places.groupBy("leaf", "n", "i", "token").agg(F.sum("own").alias("d")).filter(F.col("d") >= needed(F.col("n"))).select("leaf", "i", "token")
    constant = places.filter(~F.col("alone")).join(common, ["leaf", "i", "token"]).groupBy("leaf", "line", "n", "texts", "own")
    parts = constant.agg(F.sum((F.col("token") != FIELD - (1 << 64)).cast("int")).alias("fixed"), F.array_sort(F.collect_list(F.struct("i", "token"))).alias("held"))
    parts = parts.filter((F.col("fixed") >= CONSTANT * F.col("n")) & (F.col("fixed") >= LEAST_CONSTANT))
    parts = materialize(parts.select("leaf", "line", "n", "texts", "own", F.xxhash64("held").alias("template"), F.col("held.i").alias("places")), "templates")
    # a line that recurs by itself has each template of its leaf that it agrees with
    masks = parts.select("leaf", "places").distinct()
    seen_as = F.xxhash64(F.transform("places", lambda i: F.struct(i.alias("i"), F.get("tokens", i).alias("token"))))
    more = one.filter("alone").join(masks, "leaf").select("leaf", seen_as.alias("template"), "n", "texts", "own")
    every = parts.select("leaf", "template", "n", "texts", "own").union(more).groupBy("leaf", "template", "n").agg(F.sum("texts").alias("texts"), F.sum("own").alias("own"))
    return parts.join(every.filter(recurs(F.col("n"), F.col("texts"), F.col("own"))).select("leaf", "template", "n"), ["leaf", "template", "n"]).select("leaf", "line")


def recurring_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs has text_key and text. Returns (leaf, line) of the lines that are dropped, and all lines (text_key, pos, n, leaf, line, first)."""
    lines = materialize(addressed(docs), "addressed")
    # places that count: one for each text and line
    once = lines.filter(F.col("first") & (F.col("n") >= LEAST_TOKENS))
    alone = once.groupBy("leaf", "line", "n").agg(F.count("*").alias("texts")).filter(F.col("texts") >= needed(F.col("n")))
    alone = materialize(alone.select("leaf", "line", F.lit(1).alias("hit")), "alone")
    shares = lines.join(broadcast_if_few(alone), ["leaf", "line"], "left").groupBy("text_key").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("hit") == 1, F.col("n"))).alias("lost"), F.count_if((F.col("hit") == 1) & F.col("first")).alias("several"))
    copy = (F.col("lost") > COPY_SHARE * F.col("words")) & ((F.col("several") > 1) | (F.col("lost") >= WHOLE_SHARE * F.col("words")))
    copies = materialize(shares.filter(copy).select("text_key", F.lit(1).alias("copy")), "copies")
    marked = once.join(broadcast_if_few(copies), "text_key", "left")
    counts = materialize(marked.groupBy("leaf", "line", "n").agg(F.count("*").alias("texts"), F.count_if(F.col("copy").isNull()).alias("own")), "counts")
    counts = counts.withColumn("alone", recurs(F.col("n"), F.col("texts"), F.col("own")))
    return materialize(counts.filter("alone").select("leaf", "line").union(generalised(docs, counts)), "recurring"), lines


def line_key(leaf: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mixed(leaf.view(np.uint64) * np.uint64(BASE) + line.view(np.uint64))


def in_memory(rows: DataFrame, recurring: DataFrame) -> DataFrame:
    """(row, text, n_dropped): rows (row, text) with the lines taken out by each task."""
    found = recurring.toArrow()  # at most MOST_HELD rows
    held = rows.sparkSession.sparkContext.broadcast(np.unique(line_key(*(found.column(c).to_numpy() for c in ("leaf", "line")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            data, at = utf8(batch.column(1))
            texts: list[str | None] = [None] * len(batch)
            dropped = np.zeros(len(batch), np.int64)
            for a, b in steps(at):
                own = Lines(data[at[a] : at[b]], at[a : b + 1] - at[a])
                key = line_key(own.leaf, own.line)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key) if len(known) else np.zeros(0, np.int64)
                for i in np.unique(own.text[hit]).tolist():
                    gone = set(own.pos[hit[own.text[hit] == i]].tolist())
                    parts = data[at[a + i] : at[a + i + 1]].tobytes().split(b"\n")
                    texts[a + i] = b"\n".join(p for k, p in enumerate(parts) if k not in gone).decode(errors="replace")
                    dropped[a + i] = len(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(dropped)], ["row", "new_text", "n_dropped"])

    schema = StructType([rows.schema["row"], StructField("new_text", StringType()), StructField("n_dropped", LongType())])
    return in_batches(rows.select("row", "text"), run, schema)


def by_join(rows: DataFrame, recurring: DataFrame, lines: DataFrame) -> DataFrame:
    """The same by a join of rows (row, text, text_key) with the places of their lines."""
    drop = materialize(lines.join(broadcast_if_few(recurring), ["leaf", "line"]).groupBy("text_key").agg(F.collect_set("pos").alias("drop")), "dropped")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("drop", i)), "\n")
    joined = rows.join(drop, "text_key", "left")
    return joined.select("row", F.when(F.col("drop").isNotNull(), kept).alias("new_text"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def without_templates(docs: DataFrame, text_col: str = "text", most_held: int = MOST_HELD) -> DataFrame:
    """(row, text, n_dropped): each row of docs with its cleaned text and the number of its lines that went."""
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("text_key"))
    recurring, lines = recurring_lines(rows)
    out = in_memory(rows, recurring) if recurring.limit(most_held + 1).count() <= most_held else by_join(rows, recurring, lines)
    return out.select("row", F.when(F.col("n_dropped") > 0, F.col("new_text")).otherwise(F.col("row").getField(text_col)).alias("text"), "n_dropped")


def deduplicated_lines(docs: DataFrame, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """docs with their own columns and cleaned texts; chars_col, if given, is set to the new length where lines went."""
    out = without_templates(docs, text_col)
    gone = F.col("n_dropped") > 0
    row = F.col("row").withField("`" + text_col + "`", F.col("text"))
    if chars_col:
        length = F.length("text").cast(docs.schema[chars_col].dataType)
        row = row.withField("`" + chars_col + "`", F.when(gone, length).otherwise(F.col("row").getField(chars_col)))
    return unboxed(out.select(row.alias("row")))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_templates(docs).select("row.doc_id", "n_dropped", F.sha1("text").alias("text_sha1"))
