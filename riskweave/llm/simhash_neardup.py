"""SimHash near-duplicates by anchor-point covering.

Each document gets a 64-bit fingerprint: bit b is 1 if it is set in over half of the XXH64 values (seed 42) of
its shingles. Fingerprints that differ in at most ``threshold`` bits are linked; a component is what links reach.

Links are found with a covering code. The 64 bits fall into blocks, so that two linked fingerprints differ in at
most t = threshold // blocks bits of some block. The anchors of a block are the codewords of a [15, 11] Hamming
code on its low bits, times every value of its other bits: each value lies within the covering radius R = 1 of an
anchor, its home. A fingerprint is replicated to every anchor within R + t. If x and y differ in at most t bits of a
block, y visits the home of x there, so comparing the home members of an anchor with its visitors finds every link.

Scale: equal fingerprints are one row before anything is replicated, so exact copies cost nothing. An anchor with more
than ``tile`` members is cut into tiles that are compared apart; a task reports the forest that its links span, never
the links within a dense group. Pairs for each anchor grow with the square of the fingerprints, so from ``MANY`` fingerprints on
two blocks of 32 bits stand for three of 21 and 22: 16 times the replicas, 2,000 times the anchors, the same links. (Computed:
at 200 million fingerprints the pairs of three blocks cost what the replicas of two do.) Components come from large-star and
small-star rounds over written tables, with salted joins.

Defined results: a null or wordless text has fingerprint zero and is linked as any other; a repeated row gets
the same row again; a null doc_id keeps its row and counts in no component_id unless nothing else is there (null); an empty
table gives no rows; a very long text is read whole; further columns may have any name. Of a component one row stays: the smallest
id (null ids last), then the smallest hash of its text, then of its other columns; rows equal in all of them are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import FEW, KEY, boxed, counted, in_batches, materialize, quoted, spread_out, steps, table, unboxed, utf8

SEED = 42
HAMMING = 15
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Candidate pairs that one numpy step compares.
PAIRS = 2_000_000
#: Keys of documents that go, or stand more than once, that are broadcast.
MOST_BROADCAST = 500_000
#: Fingerprints from which on two blocks cost less than three.
MANY = 200_000_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (all words if there are fewer), as uint64."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    cuts = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n], ends[-n:], strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = hashes[a : a + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, text_key, fp) for each row: fp is the signed 64-bit fingerprint, text_key a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            found = np.zeros(len(batch), np.uint64)
            for i in range(len(batch)):
                found[i] = majority(shingle_hashes(data[at[i] : at[i + 1]].tobytes(), words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "text_key", "fp"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("text_key"), quoted(text_col).alias("text"))
    return in_batches(rows, run, "doc_id long, text_key long, fp long")


class Covering:
    """Anchors of 64-bit values: for each block, the flips that lead to the anchors within reach."""

    def __init__(self, threshold: int, blocks: int):
        self.near = threshold // blocks
        self.reach = 1 + self.near
        cuts = [64 * i // blocks for i in range(blocks + 1)]
        self.blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
        if min(w for _, w in self.blocks) < HAMMING:
            raise ValueError("a block needs at least 15 bits")
        values = np.arange(1 << HAMMING)
        self.syndrome = reduce(np.bitwise_xor, [((values >> i) & 1) * (i + 1) for i in range(HAMMING)])

    def flips(self, width: int) -> list[np.ndarray]:
        """For each syndrome: the flips of at most ``reach`` bits that end at an anchor; the home's is first."""
        out: list[list[int]] = [[] for _ in range(HAMMING + 1)]
        for n in range(self.reach + 1):
            for bits in combinations(range(width), n):
                low = reduce(lambda s, b: s ^ (b + 1 if b < HAMMING else 0), bits, 0)
                out[low].append(sum(1 << b for b in bits))
        home = lambda m: (m >> HAMMING != 0, bin(m).count("1"))
        return [np.array(sorted(x, key=home), np.int64) for x in out]

    def replicate(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, fp, home) rows of unsigned fingerprints."""
        for k, (low, width) in enumerate(self.blocks):
            value = ((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
            kind = self.syndrome[value & ((1 << HAMMING) - 1)]
            for s, masks in enumerate(self.flips(width)):
                at = np.flatnonzero(kind == s)
                anchors = (value[at][:, None] ^ masks[None, :]) | (k << 40)
                home = np.zeros(anchors.shape, bool)
                home[:, 0] = True
                yield anchors.ravel(), np.repeat(fp[at], len(masks)), home.ravel()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected part of the graph with edges a-b: (member, smallest member)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def compared(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """The stars of links between home members and visitors of the same key; keys are sorted."""
    _, starts, sizes = np.unique(key, return_index=True, return_counts=True)
    at = np.flatnonzero(home)
    group = np.searchsorted(starts, at, side="right") - 1
    n, first = sizes[group], starts[group]
    left, right = [], []
    total = np.concatenate([[0], np.cumsum(n)])
    for i, j in steps(total, PAIRS):
        reps = n[i:j]
        x = np.repeat(at[i:j], reps)
        y = np.repeat(first[i:j] - (total[i:j] - total[i]), reps) + np.arange(reps.sum())
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= threshold) & (fp[x] < fp[y])
        star = forest(fp[x[near]], fp[y[near]])
        left.append(star[0])
        right.append(star[1])
    if not left:
        return fp[:0], fp[:0]
    return forest(np.concatenate(left), np.concatenate(right))


def links(distinct: DataFrame, threshold: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """Edges (a, b) between different fingerprints, whose connected parts are those of all links.

    distinct has one row for each fingerprint, in column fp, and is cheap to count.
    """
    code = Covering(threshold, blocks or (3 if distinct.count() < MANY else 2))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for a in range(0, len(fp), 4096):
                for anchor, value, home in code.replicate(fp[a : a + 4096]):
                    if len(anchor):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(value.view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            part = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
            if rest is not None:
                part = [np.concatenate(x) for x in zip(rest, part, strict=True)]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))
            rest = [x[cut:] for x in part]
            yield from found([x[:cut] for x in part])
        if rest is not None:
            yield from found(rest)

    def found(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = compared(*part, threshold)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    rows = in_batches(spread_out(distinct.select("fp")), spread, "anchor long, fp long, home boolean")
    crowded, n_crowded = counted(rows.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > tile), "crowded")
    if n_crowded:
        side = F.broadcast(crowded) if n_crowded <= 50_000 else crowded
        rows = rows.join(side, "anchor", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("long")
        every = F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)
        home_at, visit_at = F.col("part") + F.col("parts") * F.col("other"), F.col("other") + F.col("parts") * F.col("part")
        rows = rows.withColumn("part", mine).withColumn("other", F.explode(every))
        # a tile holds one part of the home members and one part of all members, each named by its role
        as_home = rows.filter("home").select("anchor", "fp", F.lit(True).alias("home"), home_at.alias("tile"), "parts")
        as_visitor = rows.filter(~F.col("home") | (F.col("parts") > 1)).select("anchor", "fp", F.lit(False).alias("home"), visit_at.alias("tile"), "parts")
        rows = as_home.unionByName(as_visitor).withColumn("key", F.when(F.col("parts") == 1, F.col("anchor")).otherwise(F.xxhash64("anchor", "tile").bitwiseOR(F.lit(1 << 62))))
    else:
        rows = rows.withColumn("key", F.col("anchor"))
    dealt = rows.select("key", "fp", "home").repartition("key").sortWithinPartitions("key")
    edges = in_batches(dealt, compare, "a long, b long")
    return edges.distinct()


def salted(edges: DataFrame, node: str, other: str, low: DataFrame, few: bool, salts: int = 16) -> DataFrame:
    """edges with m of ``low`` (a, m) at their end ``node``; the edges of one node are dealt by a hash of their other end. Where edges are few, low is broadcast
    and none is dealt."""
    if few:
        return edges.join(F.broadcast(low.select(F.col("a").alias("__node"), "m")), F.col(node) == F.col("__node"), "left").select("a", "b", "m")
    side = low.select(F.col("a").alias("__node"), "m", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    rows = edges.withColumn("__key", F.pmod(F.xxhash64(other), F.lit(salts)).cast("int"))
    return rows.join(side, (F.col(node) == F.col("__node")) & (F.col("__key") == F.col("__salt")), "left").select("a", "b", "m")


def written_edges(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (a, b) as a table, and what tells whether they changed: their number and the sum of their hashes, found while they are written."""
    seen, tells = Observation(), [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    edges = materialize(edges.observe(seen, *tells), "edges")
    return edges, tuple(edges.agg(*tells).first()) if "n" not in seen.get else (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge (a, b); root is the smallest node of its connected part."""
    edges, state = written_edges(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        if not state[0] or state == seen:
            break
        seen = state
        few = state[0] <= FEW
        # each edge goes from its larger end a to its smaller end b
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a")
        large = salted(edges, "b", "a", low, few).select("a", F.coalesce("m", "b").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        many = salted(large, "a", "b", low.filter("n > 1").select("a", "m"), few).filter("m is not null")
        small = many.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges, state = written_edges(small.filter("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, threshold: int = 4, blocks: int | None = None, tile: int = 1024) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for each row of docs."""
    rows = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, threshold, blocks, tile))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "text_key", "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one document of each component: the smallest (doc_id, text_key), null ids last."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, **how), id_col, text_col)


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component of found (doc_id, text_key, fp, component_id). While the documents that go, and those that stand more than
    once, are few, their keys are broadcast and no text is shuffled."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    key = [F.col("doc_id").isNull().alias(KEY[0]), F.coalesce("doc_id", F.lit(0)).alias(KEY[1]), F.col("text_key").alias(KEY[2])]
    found = materialize(found.groupBy("doc_id", "text_key", F.coalesce("component_id", "fp").alias("group"), F.col("component_id").isNull().alias("unnamed")).agg(F.count("*").alias("times")), "members")
    kept = found.groupBy("group", "unnamed").agg(F.min(order).alias("k"))
    kept = kept.select(F.col("k.none").alias(KEY[0]), F.coalesce("k.doc_id", F.lit(0)).alias(KEY[1]), F.col("k.text_key").alias(KEY[2])).distinct()
    kept = materialize(kept, "kept")
    gone, n_gone = counted(found.select(*key).distinct().join(kept, KEY, "left_anti"), "gone")
    again, n_again = counted(found.filter("times > 1").select(*key).join(kept, KEY, "left_semi").distinct(), "again")
    rows = boxed(docs, id_col, text_col)
    many = max(n_gone, n_again) > MOST_BROADCAST
    staying = rows.join(kept, KEY, "left_semi") if many else rows.join(F.broadcast(gone), KEY, "left_anti")
    others = [F.col("row").getField(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("others"))
    repeated = staying if many else staying.join(F.broadcast(again), KEY, "left_semi")
    ranked = repeated.withColumn("others", F.xxhash64(*others)).withColumn("place", place).filter("place = 1").select("row")
    return unboxed(ranked if many else staying.join(F.broadcast(again), KEY, "left_anti").select("row").unionByName(ranked))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
