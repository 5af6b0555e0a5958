"""Near-duplicates by SimHash anchors and, for what 64-bit fingerprints miss, by exact Jaccard similarity of word shingles.

Two texts are linked if the sets of their shingles' hashes have a Jaccard similarity of at least 4/5; a component is
what links reach. First the fingerprints of simhash_neardup are covered with anchors, which finds exact and close copies;
each such pair (of at most ``BITS`` different bits, which three blocks cover with four anchors a text) is verified on the whole sets. Fingerprints of pairs of similarity 0.8 differ in about 10 of 64 bits, too many for a
covering (threshold 15 in four blocks would put each at about 630 anchors), so an exact search follows: shingles stand in one
global order, and two sets so alike share a shingle among the first n - ceil(4n/5) + 1 of each (prefix filter), so only
texts that share such a shingle and are not linked yet are compared. No link is missed.

Scale: equal sets are one node. The order is by hash, but shingles that many texts have come last, the most frequent at the
end, so boilerplate meets only in texts made of it, and of near copies that are no links, only what is their own. Any order
is right and gives the same links, so how frequent a shingle is is read from one set in ``ORDERED_BY``; the texts compared are all. In the rounds each text of a shingle is compared with one text of
each round's choice, and links found are merged; only then are all pairs compared that still lie in different components.
So dense groups cost a few comparisons a text. Most pairs are ruled out by counts of their shingles' first bytes, an upper bound
of what they share; the others by their whole sets, which are made once for each text that needs them. Texts made mostly of
common shingles that are still no copies of each other are compared pair by pair.

Defined results: as in simhash_neardup; all wordless and null texts have the same empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash_neardup as simhash
from .common import KEY, boxed, broadcast_if_few, counted, discard, few, in_batches, materialize, quoted, release, stored, utf8
from .simhash_neardup import SEED, components, majority, one_of_each, shingle_hashes

#: One set in so many tells the order of shingles; those that more than COMMON of them have come last, the MOST_COMMON most frequent at most.
ORDERED_BY, COMMON, MOST_COMMON = 8, 4, 500_000
#: Bits in which fingerprints may differ to be compared first.
BITS = 2
#: Rounds that compare with one text for each shingle, before all that is left.
ROUNDS = 2
#: Comparisons with one text that one task makes.
CROWD = 256


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def sketch(own: np.ndarray) -> bytes:
    """How many shingles start with each byte. The sum of two sketches' lesser counts is no less than what the sets share."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256), 65535).astype("<u2").tobytes()


def alike(shared: Column, a: Column, b: Column) -> Column:
    """Jaccard similarity of at least 4/5, in whole numbers."""
    return 9 * shared >= 4 * (a + b)


def described(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_key, node, n, fp, sketch, told) of docs (doc_id, text_key, text): the set's hash and size, the text's fingerprint, and of one set in
    ORDERED_BY its shingles, which tell the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(2))
            node, size, prints, counts, told = [], [], [], [], []
            for a, b in zip(at, at[1:], strict=False):
                hashes = shingle_hashes(data[a:b].tobytes(), words)
                own = np.unique(hashes)
                node.append(node_of(own))
                size.append(len(own))
                prints.append(majority(hashes))
                counts.append(sketch(own))
                told.append(own.view(np.int64) if node[-1] % ORDERED_BY == 0 else None)
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed[0], pa.array(size, pa.int32()), signed[1], pa.array(counts, pa.binary()), pa.array(told, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "n", "fp", "sketch", "told"])

    return in_batches(docs, run, "doc_id long, text_key long, node long, n int, fp long, sketch binary, told array<long>")


def latest(one: DataFrame) -> np.ndarray:
    """The shingles that come last, in their order: by how many of the sets told they stand in, then by hash."""
    counts = one.select(F.explode("told").alias("token")).groupBy("token").agg(F.count("*").alias("d")).filter(F.col("d") > COMMON)
    found = materialize(counts.orderBy(F.desc("d"), "token").limit(MOST_COMMON), "common").toArrow()  # at most MOST_COMMON rows
    token, d = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    return token[np.lexsort((token, d))]


def prefixes(docs: DataFrame, words: int, last: np.ndarray) -> DataFrame:
    """(node, n, prefix) of each of docs (text): the first shingles of its set, where those of ``last`` come behind all others, in their order."""
    by_hash = np.argsort(last)
    held = docs.sparkSession.sparkContext.broadcast((last[by_hash], by_hash))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, place = held.value
        for batch in batches:
            data, at = utf8(batch.column(0))
            node, size, first = [], [], []
            for a, b in zip(at, at[1:], strict=False):
                own = shingle_set(data[a:b].tobytes(), words)
                node.append(node_of(own))
                size.append(len(own))
                if len(common):
                    spot = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    late = common[spot] == own
                    behind = own[late][np.argsort(place[spot[late]])]
                    own = np.concatenate([own[~late], behind])
                first.append(own[: prefix_length(len(own))].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64()))], ["node", "n", "prefix"])

    return in_batches(docs.select("text"), run, "node long, n int, prefix array<long>")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            sets = [shingle_set(data[a:b].tobytes(), words) for a, b in zip(at, at[1:], strict=False)]
            node = np.array([node_of(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return in_batches(docs.select("text"), run, "node long, shingles array<long>")


def entries(docs: DataFrame, one: DataFrame, words: int) -> DataFrame:
    """(token, node, n) for the prefix shingles that more than one node has."""
    spark = docs.sparkSession
    last = latest(one)
    release(spark)
    each = prefixes(docs, words, last).groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))  # equal for equal nodes
    each, path = stored(each, "prefixes")
    release(spark)
    plain = each.select("node", "n", F.explode("prefix").alias("token"))
    shared = few(plain.groupBy("token").agg(F.count("*").alias("d")).filter("d > 1").select("token"), "shared")
    release(spark)
    met = materialize(plain.join(shared, "token").select("token", "node", "n"), "entries")
    discard(spark, path)
    return met


def beside(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) with x and y, the values (node, v) of their ends; the value of a crowded end a goes to as many tasks as it needs."""
    crowd = pairs.groupBy("a").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("parts"))
    left = values.join(crowd, values.node == crowd.a).select("a", F.col("v").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(few(crowd.filter("parts > 1"), "crowd"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    return dealt.join(left, ["a", "part"]).join(values.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")


def hopeful(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows (a, b, x, y: sketches) that may share enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(-1, 256) for c in batch.columns[2:])
            most = np.minimum(x, y).sum(1, dtype=np.int64)
            full = (x == 65535).any(1) | (y == 65535).any(1)
            ok = pa.array((9 * most >= 4 * (x.sum(1, dtype=np.int64) + y.sum(1, dtype=np.int64))) | full)
            yield batch.select(["a", "b"]).filter(ok)

    return in_batches(rows, run, "a long, b long")


class Verifier:
    """Tells which pairs of nodes are links. docs has (KEY, text), one a row for each node with the KEY of its first text."""

    def __init__(self, docs: DataFrame, one: DataFrame, words: int):
        self.docs, self.one, self.words = docs, one, words
        self.sets = docs.sparkSession.createDataFrame([], "node long, shingles array<long>")

    def links(self, pairs: DataFrame) -> DataFrame | None:
        """The links (a, b) among pairs: of those that the sketches allow, those whose whole sets are alike. None if the sketches allow none."""
        pairs, n = counted(hopeful(beside(pairs, self.one.select("node", F.col("sketch").alias("v")))), "hopeful")
        release(self.docs.sparkSession)
        if not n:
            return None
        ends, n = counted(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
        ends = broadcast_if_few(ends, n=n)
        missing = ends.join(self.sets.select("node"), "node", "left_anti")
        keys, n = counted(missing.join(self.one.select("node", *KEY), "node").select(*KEY), "keys")
        if n:
            wanted = self.docs.join(broadcast_if_few(keys, n=n), KEY, "left_semi")
            self.sets = self.sets.union(materialize(whole_sets(wanted, self.words).dropDuplicates(["node"]), "sets"))
            release(self.docs.sparkSession)
        # only the sets of these pairs are shuffled
        values = self.sets.join(ends, "node", "left_semi").withColumnRenamed("shingles", "v")
        return beside(pairs, values).filter(alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b").distinct()


def fingerprint_pairs(one: DataFrame) -> DataFrame:
    """(a, b): nodes that are alike by their fingerprints: each with the first of its own, and the firsts that anchors link."""
    first = materialize(one.groupBy("fp").agg(F.min("node").alias("rep")), "fingerprints")
    own = one.join(first, "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = simhash.links(first.select("fp"), BITS)
    a, b = (first.select(F.col("fp").alias(c), F.col("rep").alias(f"rep_{c}")) for c in "ab")
    return own.union(near.join(a, "a").join(b, "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))


def links(docs: DataFrame, one: DataFrame, words: int) -> DataFrame:
    """(node, root) for nodes of links; docs has (KEY, text), one has a row for each node with its first text."""
    check = Verifier(docs, one, words)
    spark = docs.sparkSession
    edges = spark.createDataFrame([], "a long, b long")
    roots = few(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")

    def merged(pairs: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """edges with the links among pairs, and the components then."""
        found = check.links(pairs)
        if found is None:
            return edges, roots
        new, n = counted(found, "links")
        release(spark)
        if n:
            edges = edges.union(new)
            roots = few(components(edges), "roots")
        release(spark)
        return edges, roots

    edges, roots = merged(materialize(fingerprint_pairs(one), "pairs"), edges, roots)
    met, held = entries(docs, one, words), None
    for k in range(ROUNDS + 1):
        release(spark)
        named = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        hub = F.min_by(F.struct("node", "n", "root"), F.xxhash64("node", F.lit(k))).alias("hub")
        parted = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), hub).filter("low <> high")
        parted, n = counted(parted.select("token", F.col("hub.node").alias("a"), F.col("hub.n").alias("m"), F.col("hub.root").alias("from")), "parted")
        if not n:
            break
        # shingles of one component are done with
        live, path = stored(named.join(broadcast_if_few(parted, n=n), "token"), "live")
        discard(spark, held)
        held = path
        release(spark)
        if k < ROUNDS:
            pairs = live.filter("root <> from")
        else:
            ends = live.select("token", "node", "n", "root")
            pairs = ends.join(ends.select("token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("from")), "token").filter("root <> from AND a < node")
        pairs = pairs.filter(5 * F.least("n", "m") >= 4 * F.greatest("n", "m")).select("a", F.col("node").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        release(spark)
        edges, roots = merged(pairs, edges, roots)
        met = live.select("token", "node", "n")
    return roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, text_key, fp, component_id) for each row of docs; fp is the hash of the text's set of shingles."""
    texts = boxed(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col)
    rows, path = stored(described(texts.select("doc_id", F.col(KEY[2]).alias("text_key"), "text"), words), "described")
    none = F.col("doc_id").isNull()
    first = F.min_by(F.struct("doc_id", "text_key", "n", "fp", "sketch", "told"), F.struct(none, "doc_id", "text_key"))
    one = rows.groupBy("node").agg(first.alias("r")).select("node", "r.*")
    one = materialize(one.withColumns({KEY[0]: none, KEY[1]: F.coalesce("doc_id", F.lit(0)), KEY[2]: F.col("text_key")}), "nodes")
    rows = materialize(rows.select("doc_id", "text_key", "node"), "rows")
    discard(docs.sparkSession, path)
    release(docs.sparkSession)
    roots = links(texts.select(*KEY, "text"), one, words)
    named = one.join(roots, "node", "left").select("node", F.col("doc_id").alias("first_id"), F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = named.join(smallest, "root").select("node", "component_id")
    return rows.join(found, "node").select("doc_id", "text_key", F.col("node").alias("fp"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """docs with one document of each component: the smallest (doc_id, text_key), null ids last."""
    return one_of_each(docs, near_duplicates(docs, id_col, text_col, words), id_col, text_col)
