"""Spelling variants: words that are one edit apart, grouped under their most frequent form, by errata-trie merging.

Words and their numbers come from all texts. The words form a trie; of the edges that leave a node the one with most words is heavy, the
others are light, so a word has at most log2(words) light edges on its path. At each node the light subtrees are merged, small to large,
into what they may meet with one error: a word on a light edge is looked up in the tree with its branching character replaced by the
heavy one, skipped, or preceded by the heavy one, and meets the words of other light edges with that character as a wildcard. Two words one edit
apart part at one node, and at least one of them leaves it by a light edge, so each such pair is a terminal of two merged trees.

Scale: nodes are hashes of prefixes, counted with partial aggregation; no task holds a trie. Nodes with many words (the root, common first
letters) are broadcast if there are few and else salted, so no key of the join holds many rows. A merged word costs three lookups for each light
edge, joined on whole strings: a hash that collides may only choose another heavy edge. At a wildcard at most one word for each
letter meets. Texts are counted in tasks that hand over their counts at ``HELD`` words.

Defined results: null, empty and letterless texts have no words; a null doc_id changes no word; a repeated row counts twice; very long
texts and words are read whole; an empty table gives no rows; further columns may have any name. Of near words with equal n the smallest in
code-point order is the form.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_batches, materialize, quoted, steps, table, utf8

#: Of so many changed words one loses a code point; code points of the shortest word; occurrences of the rarest.
ONE_IN, SHORTEST, LEAST = 31, 7, 2
#: A form has at least so many times the word's occurrences.
TIMES = 10
#: Different words that a counting task holds; longer runs (bytes) are hashed alone.
HELD, LONG = 400_000, 64
#: Words of a large node, at least (and a 500th of all); large nodes that are broadcast; keys over which such nodes are dealt where they are more.
MANY, FEW, SALTS = 1000, 100_000, 32
LEAD = 0xC3
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[LEAD] = True
CRC = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], np.uint32)


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs of UTF-8 rows (lower-cased), and the code points before each byte."""
    inside = LETTER[data]
    inside[1:] |= data[:-1] == LEAD
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return starts, ends, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of each run after what ``before`` is the crc32 of."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -LONG))
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    order = order[long:]
    value, first, size = ~before[order], starts[order], size[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))
        value[:n] = CRC[(value[:n] ^ data[first[:n] + j]) & 0xFF] ^ (value[:n] >> np.uint32(8))
    out[order] = ~value
    return out


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as an Arrow column."""
    size = ends - starts
    offsets = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[where])])


def without_one(run: str, h: int) -> str:
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def words_of(ids: list, data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The words of at least SHORTEST code points of some rows, with the deletions that the ids and runs decide."""
    data = LOWER[data]
    starts, ends, points = runs(data, at)
    keep = points[ends] - points[starts] >= SHORTEST
    starts, ends = starts[keep], ends[keep]
    row = np.searchsorted(at, starts, side="right") - 1
    before = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = checksums(data, starts, ends, before[row])
    known = np.array([i is not None for i in ids], bool)
    cut = (h % ONE_IN == 0) & known[row]
    changed = [without_one(data[starts[i] : ends[i]].tobytes().decode(), int(h[i])) for i in np.flatnonzero(cut & (points[ends] - points[starts] > SHORTEST))]
    return pa.concat_arrays([gathered(data, starts[~cut], ends[~cut]), pa.array(changed, pa.large_utf8())])


def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def batches(found: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from found.cast(pa.schema([("word", pa.string()), ("n", pa.int64())])).combine_chunks().to_batches(max_chunksize=50_000)

    total = 0
    for batch in rows:
        ids, (data, at) = batch.column(0).to_pylist(), utf8(batch.column(1))
        for a, b in steps(at):
            words = words_of(ids[a:b], data[at[a] : at[b]], at[a : b + 1] - at[a])
            found = pc.value_counts(words)
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            total += len(found)
            if total > HELD:
                held = [merged()]
                total = len(held[0])
                if total > HELD // 2:
                    yield from batches(held.pop())
                    total = 0
    if held:
        yield from batches(merged())


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of docs with at least LEAST occurrences."""
    rows = in_batches(docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text")), counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words as their code points, one byte each, and n + 1 offsets."""
    data, at = utf8(column)
    tail = np.concatenate([[False], data[:-1] == LEAD]) if len(data) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(data == LEAD)])
    return np.where(tail, data + 0x40, data)[data != LEAD].astype(np.uint8), at - before[at]


def shared_prefix(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that each word shares with the next one."""
    n = len(at) - 2
    size, out, alive = np.diff(at), np.zeros(max(n, 0), np.int64), np.arange(max(n, 0))
    least = np.minimum(size[:-1], size[1:]) if n > 0 else out
    depth = 0
    while len(alive):
        alive = alive[least[alive] > depth]
        alive = alive[code[at[alive] + depth] == code[at[alive + 1] + depth]]
        depth += 1
        out[alive] = depth
    return out


def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, edge, depth, id) for each word and each prefix of it down to where it parts from both its neighbours: words come sorted, and deeper nodes have one word."""
    for batch in batches:
        if not len(batch):
            continue
        (code, at), ids = letters(batch.column(0)), batch.column(1).to_numpy()
        size = np.diff(at)
        shared = shared_prefix(code, at)
        # the neighbours of a batch's first and last word are not known here
        deep = np.minimum(size, np.maximum(np.concatenate([size[:1], shared]), np.concatenate([shared, size[-1:]]))) + 1
        for a, b in steps(np.concatenate([[0], np.cumsum(deep)]), 500_000):
            first = np.concatenate([[0], np.cumsum(deep[a:b])])
            node, edge, depth = np.zeros(first[-1], np.uint64), np.full(first[-1], -1, np.int32), np.zeros(first[-1], np.int32)
            h, alive = np.full(b - a, 0x9E3779B97F4A7C15, np.uint64), np.arange(b - a)
            d = 0
            while len(alive):
                node[first[alive] + d], depth[first[alive] + d] = h[alive], d
                alive = alive[size[a + alive] > d]
                here = code[at[a + alive] + d]
                edge[first[alive] + d] = here
                alive, here = alive[deep[a + alive] > d + 1], here[deep[a + alive] > d + 1]
                mixed = (h[alive] ^ here.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                h[alive] = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                d += 1
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(edge), pa.array(depth), pa.array(np.repeat(ids[a:b], deep[a:b]))], ["node", "edge", "depth", "id"])


def light_edges(words: DataFrame) -> DataFrame:
    """(id, light): for each word with light edges on its path their depths and the heavy edges beside them. Words have ids in column id."""
    rows = in_batches(words.select("word", "id").repartitionByRange("word").sortWithinPartitions("word"), prefix_rows, "node long, edge int, depth int, id long")
    edges = rows.groupBy("node", "edge").agg(F.count("*").alias("n"))
    nodes = edges.groupBy("node").agg(F.count("*").alias("edges"), F.sum("n").alias("n"), F.max(F.struct("n", -F.col("edge"))).alias("top")).filter("edges > 1")
    nodes = materialize(nodes.select("node", "n", (-F.col("top").getField("col2")).alias("heavy")), "branching")
    large = nodes.filter(F.col("n") >= max(MANY, words.count() // 500)).select("node", "heavy")
    small = nodes.join(large, "node", "left_anti").select("node", "heavy") if large.limit(1).count() else nodes.select("node", "heavy")
    if large.limit(FEW + 1).count() <= FEW:
        met = rows.join(F.broadcast(large), "node").unionByName(rows.join(F.broadcast(large), "node", "left_anti").join(small, "node"))
    else:
        salted = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("node", "heavy", "salt")
        met = rows.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(salted, ["node", "salt"])
    return met.filter("edge <> heavy").groupBy("id").agg(F.collect_set(F.struct("depth", "heavy")).alias("light"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b): each pair of words one edit apart, once for each order. words (word, n) are distinct and cheap to read."""
    words = words.select("word", "n", F.xxhash64("word").alias("id"))
    # words that share an id share their light edges: too many lookups, which find nothing wrong
    merged = words.join(light_edges(words), "id").select("word", "n", F.explode("light").alias("at")).select("word", "n", "at.depth", "at.heavy")
    depth, size = F.col("depth"), F.length("word")
    head, heavy = F.substring("word", F.lit(1), depth), F.when(F.col("heavy") >= 0, F.chr(F.col("heavy").cast("long")))
    rest, after = F.substring("word", depth + 1, size), F.substring("word", depth + 2, size)
    inside: Column = depth < size
    found = [F.when(inside, F.concat(head, after)), F.concat(head, heavy, rest), F.when(inside, F.concat(head, heavy, after))]
    looked = merged.select("word", "n", F.explode(F.array(*found)).alias("key")).filter("key is not null")
    known = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"))
    one = looked.join(known, looked.key == known.b).select(F.col("word").alias("a"), "b", F.col("n").alias("n_a"), "n_b").filter("a <> b")
    wild = merged.filter(inside).select("word", "n", F.concat(head, F.lit("\0"), after).alias("key"))
    met = wild.groupBy("key").agg(F.collect_set(F.struct("word", "n")).alias("met")).filter(F.size("met") > 1)
    both = met.select(F.explode("met").alias("x"), "met").select("x", F.explode("met").alias("y"))
    two = both.filter("x.word < y.word").select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"))
    pairs = one.unionByName(two).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(F.col("a") < F.col("b"), F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"))
    pairs = pairs.distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of docs."""
    words = materialize(vocabulary(docs, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = near_pairs(words).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= TIMES * F.col("n")
    found = words.join(near, words.word == near.a, "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))
    found = materialize(found, "forms")
    # each form has ten times the occurrences, so chains are short; each round doubles what is followed
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = materialize(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not roots.filter("moved").limit(1).count():
            break
        roots = roots.select("word", "root")
    return found.join(roots.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL: crc32 by a folded table, pairs by wildcards and deletions, chains by recursion."""
    byte_table = "list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {byte_table} AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n, doc_id::VARCHAR || ':' || run AS named FROM run WHERE length(run) >= {SHORTEST} GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, flatten(list_transform(string_split(named, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM own),
hashed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {LEAST}),
place AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word),
wild AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS k FROM place),
less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM place),
pair AS (
  SELECT x.word AS a, y.word AS b, y.n AS n FROM wild x JOIN wild y ON x.k = y.k AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM less x JOIN word y ON x.k = y.word
  UNION SELECT y.word, x.word, x.n FROM less x JOIN word y ON x.k = y.word),
best AS (SELECT a, count(*) AS n_near, arg_min(b, (-n, b)) AS b, max(n) AS n FROM pair GROUP BY a),
form AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN s.n >= {TIMES} * w.n THEN s.b END AS form, CASE WHEN s.n >= {TIMES} * w.n THEN s.n END AS form_n FROM word w LEFT JOIN best s ON s.a = w.word),
chain AS (SELECT word, word AS root, form FROM form UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN form f ON f.word = c.form)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM form f JOIN chain c ON c.word = f.word AND c.form IS NULL
"""
