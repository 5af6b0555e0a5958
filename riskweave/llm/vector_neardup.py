"""Embedding near-duplicates by randomised-rotation binary codes.

A unit vector x is rotated at random and becomes a code c, one sign a dimension. Stored beside it are the correction factors f = <c, x>, the
rotated vector in four bits a dimension, and e, the length of what those bits lose. For a pair, g = <c, y> is computed from a code and four bits
within e. g / f is an unbiased estimate of <x, y> with deviation sqrt((1 - f^2) / (f^2 (D - 1))); and by angles <x, y> is at most
cos(acos g - acos f), whatever the rotation. A pair whose upper bounds, from either side, reach the threshold is computed again from the vectors in
double precision, and only that decides; a pair below them is dropped.

Pairs to estimate come from tables: each takes some signs of the code and of three more rotations as a key, and vectors that agree in them form a tile. The number of bits
grows with the logarithm of the vectors, so that tiles keep their size; the number of tables is such that a pair at the threshold misses all with
probability ``MISS``. A pair counts in the first table where it meets and nowhere else.

Scale: equal vectors are one row before anything is compared and count by their number. Tables shuffle codes, not vectors. A tile of over ``TILE``
members is cut into blocks of one part against one part, each a task's matrix product. Blocks report the members that need recomputation, and
vectors are joined to those only; the exact pass reports a count for each member and the forest its links span, so no list of pairs is written
even within a group of near copies, whose pairs all have to be computed to be counted.

Defined results: null and empty vectors, zero vectors and those with null or non-finite components link with nothing, nor do vectors of
different length; null ids stay rows, count as links, and name no component unless nothing else is there (null); repeated rows are rows of their
own; a row stays (kept) if its id names its component; an empty table gives no rows; further columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, in_batches, materialize, quoted, spread_out, table
from .simhash_neardup import components, forest

THRESHOLD = 0.95
#: Members of a block; chance that a pair at the threshold meets in no table; deviations of the estimate that count as possible; keys of a hot vector.
TILE, MISS, DEVIATIONS, SALTS = 1024, 1e-5, 6.0, 16
SEED = 20
#: Rotations whose signs the tables choose from.
TURNS = 4
ROWS = 1024


def padded(size: int) -> int:
    return -(-size // 64) * 64


@cache
def rotations(size: int) -> np.ndarray:
    """Random orthogonal matrices side by side for vectors of this length, padded to whole words of 64 signs. The first makes the code."""
    rng, found = np.random.default_rng(SEED + size), []
    for _ in range(TURNS):
        q, r = np.linalg.qr(rng.standard_normal((padded(size), padded(size))))
        found.append((q * np.sign(np.diag(r)))[:size])
    return np.concatenate(found, 1)


@cache
def masks(size: int, bits: int, tables: int) -> np.ndarray:
    """For each table the positions of signs that make its key."""
    rng = np.random.default_rng(SEED + size)
    return np.stack([rng.permutation(padded(size) * TURNS)[:bits] for _ in range(tables)])


def plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a key, tables) for n different vectors."""
    bits = min(32, max(0, math.ceil(math.log2(max(n, 1) / (TILE / 2)))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, 1 if bits == 0 else min(500, math.ceil(math.log(MISS) / math.log1p(-meet)))


def unit(column: pa.Array, size: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    v = v / np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay finite
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def by_length(batch: pa.RecordBatch, lengths: pa.Array) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = lengths.to_numpy()
    for size in np.unique(sizes).tolist():
        rows = batch.filter(pa.array(sizes == size)) if (sizes != size).any() else batch
        for a in range(0, len(rows), ROWS):
            yield size, rows.slice(a, ROWS)


CODES = "node long, size int, code binary, quarter binary, step float, f float, e float"


def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, size, v) as CODES."""
    for whole in batches:
        for size, batch in by_length(whole, whole.column(1)):
            y = unit(batch.column(2), size) @ rotations(size)
            code = np.packbits(y > 0, axis=1, bitorder="little")
            y = y[:, : padded(size)]
            step = np.abs(y).max(1) / 7
            q = np.rint(y / step[:, None])
            lost = np.sqrt(((y - q * step[:, None]) ** 2).sum(1))
            u = (q + 8).astype(np.uint8)
            quarter = u[:, ::2] | (u[:, 1::2] << 4)
            f = np.abs(y).sum(1) / math.sqrt(y.shape[1])
            rows = [pa.array([r.tobytes() for r in x], pa.binary()) for x in (code, quarter)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *rows, *[pa.array(x, pa.float32()) for x in (step, f, lost)]], ["node", "size", "code", "quarter", "step", "f", "e"])


def stacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def least_product(f: np.ndarray, dims: int, threshold: float, deviations: float) -> np.ndarray:
    """The g below which a pair with a code of factor f is under the threshold: surely by angles, or by ``deviations`` of the estimate."""
    f = f.astype(np.float64)
    sure = np.cos(np.minimum(np.pi, np.arccos(np.minimum(f, 1)) + math.acos(threshold)))
    likely = threshold * f - deviations * np.sqrt(np.maximum(0, 1 - f * f) / max(1, dims - 1))
    return np.maximum(sure, likely) - 1e-5


class Tables:
    """Keys of the tables, and the table in which a pair counts."""

    def __init__(self, bits: int, tables: int):
        self.bits, self.tables = bits, tables

    def keys(self, code: np.ndarray, size: int) -> Iterator[np.ndarray]:
        signs = np.unpackbits(code, axis=1, bitorder="little").astype(np.int64)
        for t, places in enumerate(masks(size, self.bits, self.tables)):
            yield (signs[:, places] << np.arange(self.bits)).sum(1) | (t << 32) | (size << 41)

    def first(self, t: int, x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        """Whether pairs of codes differ in the keys of all tables before t."""
        apart, words = np.ones(len(x), bool), x.view(np.uint64) ^ y.view(np.uint64)
        for places in masks(size, self.bits, self.tables)[:t]:
            mask = np.zeros(x.shape[1] * 8, np.uint8)
            mask[places] = 1
            apart &= (words & np.packbits(mask, bitorder="little").view(np.uint64)).any(1)
        return apart


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of sorted batches by equal values of the first ``keys`` columns."""
    rest: pa.Table | None = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if rest is not None:
            part = pa.concat_tables([rest, part])
        if not len(part):
            continue
        key = np.stack([part.column(i).to_numpy() for i in range(keys)], 1)
        new = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1])
        for a, b in zip(new, new[1:], strict=False):
            yield part.slice(a, b - a).combine_chunks()
        rest = part.slice(new[-1])
    if rest is not None and len(rest):
        yield rest.combine_chunks()


def sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of a block's two sides; of a part against itself both are all rows."""
    low, high, part = (int(block.column(1)[0].as_py()), int(block.column(2)[0].as_py()), block.column("part").to_numpy())
    if low == high:
        return np.arange(len(part)), np.arange(len(part)), True
    return np.flatnonzero(part == low), np.flatnonzero(part == high), False


def whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


BLOCK = "tile long, low int, high int, part int, node long"


def estimated(tables: Tables, threshold: float, deviations: float):
    """Blocks of codes: BLOCK rows of the members that some pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 3):
            if len(block) < 2:
                continue
            tile = int(block.column(0)[0].as_py())
            size, t = tile >> 41, tile >> 32 & 511
            code = stacked(whole(block.column("code")))
            quarter = stacked(whole(block.column("quarter")))
            dims = padded(size)
            signs = (2 * np.unpackbits(code, axis=1, count=dims, bitorder="little").astype(np.float32) - 1) / np.float32(math.sqrt(dims))
            y = np.empty((len(code), dims), np.float32)
            y[:, ::2], y[:, 1::2] = quarter & 15, quarter >> 4
            y = (y - 8) * block.column("step").to_numpy()[:, None]
            e, least = block.column("e").to_numpy(), least_product(block.column("f").to_numpy(), dims, threshold, deviations).astype(np.float32)
            left, right, same = sides(block)
            needed = np.zeros(len(block), bool)
            for a in range(0, len(left), ROWS):
                i = left[a : a + ROWS]
                near = (signs[i] @ y[right].T + e[right][None, :] >= least[i][:, None]) & (y[i] @ signs[right].T + e[i][:, None] >= least[right][None, :])
                x, z = np.nonzero(near & (i[:, None] < right[None, :]) if same else near)
                x, z = i[x], right[z]
                pairs = tables.first(t, code[x], code[z], size)
                needed[x[pairs]] = needed[z[pairs]] = True
            found = block.select(["tile", "low", "high", "part", "node"]).filter(pa.array(needed))
            yield from found.to_batches()

    return run


def recomputed(tables: Tables, threshold: float):
    """Blocks of vectors: (a, n, b): links of member a in this block with b null, and the forest of links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, 3):
            tile = int(block.column(0)[0].as_py())
            size, t = tile >> 41, tile >> 32 & 511
            code, u = stacked(whole(block.column("code"))), unit(whole(block.column("v")), size)
            node, copies = block.column("node").to_numpy(), block.column("copies").to_numpy()
            left, right, same = sides(block)
            n = np.zeros(len(block), np.int64)
            x, z = np.nonzero(u[left] @ u[right].T >= threshold)
            x, z = left[x], right[z]
            if same:
                x, z = x[x < z], z[x < z]
            first = tables.first(t, code[x], code[z], size)
            x, z = x[first], z[first]
            np.add.at(n, x, copies[z])
            np.add.at(n, z, copies[x])
            some = np.flatnonzero(n)
            if len(some):
                a, b = forest(node[x], node[z])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], a])), pa.array(np.concatenate([n[some], np.zeros(len(a), np.int64)])), pa.array([None] * len(some) + b.tolist(), pa.int64())], ["a", "n", "b"])

    return run


def links(distinct: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, deviations: float = DEVIATIONS, shape: tuple[int, int] | None = None) -> DataFrame:
    """(a, n, b) rows: where b is null, a has n more links (copies counted); else a and b are linked, and such edges connect what links do.

    distinct (node, size, v, copies) has one row for each different vector and is cheap to read.
    """
    tables = Tables(*(shape or plan(distinct.count(), threshold)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for size, batch in by_length(whole_batch, whole_batch.column(1)):
                for key in tables.keys(stacked(batch.column(2)), size):
                    yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), *batch.columns[2:]], ["tile", "node", "code", "quarter", "step", "f", "e"])

    coded = materialize(in_batches(spread_out(distinct.select("node", "size", "v")), codes, CODES), "codes")
    rows = in_batches(coded, spread, "tile long, node long, code binary, quarter binary, step float, f float, e float")
    sizes = rows.groupBy("tile").agg(F.count("*").alias("n"))
    crowded = broadcast_if_few(materialize(sizes.filter(F.col("n") > tile), "crowded"))
    dealt = rows.join(crowded, "tile", "left").withColumn("parts", F.ceil(F.coalesce("n", F.lit(1)) / tile).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = ["tile", "low", "high"]
    dealt = dealt.select("tile", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "code", "quarter", "step", "f", "e")
    needed = materialize(in_batches(dealt.repartition(*block).sortWithinPartitions(*block), estimated(tables, threshold, deviations), BLOCK), "needed")
    vectors = distinct.select("node", "v", "copies").join(coded.select("node", "code"), "node")
    again = needed.join(vectors, "node").select(*block, "part", "node", "code", "v", "copies")
    return in_batches(again.repartition(*block).sortWithinPartitions(*block), recomputed(tables, threshold), "a long, n long, b long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    x = quoted(vector_col)
    usable = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & F.exists(x, lambda c: c != 0)
    v = F.when(usable, F.transform(x, lambda c: c.cast("double") + 0.0))
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumns({"one": F.xxhash64("v"), "two": F.xxhash64(F.lit(SEED), "v")})
    # equal vectors, by 128 bits of hash
    equal = rows.filter("v is not null").groupBy("one", "two").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id"), F.first("v").alias("v"))
    distinct = materialize(equal.withColumn("node", F.monotonically_increasing_id()).withColumn("size", F.size("v")), "distinct")
    found = materialize(links(distinct.select("node", "size", "v", "copies"), **how), "links")
    roots = components(found.filter("b is not null").select("a", "b"))
    counts = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    named = distinct.select("node", "one", "two", "copies", "first_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    nodes = named.join(smallest, "root").join(counts, F.col("node") == F.col("a"), "left")
    nodes = nodes.select("one", "two", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("slot"))
    # rows of a hot vector are dealt over SALTS keys
    out = rows.select("vec_id", F.col("v").isNotNull().alias("usable"), F.when(F.col("v").isNotNull(), F.col("one")).otherwise(F.xxhash64("vec_id")).alias("one"), "two", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("slot"))
    met = out.join(nodes.withColumn("usable", F.lit(True)), ["usable", "one", "two", "slot"], "left")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return met.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    """DuckDB SQL over all pairs."""
    return f"""
WITH RECURSIVE usable AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT x.r AS a, y.r AS b, y.vec_id AS id FROM usable x JOIN usable y ON x.r <> y.r AND len(x.v) = len(y.v) AND CASE WHEN len(x.v) = len(y.v) THEN list_cosine_similarity(x.v, y.v) END >= {THRESHOLD}),
reach AS (SELECT r AS a, r AS b FROM usable UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
component AS (SELECT a, min(vec_id) AS id FROM reach JOIN usable u ON u.r = reach.b GROUP BY a),
found AS (SELECT u.vec_id, (SELECT count(*) FROM link WHERE link.a = u.r) AS n_links, c.id AS component_id FROM usable u JOIN component c ON c.a = u.r
  UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(embedding, lambda x: x <> 0)) = 0)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM found
"""
