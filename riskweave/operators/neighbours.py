"""Exact nearest neighbours by cosine: an inverted file of cells and rings, of which a query visits those that may hold one of its nearest.

A few vectors are pivots. Each vector belongs to the cell of its nearest pivot and, by its angle to it, to a ring of that cell; by the triangle inequality no
vector of a ring is closer to a query than their angles to the pivot differ. A query first meets a part of its own ring, whose k-th best similarity is a mark;
then all rings whose bound reaches the mark. So the answer is exact whatever the pivots are; they decide how much is compared.

Memory: pivots and rings (at most ``PIVOTS * RINGS``) are on the driver; rings are cut into parts of about ``ROWS`` vectors, and a task holds one part
while queries pass by it in batches. A crowd of equal vectors is many parts of one ring.

Defined results: similarities are rounded to six places, ties go to the smaller id, a vector is no neighbour of its own id. Rows without an id, and vectors
that are null, empty, zero, of another length than the pivots or hold null or non-finite components take no part. Fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PIVOTS, RINGS, ROWS = 64, 32, 20_000
#: Similarities are compared to six places; bounds get as much room.
PLACES, ROOM = 6, 2e-6
#: Queries that meet a part, or all rings, at once.
BLOCK = 256
PART_BITS = 32
ROW = "place long, query boolean, id long, v array<double>, held array<struct<vec_id:bigint,similarity:double>>"
FOUND = "id long, vec_id long, similarity double"


def units(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of the rows that take part."""
    fit = pc.fill_null(pc.and_(pc.equal(pc.list_value_length(vectors), dim), pc.is_valid(ids)), False)
    v = pc.filter(vectors, fit).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    i = pc.filter(ids, fit).cast(pa.int64()).to_numpy(zero_copy_only=False)
    most = np.abs(v).max(axis=1, initial=0.0)
    good = np.isfinite(most) & (most > 0)  # a null component is not a number, and so is the maximum
    v = v[good] / most[good, None]
    return i[good], v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def angles(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ pivots.T, -1.0, 1.0))


def dealt(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A part below n for each id."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % n


def as_lists(v: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(np.ascontiguousarray(v).ravel()))


class InvertedFile:
    """Pivots, and of each ring its cell, least and largest angle, number of vectors and of parts."""

    def __init__(self, pivots: np.ndarray, rings: list[tuple[int, int, float, float, int]], rows: int = ROWS):
        """rings: (cell, ring, least angle, largest angle, vectors)."""
        self.pivots = pivots
        self.code = np.array([c * RINGS + r for c, r, *_ in rings], np.int64)
        self.cell = self.code // RINGS
        self.low, self.high = (np.array([x[k] for x in rings], float) for k in (2, 3))
        self.size = np.array([x[4] for x in rings], np.int64)
        self.parts = np.maximum(1, -(-self.size // rows))
        self.parts_of = dict(zip(self.code.tolist(), self.parts.tolist(), strict=True))

    @staticmethod
    def codes(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ring code, angle) of each vector."""
        a = angles(v, pivots)
        cell = a.argmin(axis=1)
        near = a[np.arange(len(v)), cell]
        return cell * RINGS + np.minimum((near * (RINGS / np.pi)).astype(np.int64), RINGS - 1), near

    def places(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        code, _ = self.codes(v, self.pivots)
        return (code << PART_BITS) + dealt(ids, np.array([self.parts_of.get(c, 1) for c in code.tolist()], np.int64))

    def gaps(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(angle to the ring's pivot, least angle to any of the ring) for each query and ring."""
        a = angles(v, self.pivots)[:, self.cell]
        return a, np.maximum(0.0, np.maximum(self.low - a, a - self.high))

    def first(self, ids: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The place that each query meets first."""
        a, gap = self.gaps(v)
        ring = (a + 10 * gap).argmin(axis=1)
        return (self.code[ring] << PART_BITS) + dealt(ids, self.parts[ring])

    def visits(self, ids: np.ndarray, v: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, place) of all parts that may hold a similarity of the query's mark or more, but the first."""
        _, gap = self.gaps(v)
        query, ring = np.nonzero(np.cos(gap) >= marks[:, None] - ROOM)
        n = self.parts[ring]
        part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query, place = np.repeat(query, n), (np.repeat(self.code[ring], n) << PART_BITS) + part
        other = place != self.first(ids, v)[query]
        return query[other], place[other]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest of one part for each query."""
    near = np.round(q @ v.T, PLACES) + 0.0
    near[q_ids[:, None] == ids] = -np.inf
    least = np.partition(near, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(q), -2.0)
    for i, row in enumerate(near):
        at = np.flatnonzero(row >= max(least[i], -2.0))
        for j in at[np.lexsort((ids[at], -row[at]))[:k]]:
            yield int(q_ids[i]), int(ids[j]), float(row[j])


def inverted_file(base: DataFrame, pivots: int = PIVOTS, rows: int = ROWS) -> InvertedFile | None:
    """The inverted file of base (vec_id, embedding); None where no vector takes part. Pivots are the vectors with the least hashes of their ids: at most that many
    rows, and at most ``pivots * RINGS`` counts, come to the driver."""
    sizes = base.filter("vec_id is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return None
    dim = sizes[0].n
    clean = base.filter((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    picked = clean.filter("vec_id is not null").orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "embedding").limit(pivots).collect()
    if not picked:
        return None
    _, centres = units(pa.array([r.vec_id for r in picked], pa.int64()), pa.array([r.embedding for r in picked], pa.list_(pa.float64())), dim)

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = units(batch.column(0), batch.column(1), dim)
            code, near = InvertedFile.codes(v, centres)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(near)], ["code", "near"])

    counts = base.select("vec_id", "embedding").mapInArrow(ringed, "code long, near double").groupBy("code").agg(F.min("near").alias("low"), F.max("near").alias("high"), F.count("*").alias("n"))
    # room for the rounding of angles, which is coarse near 0 and pi
    rings = [(r.code // RINGS, r.code % RINGS, max(0.0, r.low - 1e-7), min(np.pi, r.high + 1e-7), r.n) for r in counts.orderBy("code").collect()]
    return InvertedFile(centres, rings, rows)


def nearest(queries: DataFrame, base: DataFrame, k: int = 3, pivots: int = PIVOTS, rows: int = ROWS) -> DataFrame:
    """(id, vec_id, similarity, place): the k nearest of base (vec_id, embedding) for each of queries (vec_id, embedding; ids are unique in both)."""
    spark = base.sparkSession
    held = inverted_file(base, pivots, rows)
    if held is None:
        return spark.createDataFrame([], FOUND + ", place int")
    shared, dim = spark.sparkContext.broadcast(held), held.pivots.shape[1]

    def record(place, query: bool, ids, v, kept=None) -> pa.RecordBatch:
        n, kind = len(ids), pa.list_(pa.struct([("vec_id", pa.int64()), ("similarity", pa.float64())]))
        return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array([query] * n, pa.bool_()), pa.array(ids, pa.int64()), as_lists(v), pa.nulls(n, kind) if kept is None else pa.array(kept, kind)], ["place", "query", "id", "v", "held"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = units(batch.column(0), batch.column(1), dim)
            yield record(shared.value.places(ids, v), False, ids, v)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, v = units(batch.column(0), batch.column(1), dim)
            for i in range(0, len(ids), BLOCK):
                yield record(shared.value.first(ids[i : i + BLOCK], v[i : i + BLOCK]), True, ids[i : i + BLOCK], v[i : i + BLOCK])

    def scan(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """One part after the other: its vectors, then the queries that visit it. The first round hands on each query with what it found and all its visits."""
        at, ids, parts = None, [], []
        for batch in batches:
            places, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            numbers, v = batch.column(2).to_numpy(), batch.column(3).flatten().to_numpy().reshape(-1, dim)
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if a == b:
                    continue
                if places[a] != at:
                    at, ids, parts = places[a], [], []
                if not is_query[a]:
                    ids, parts = [*ids, numbers[a:b]], [*parts, v[a:b]]
                    continue
                if at < 0:  # queries with what they found before
                    rows = [(i, x["vec_id"], x["similarity"]) for i, found in zip(numbers[a:b].tolist(), batch.column(4).slice(a, b - a).to_pylist(), strict=True) for x in found or []]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["id", "vec_id", "similarity"])
                    continue
                if len(parts) > 1:
                    ids, parts = [np.concatenate(ids)], [np.concatenate(parts)]
                for i in range(a, b, BLOCK):
                    q_ids, q = numbers[i : min(b, i + BLOCK)], v[i : min(b, i + BLOCK)]
                    rows = list(best(q_ids, q, ids[0], parts[0], k)) if parts else []
                    if not first:
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["id", "vec_id", "similarity"])
                        continue
                    found: dict[int, list] = {int(n): [] for n in q_ids}
                    for n, other, s in rows:
                        found[n].append({"vec_id": other, "similarity": s})
                    kept = [found[int(n)] for n in q_ids]
                    marks = np.array([x[k - 1]["similarity"] if len(x) >= k else -2.0 for x in kept])
                    yield record(np.full(len(q_ids), -1), True, q_ids, q, kept)
                    who, where = shared.value.visits(q_ids, q, marks)
                    for j in range(0, len(who), 10_000):
                        yield record(where[j : j + 10_000], True, q_ids[who[j : j + 10_000]], q[who[j : j + 10_000]])

    vectors = base.select("vec_id", "embedding").mapInArrow(placed, ROW)
    meet = lambda q: vectors.unionByName(q).repartition("place").sortWithinPartitions("place", "query")
    once = meet(queries.select("vec_id", "embedding").mapInArrow(asked, ROW)).mapInArrow(lambda b: scan(b, True), ROW)
    rows_found = meet(once).mapInArrow(lambda b: scan(b, False), FOUND)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "vec_id"))
    return rows_found.withColumn("place", place).filter(F.col("place") <= k)
