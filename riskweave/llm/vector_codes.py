"""Vector codes: each part of a vector becomes the number of its nearest codebook entry; codebooks by Elkan's Lloyd rounds.

Vectors are scaled to integers and cut into ``parts`` equal consecutive parts. A part position's codebook starts as that part of the
``entries`` vectors of smallest ids. A round assigns every part to its nearest entry (ties to the lower index), then moves each entry to the
componentwise floor of its parts' mean. After the last round parts are assigned once more.

Bounds are kept with each row from round to round: for each part an upper bound of the distance to its entry and a lower bound of that to
every entry, shifted by how far the entries moved. An entry whose lower bound, or half its distance to the part's own entry, is strictly above
the upper bound cannot be nearest and cannot tie; all others are compared by integer squared distances. Bounds are rounded outward: lower ones
to a byte each, in steps of the part's own.

Scale: a round is one pass that writes rows with their bounds, and one that adds them up in each task before sums meet by
(part, entry), so no entry's parts meet in one task; the driver sees codebooks only (``entries`` vectors, whatever the input). The
table of the round before is removed. Rows that are added up after loss of an executor are read from that table.

Defined results: rows whose vector is null, empty or holds a null, non-finite or huge component (2^24 and more after scaling), or is not as
long as that of the smallest id, are dropped; with fewer rows than entries codebooks are shorter; equal ids are ordered by their vectors, null ids
come last; repeated rows count each; an empty table gives no rows; null labels are one label; further columns may have any name. Where
the length is no multiple of ``parts``, part i ends at floor((i + 1) * length / parts).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_few, discard, in_batches, materialize, quoted, spread_out, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = 1 << 24
#: Relative room for rounding in bounds; rows of a numpy step; distances of a numpy step; keys of a hot label.
ROOM, ROWS, PAIRS, SALTS = 1e-9, 2048, 200_000, 16


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * i // parts, width * (i + 1) // parts) for i in range(parts)]


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, exact: below 2^53 in floats, else in integers."""
    most = max(1, int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    kind = np.float64 if 4 * most * most * x.shape[1] < 1 << 53 else np.int64
    a, b = x.astype(kind), y.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def packed_down(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds as bytes times a step of their row, never above them."""
    step = lower.max(1) / 255
    safe = np.where(step > 0, step, 1)
    return np.minimum(np.floor(lower / safe[:, None] * (1 - ROOM)), 255).astype(np.uint8), safe.astype(np.float64)


class Codebook:
    """The entries of one part position, with how far each moved since bounds were kept."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before) ** 2).sum(1)) * (1 + ROOM)
        self.half = np.sqrt(squared(entries, entries)) / 2 * (1 - ROOM)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper, lower) of parts without bounds."""
        d = squared(x, self.entries)
        at = d.argmin(1)
        return at, np.sqrt(d[np.arange(len(x)), at]) * (1 + ROOM), np.sqrt(d) * (1 - ROOM)

    def own(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((x - self.entries[at]) ** 2).sum(1)

    def again(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(entry, upper, lower) from those of the round before."""
        at, upper, lower = at.copy(), upper + self.moved[at], np.maximum(lower - self.moved[None, :], 0)
        rows = np.arange(len(x))
        bound = np.maximum(lower, self.half[at])
        bound[rows, at] = np.inf
        loose = np.flatnonzero(bound.min(1) <= upper)
        exact = self.own(x[loose], at[loose])
        upper[loose] = np.sqrt(exact) * (1 + ROOM)
        r, c = np.nonzero(bound[loose] <= upper[loose][:, None])
        found = np.full((len(loose), len(self.entries)), np.iinfo(np.int64).max)
        for i in range(0, len(r), PAIRS):
            j = slice(i, i + PAIRS)
            found[r[j], c[j]] = ((x[loose[r[j]]] - self.entries[c[j]]) ** 2).sum(1)
        lower[loose[r], c] = np.sqrt(found[r, c]) * (1 - ROOM)
        lower[loose, at[loose]] = np.sqrt(exact) * (1 - ROOM)
        found[np.arange(len(loose)), at[loose]] = exact
        at[loose] = found.argmin(1)
        upper[loose] = np.sqrt(found.min(1)) * (1 + ROOM)
        return at, upper, lower


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long lists or byte strings as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)
    data = np.frombuffer(b"".join(column.to_pylist()), kind)
    return data.reshape(len(column), width)


STATE = "vec_id long, v array<int>, at binary, upper binary, step binary, lower binary"


def kept_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None, scale: int) -> DataFrame:
    """(vec_id, label, v): rows with a usable vector, scaled to integers."""
    x = quoted(vector_col)
    fits = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LARGEST)), F.lit(False)) & (F.size(x) > 0)
    label = F.lit(None).cast("int") if label_col is None else quoted(label_col)
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), label.alias("label"), F.when(fits, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int"))).alias("v"))
    return rows.filter("v is not null")


def first_entries(rows: DataFrame, entries: int) -> np.ndarray:
    """The vectors of the smallest ids, at most ``entries`` of them; a first look says which length counts."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.select("vec_id", "v").orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((0, 0), np.int64)
    width = len(first[0].v)
    return np.array([r.v for r in rows.filter(F.size("v") == width).select("vec_id", "v").orderBy(*order).limit(entries).collect()], np.int64)


def assigned(rows: DataFrame, books: list[Codebook], width: int, last: bool) -> DataFrame:
    """rows with entries and bounds (last: with entries and their squared distances); rows have bounds already, or none in the first round."""
    places, k = cuts(width, len(books)), len(books[0].entries)
    bounded = "lower" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), ROWS):
                batch = whole.slice(a, ROWS)
                v = matrix(batch.column(1), np.int64, width)
                if bounded:
                    held = [matrix(batch.column(2), np.uint16, len(books)), matrix(batch.column(3), np.float64, len(books)), matrix(batch.column(4), np.float64, len(books)), matrix(batch.column(5), np.uint8, len(books) * k)]
                out: list[list[np.ndarray]] = [[], [], [], []]
                error = np.zeros(len(batch), np.int64)
                for p, (book, (low, high)) in enumerate(zip(books, places, strict=True)):
                    x = v[:, low:high]
                    if bounded:
                        lower = held[3][:, p * k : (p + 1) * k] * held[2][:, p][:, None] * (1 - ROOM)
                        at, upper, lower = book.again(x, held[0][:, p].astype(np.int64), held[1][:, p], lower)
                    else:
                        at, upper, lower = book.nearest(x)
                    out[0].append(at.astype(np.uint16))
                    if last:
                        error += book.own(x, at)
                    else:
                        small, step = packed_down(lower)
                        for x, y in zip(out[1:], (upper, step, small), strict=True):
                            x.append(y)
                at = np.stack(out[0], 1)
                if last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["".join(f"{c:02x}" for c in row) for row in at.tolist()], pa.string()), pa.array(error)], ["vec_id", "code", "error"])
                else:
                    blocks = [at, np.stack(out[1], 1), np.stack(out[2], 1), np.concatenate(out[3], 1)]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r.tobytes() for r in b], pa.binary()) for b in blocks]], ["vec_id", "v", "at", "upper", "step", "lower"])

    return in_batches(rows, run, "vec_id long, code string, error long" if last else STATE)


def moved(state: DataFrame, books: list[Codebook], width: int) -> list[Codebook]:
    """The codebooks after the rows of state are averaged; entries without rows stay."""
    places, k = cuts(width, len(books)), len(books[0].entries)
    widest = max(b - a for a, b in places)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(books), k, widest), np.int64), np.zeros((len(books), k), np.int64)
        for batch in batches:
            v, at = matrix(batch.column(0), np.int64, width), matrix(batch.column(1), np.uint16, len(books)).astype(np.int64)
            for p, (a, b) in enumerate(places):
                np.add.at(total[p, :, : b - a], at[:, p], v[:, a:b])
                n[p] += np.bincount(at[:, p], minlength=k)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(n[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    sums = in_batches(state.select("v", "at"), add, "part long, entry long, n long, total array<long>")
    summed = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(widest)]).alias("total")).collect()
    new = [b.entries.copy() for b in books]
    for r in summed:
        new[r.part][r.entry] = np.array(r.total[: new[r.part].shape[1]], np.int64) // r.n
    return [Codebook(x, b.entries) for x, b in zip(new, books, strict=True)]


def digest(books: list[Codebook]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Rows (vec_id, label, code, error, label_error, codebooks_sha256), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number has two hex digits")
    rows = materialize(kept_rows(vectors, id_col, vector_col, label_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = first_entries(rows, entries)
    width = first.shape[1]
    books = [Codebook(first[:, a:b]) for a, b in cuts(width, parts)]
    rows = rows.filter(F.size("v") == width)
    if not len(first):
        empty = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return empty, []
    # the row's number stands for its id until labels come back
    state, path = spread_out(rows.select(F.col("row").alias("vec_id"), "v")), None
    for _ in range(rounds):
        state, new = stored(assigned(state, books, width, False), "bounds")
        discard(state.sparkSession, path)
        path = new
        books = moved(state, books, width)
    last = materialize(assigned(state, books, width, True).withColumnRenamed("vec_id", "row"), "codes")
    discard(state.sparkSession, path)
    found = materialize(rows.select("row", "vec_id", "label").join(last, "row").drop("row"), "coded")
    by_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    few = broadcast_if_few(materialize(by_label, "labels"))
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    side = few.select(F.col("label").alias("other"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("slot"))
    met = found.withColumn("salt", salt).join(side, F.col("label").eqNullSafe(F.col("other")) & (F.col("salt") == F.col("slot")))
    return met.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), [b.entries for b in books]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))[0].drop("label")


def oracle() -> str:
    """DuckDB SQL: the rounds written out, with all distances."""
    distance = "list_sum(list_transform(list_zip(x, y), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, * FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0))",
        f"piece AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM piece WHERE r <= {ENTRIES})",
    ]
    for i in range(ROUNDS + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, q.p, any_value(x) AS x, min({distance} * {ENTRIES} + e) AS m FROM piece q JOIN c{i} c ON q.p = c.p GROUP BY r, q.p)")
        if i < ROUNDS:
            ctes.append(f"s{i} AS (SELECT p, m % {ENTRIES} AS e, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{i})")
            ctes.append(f"f{i} AS (SELECT p, e, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS y FROM s{i} GROUP BY p, e, j)")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.y, c.y) AS y FROM c{i} c LEFT JOIN (SELECT p, e, list(y ORDER BY j) AS y FROM f{i} GROUP BY p, e) n ON n.p = c.p AND n.e = c.e)")
    return f"""
WITH {", ".join(ctes)},
coded AS (SELECT r, string_agg(lower(lpad(hex(m % {ENTRIES}), 2, '0')), '' ORDER BY p) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), book
"""
