"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters, digits and non-ASCII characters of the lower-cased text, hashed to 64 bits. A spaced seed
hashes the tokens at the ones of a fixed mask and ignores those at its zeros. Seeds of test items and of documents
are joined; around each hit the two texts are compared token by token on the hit's diagonal, and a document is
contaminated by an item if some run of ``WINDOW`` tokens agrees in at least ``SHARE`` of them. The two masks are chosen so
that every such run has a hit (tests check all placements of substitutions), so nothing is missed. Items of fewer than
``WINDOW`` tokens must occur whole and unchanged; items of fewer than ``LEAST`` tokens are not searched for.

Scale: one pass over the documents keeps only the places whose seeds pass a bitmap of the test seeds (at most
``MOST_BITS`` bits; a fuller bitmap lets more through and changes no result). Those places and the tokens around them are
written; hits join test seeds by hash, and clusters are compared with items. Whole documents are never shuffled. A seed of very
many hits is one join key; the hits' side is split by adaptive execution where the test seeds are too many to be broadcast.

Defined results: null and empty texts have no tokens; null ids and repeated rows are judged as any other row; an item
with a null id is searched for; empty tables give no rows, and no document is contaminated by an empty benchmark; very long
texts are searched whole; further columns of either table may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, boxed, broadcast_if_few, in_batches, materialize, quoted, steps, table, unboxed, utf8

WINDOW, SHARE, LEAST = 13, 0.8, 5
MASKS = ("11110011", "11010111")
MOST_BITS, PROBES = 1 << 26, 6
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
UNBASE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=8)
def _powers(base: int, log: int) -> np.ndarray:
    out = np.full(1 << log, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** n modulo 2 ** 64."""
    return _powers(base, int(n).bit_length())[: n + 1]


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each range."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values))[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(UNBASE, len(values))[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def token_bounds(data: np.ndarray, at: np.ndarray, word_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of some texts, one after the other, start and end; no token reaches into the next text."""
    word = word_byte[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    full = at[:-1][np.diff(at) > 0]
    before[full] = False
    after[full[1:] - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def token_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of some texts, and the first token of each text (and the end)."""
    starts, ends = token_bounds(data, at, WORD_BYTE)
    return rolled(data.astype(np.uint64) + np.uint64(1), starts, ends), np.searchsorted(starts, at)


def seeds(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A seed for each place where the mask fits."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, hash_of_mask(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = mixed(out * np.uint64(BASE) + tokens[i : i + n])
    return out


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 0xA24BAED4963EE407 % (1 << 64)


def item_masks(n: int) -> tuple[str, ...]:
    return MASKS if n >= WINDOW else ("1" * n,) if n >= LEAST else ()


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """doc[shift + j] against item[j]: first token, length and agreeing tokens of what the good windows span."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    width = min(WINDOW, len(item))
    if b - a < width:
        return None
    same = doc[a + shift : b + shift] == item[a:b]
    run = np.concatenate([[0], np.cumsum(same)])
    least = math.ceil(SHARE * WINDOW) if len(item) >= WINDOW else width
    good = np.flatnonzero(run[width:] - run[:-width] >= least)
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return a + shift + first, last - first, int(same[first:last].sum())


def test_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, tokens, seeds) of the items that can be searched for; item is a key of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            data, at = utf8(batch.column(1))
            for i, name in enumerate(batch.column(0).to_pylist()):
                tokens, _ = token_hashes(data[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                found = [{"seed": s, "pos": p} for m in item_masks(len(tokens)) for p, s in enumerate(seeds(tokens, m).view(np.int64).tolist())]
                if found:
                    rows.append({"item": number, "item_id": name, "tokens": tokens.view(np.int64).tolist(), "seeds": found})
                    number += 1
            yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("tokens", pa.list_(pa.int64())), ("seeds", pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())])))])
    rows = benchmark.select(quoted(id_col).cast("long"), F.lower(quoted(text_col)))
    return materialize(in_batches(rows, run, "item long, item_id long, tokens array<long>, seeds array<struct<seed: long, pos: int>>"), "items")


def slots(seed: np.ndarray, probe: int, log: int) -> np.ndarray:
    """The bit of each seed for one of the probes, among 2 ** log."""
    return mixed(seed + np.uint64(probe * 0x5851F42D4C957F2D % (1 << 64))) >> np.uint64(64 - log)


def bitmap(test_seeds: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of the seeds: a power of two of bits, 64 or more for each seed up to MOST_BITS in all."""
    log = min(MOST_BITS.bit_length() - 1, max(10, (64 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate([slots(batch.column(0).to_numpy().view(np.uint64), k, log) for k in range(PROBES)])
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["w", "b"])

    words = in_batches(test_seeds.select("seed"), run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros((1 << log) // 64, np.int64)
    for row in words.collect():  # at most MOST_BITS / 64 rows
        out[row.w] = row.b
    return out


def passing(bits: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The places of the seeds that the filter has."""
    log = (len(bits) * 64).bit_length() - 1
    place = np.arange(len(seed))
    for k in range(PROBES):
        slot = slots(seed[place], k, log)
        place = place[((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)]
    return place


def clusters(docs: DataFrame, bits: np.ndarray, masks: list[str], reach: int) -> DataFrame:
    """Places whose seeds pass the bitmap, with the tokens around them: (cluster, KEY, doc_id, first, tokens, hits).

    docs has KEY, doc_id and text; hits of a document that are at most ``reach`` tokens apart are one cluster.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, filled = TaskContext.get().partitionId() << 40, held.value.view(np.uint64)
        for batch in batches:
            data, at = utf8(batch.column(4))
            rows = []
            for a, b in steps(at):
                tokens, first = token_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a])
                places, values = [], []
                for mask in masks:
                    seed = seeds(tokens, mask)
                    hit = passing(filled, seed)
                    row = np.searchsorted(first, hit, side="right") - 1
                    hit = hit[hit + len(mask) <= first[row + 1]]
                    places.append(hit)
                    values.append(seed[hit])
                place, value = np.concatenate(places), np.concatenate(values)
                by = np.argsort(place, kind="stable")
                place, value = place[by], value[by]
                row = np.searchsorted(first, place, side="right") - 1
                if not len(place):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (np.diff(place) > reach) | (np.diff(row) > 0)]))
                for i, j in zip(new, [*new[1:], len(place)], strict=True):
                    r = int(row[i])
                    low, high = max(first[r], place[i] - reach), min(first[r + 1], place[j - 1] + reach + WINDOW)
                    rows.append({
                        "cluster": number, **{k: batch.column(c)[a + r].as_py() for c, k in enumerate([*KEY, "doc_id"])}, "first": int(low - first[r]),
                        "tokens": tokens[low:high].view(np.int64), "hits": [{"seed": s, "pos": p} for s, p in zip(value[i:j].view(np.int64).tolist(), (place[i:j] - low).tolist(), strict=True)],
                    })
                    number += 1
            yield pa.RecordBatch.from_pylist(rows, kind)

    kind = pa.schema([("cluster", pa.int64()), (KEY[0], pa.bool_()), (KEY[1], pa.int64()), (KEY[2], pa.int64()), ("doc_id", pa.int64()), ("first", pa.int64()), ("tokens", pa.list_(pa.int64())), ("hits", pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())])))])
    schema = f"cluster long, {KEY[0]} boolean, {KEY[1]} long, {KEY[2]} long, doc_id long, first long, tokens array<long>, hits array<struct<seed: long, pos: int>>"
    return materialize(in_batches(docs.select(*KEY, "doc_id", F.lower("text")), run, schema), "clusters")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(KEY, doc_id, item_id, first_token, n_tokens, n_same) of each row and item that overlap: the longest overlap."""
    items = test_items(benchmark)
    flat = materialize(items.select("item", F.inline("seeds")), "seeds")
    n = flat.count()
    lengths = [r.n for r in items.select(F.size("tokens").alias("n")).filter(f"n < {WINDOW}").distinct().collect()]  # under WINDOW rows
    longest = items.agg(F.max(F.size("tokens"))).first()[0] or 0
    masks = [*MASKS, *("1" * m for m in sorted(lengths))]
    rows = boxed(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col).drop("row")
    near = clusters(rows, bitmap(flat, n), masks, longest)
    hits = near.select("cluster", F.inline("hits")).join(broadcast_if_few(flat.withColumnRenamed("pos", "at")), "seed")
    pairs = hits.select("cluster", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    joined = pairs.join(near.select("cluster", *KEY, "doc_id", "first", "tokens"), "cluster")
    joined = joined.join(broadcast_if_few(items.select("item", "item_id", F.col("tokens").alias("wanted")), 20_000), "item")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "doc_id", "item_id", "first_token", "n_tokens", "n_same"]
        for batch in batches:
            kept, found = [], []
            tokens, wanted, shift, first = batch.column(7), batch.column(8), batch.column(6).to_pylist(), batch.column(5).to_pylist()
            for i in range(len(batch)):
                got = overlap(tokens[i].values.to_numpy(), wanted[i].values.to_numpy(), shift[i])
                if got:
                    kept.append(i)
                    found.append((got[0] + first[i], got[1], got[2]))
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in range(5)), *(pa.array(c, pa.int64()) for c in columns)], names)

    schema = f"{KEY[0]} boolean, {KEY[1]} long, {KEY[2]} long, doc_id long, item_id long, first_token long, n_tokens long, n_same long"
    found = in_batches(joined.select(*KEY, "doc_id", "item_id", "first", "shift", "tokens", "wanted"), compare, schema)
    best = F.max(F.struct("n_same", "n_tokens", (-F.col("first_token")).alias("low"))).alias("b")
    return found.groupBy(*KEY, "doc_id", "item_id").agg(best).select(*KEY, "doc_id", "item_id", (-F.col("b.low")).alias("first_token"), "b.n_tokens", "b.n_same")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates."""
    bad = materialize(contaminated(docs, benchmark, id_col, text_col).select(*KEY).distinct(), "contaminated")
    return unboxed(boxed(docs, id_col, text_col).join(broadcast_if_few(bad), KEY, "left_anti"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_token", "n_tokens", "n_same")
