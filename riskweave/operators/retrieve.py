"""Similarity retrieval: tf-idf over words, word pairs and character 4-grams against a labelled anchor set."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import normalise as N
from ..functions.numbers import words as plain_words

UNSEEN = 1.2  # weight of a feature that no anchor has


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def features(text: Column, grams: bool = True) -> Column:
    """``w:`` words, ``b:`` word pairs and, with grams, ``c:`` character 4-grams of a normalised text."""
    words = F.array_remove(F.split(text, " "), "")
    singles = F.transform(words, lambda w: F.concat(F.lit("w:"), w))
    none = F.array().cast("array<string>")
    pairs = N.let(words, lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(F.lit("b:"), F.get(w, i), F.lit(" "), F.get(w, i + 1)))).otherwise(none))
    fours = N.let(text, lambda t: F.when(F.length(t) >= 4, F.transform(F.sequence(F.lit(1), F.length(t) - 3), lambda i: F.concat(F.lit("c:"), F.substr(t, i, F.lit(4))))).otherwise(none))
    return F.concat(singles, pairs, fours) if grams else F.concat(singles, pairs)


def weighted(rows: DataFrame, id_col: str, text_col: str, grams: bool = True) -> DataFrame:
    """(id, feature, tf) of each text."""
    each = rows.select(F.col(id_col).alias("id"), F.explode(features(normalised(F.col(text_col)), grams)).alias("feature"))
    return each.groupBy("id", "feature").agg(F.count("*").alias("tf"))


def index(anchors: DataFrame, id_col: str, text_col: str, grams: bool = True) -> tuple[DataFrame, DataFrame]:
    """(feature, idf) and (anchor, feature, w, norm) of the anchors."""
    tf = weighted(anchors, id_col, text_col, grams)
    n = anchors.select(id_col).distinct().agg(F.count("*").alias("n"))
    idf = tf.groupBy("feature").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("feature", F.greatest(F.ln((F.col("n") + 1) / (F.col("df") + 1)), F.lit(0.0)).alias("idf"))
    w = tf.join(idf, "feature").select(F.col("id").alias("anchor"), "feature", ((1 + F.ln("tf")) * F.col("idf")).alias("w")).filter("w > 0")
    norms = w.groupBy("anchor").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return idf, w.join(norms, "anchor")


def similarities(queries: DataFrame, anchors: DataFrame, id_col: str, text_col: str, anchor_id: str, anchor_text: str, grams: bool = True, most: int = 500_000) -> DataFrame:
    """(id, anchor, similarity) of the pairs that share a feature.

    The queries are dealt by id once, as texts; what follows keeps that partitioning. The anchors' features stand in one row each, with
    their anchors, and are broadcast up to ``most`` of them. A feature gives a term for each of its anchors and one, without
    anchor, for the query's norm.
    """
    idf, weights = index(anchors, anchor_id, anchor_text, grams)
    postings = weights.groupBy("feature").agg(F.collect_list(F.struct("anchor", (F.col("w") / F.col("norm")).alias("w"))).alias("postings"))  # no longer than the anchor set
    side = idf.join(postings, "feature", "left")
    side = F.broadcast(side) if side.limit(most + 1).count() <= most else side
    tf = weighted(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id"), "id", "text", grams)
    q = (1 + F.ln("tf")) * F.coalesce("idf", F.lit(UNSEEN))
    none = F.array().cast("array<struct<anchor:bigint,w:double>>")
    terms = tf.join(side, "feature", "left").select("id", q.alias("q"), F.coalesce(F.col("postings").cast("array<struct<anchor:bigint,w:double>>"), none).alias("postings"))
    own = F.struct(F.lit(None).cast("long").alias("anchor"), F.col("q").alias("w"))
    terms = terms.select("id", "q", F.explode(F.array_append("postings", own)).alias("p"))
    sums = terms.groupBy("id", F.col("p.anchor").alias("anchor")).agg(F.sum(F.col("q") * F.col("p.w")).alias("s"))
    norm = F.sqrt(F.max(F.when(F.col("anchor").isNull(), F.col("s"))).over(Window.partitionBy("id")))
    return sums.withColumn("norm", norm).filter("anchor is not null").select("id", "anchor", (F.col("s") / F.col("norm")).alias("similarity"))


def best_margin(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, nearest, similarity, negative, margin): the best positive anchor against the best negative one.

    labels: (anchor, positive boolean). Ties go to the smaller anchor.
    """
    rows = pairs.join(labels, "anchor")
    best = F.max_by(F.when(F.col("positive"), F.col("anchor")), F.when(F.col("positive"), F.struct("similarity", (-F.col("anchor")).alias("t"))))
    out = rows.groupBy("id").agg(best.alias("nearest"), F.coalesce(F.max(F.when(F.col("positive"), F.col("similarity"))), F.lit(0.0)).alias("similarity"), F.coalesce(F.max(F.when(~F.col("positive"), F.col("similarity"))), F.lit(0.0)).alias("negative"))
    return out.withColumn("margin", F.col("similarity") - F.col("negative"))


class FeatureIndex:
    """The anchors' features, exact, each with its idf and its weight in every anchor."""

    def __init__(self, rows: list[tuple[str, float, list]], positive: set[int], negative: set[int]):
        """rows: (feature, idf, postings: (anchor, w)). positive and negative are the anchors that count, by label."""
        self.anchors = np.array(sorted({p[0] for r in rows for p in r[2]}), np.int64)
        place = {a: i for i, a in enumerate(self.anchors.tolist())}
        self.rank = {r[0]: i for i, r in enumerate(rows)}
        self.idf = np.array([*(r[1] for r in rows), UNSEEN])
        self.start = np.cumsum([0, *(len(r[2]) for r in rows), 0])
        self.anchor = np.array([place[p[0]] for r in rows for p in r[2]], np.int64)
        self.weight = np.array([p[1] for r in rows for p in r[2]])
        self.sides = [np.array([a in side for a in self.anchors.tolist()], bool) for side in (positive, negative)]

    def best(self, counts: Counter) -> tuple[int | None, float, float] | None:
        """(nearest, similarity, negative) of a text's features; None without an anchor that shares one."""
        tf = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        at = np.fromiter((self.rank.get(x, -1) for x in counts), np.int64, len(counts))  # -1: unseen
        q = tf * self.idf[at]
        first, size = self.start[at], np.where(at >= 0, self.start[at + 1] - self.start[at], 0)
        own = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        near = np.bincount(self.anchor[own], np.repeat(q, size) * self.weight[own], len(self.anchors)) / (np.sqrt((q * q).sum()) or 1.0)
        met = np.zeros(len(self.anchors), bool)
        met[self.anchor[own]] = True
        good, bad = (np.flatnonzero(side & met) for side in self.sides)
        if not len(good) and not len(bad):
            return None
        nearest = good[near[good].argmax()] if len(good) else None
        return (None if nearest is None else int(self.anchors[nearest]), 0.0 if nearest is None else float(near[nearest]), float(near[bad].max()) if len(bad) else 0.0)


def counted(plain: str, grams: bool) -> Counter:
    """features() of a normalised text."""
    words = [w for w in plain.split(" ") if w]
    out = Counter(f"w:{w}" for w in words)
    out.update(f"b:{a} {b}" for a, b in zip(words, words[1:]))
    if grams:
        out.update(f"c:{plain[i : i + 4]}" for i in range(len(plain) - 3))
    return out


def best_margins(queries: DataFrame, anchors: DataFrame, labels: DataFrame, id_col: str, text_col: str, anchor_id: str, anchor_text: str, grams: bool = True, most: int = 500_000) -> DataFrame:
    """best_margin() of similarities(). Up to ``most`` features of the anchors are held by each task, which makes a text's features and compares them where
    the text stands: what is shuffled are the texts, once, to bring those of one id together. With more features the pairs are made by joins."""
    idf, weights = index(anchors, anchor_id, anchor_text, grams)
    postings = weights.filter("anchor is not null").groupBy("feature").agg(F.collect_list(F.struct(F.col("anchor").cast("long"), (F.col("w") / F.col("norm")).alias("w"))).alias("postings"))
    held = idf.join(postings, "feature", "left").select("feature", "idf", "postings").limit(most + 1).collect()
    if len(held) > most:
        return best_margin(similarities(queries, anchors, id_col, text_col, anchor_id, anchor_text, grams, most), labels)
    sides = labels.select(F.col("anchor").cast("long"), "positive").distinct().collect()  # no longer than the anchor set
    shared = queries.sparkSession.sparkContext.broadcast(FeatureIndex(sorted((r[0], r[1], [tuple(p) for p in r[2] or ()]) for r in held), *({r[0] for r in sides if r[1] is side} for side in (True, False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, now, counts = shared.value, None, None
        for batch in batches:
            out = []
            for i, plain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if counts is not None and i == now:
                    counts.update(counted(plain or "", grams))
                    continue
                if counts and (best := index.best(counts)):
                    out.append((now, *best))
                now, counts = i, counted(plain or "", grams)
            kind = batch.schema.field(0).type
            yield found(out, kind)
        if counts and (best := index.best(counts)):
            yield found([(now, *best)], kind)

    def found(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((kind, pa.int64(), pa.float64(), pa.float64()))], ["id", "nearest", "similarity", "negative"])

    dealt = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("id").sortWithinPartitions("id")
    schema = StructType([dealt.schema["id"], *StructType.fromDDL("nearest long, similarity double, negative double").fields])
    rows = dealt.select("id", normalised(F.col("text")).alias("text")).mapInArrow(run, schema)
    return rows.withColumn("margin", F.col("similarity") - F.col("negative"))


def scaled(similarity: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((similarity - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def contact_confidence(similarity: Column, margin: Column) -> Column:
    """Null unless similar to a contact anchor (0.28) and clear of the innocent ones (0.06)."""
    return F.when((similarity >= 0.28) & (margin >= 0.06), 0.56 + 0.36 * scaled(similarity, 0.28, 0.62))


def safety_confidence(similarity: Column, margin: Column) -> Column:
    return F.when((similarity >= 0.55) & (margin >= 0.20), 0.60 + 0.32 * scaled(similarity, 0.34, 0.62))


# Retrieval over hashed features ----------------------------------------------------------------------------------

BUCKETS, MOST_ANCHORS = 1 << 18, 10_000
LEAST_TOKENS = {"contact": 4, "safety": 3, "innocent": 3}
NOT_WORD = re.compile(r"[\W_]+")


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The buckets of a text's words, word pairs and character 4-grams, how often each occurs, and the number of words."""
    low = (text or "").lower()
    plain = " ".join(plain_words(low)) if low.isascii() else NOT_WORD.sub(" ", low).strip()
    words = plain.split()
    keys = [zlib.crc32(f"w:{w}".encode()) for w in words] + [zlib.crc32(f"b:{a} {b}".encode()) for a, b in zip(words, words[1:])]
    points = np.frombuffer(plain.encode("utf-32-le"), np.uint32).astype(np.uint64)
    fours = np.zeros(max(0, len(points) - 3), np.uint64)
    for i in range(4):
        fours = (fours * np.uint64(0x9E3779B97F4A7C15) + points[i : i + len(fours)] + np.uint64(1)) ^ (fours >> np.uint64(29))
    found, n = np.unique(np.concatenate([np.array(keys, np.uint64), fours >> np.uint64(7)]) % np.uint64(BUCKETS), return_counts=True)
    return found.astype(np.int64), n, len(words)


class AnchorIndex:
    """Weights of the anchors' features by bucket, and the idf of each bucket."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        """rows: (family, intent, text)."""
        self.families = np.array([r[0] for r in rows])
        self.intents = [r[1] for r in rows]
        found = [hashed_features(r[2]) for r in rows]
        df = np.zeros(BUCKETS)
        for buckets, _, _ in found:
            df[buckets] += 1
        self.idf = np.where(df > 0, np.maximum(np.log((len(rows) + 1) / (df + 1)), 0.0), UNSEEN)
        weights = [(1 + np.log(n)) * self.idf[b] for b, n, _ in found]
        norms = [np.sqrt((w * w).sum()) or 1.0 for w in weights]
        bucket = np.concatenate([*(b for b, _, _ in found), np.zeros(0, np.int64)])
        by = np.argsort(bucket, kind="stable")
        self.anchor = np.repeat(np.arange(len(rows)), [len(w) for w in weights])[by]
        self.weight = np.concatenate([*(w / n for w, n in zip(weights, norms, strict=True)), np.zeros(0)])[by]
        self.start = np.searchsorted(bucket[by], np.arange(BUCKETS + 1))

    def best(self, text: str | None) -> dict[str, tuple[float, int]]:
        """For each family the highest similarity and its anchor; -1 for a text with too few words."""
        buckets, n, words = hashed_features(text)
        q = (1 + np.log(n)) * self.idf[buckets]
        first, size = self.start[buckets], self.start[buckets + 1] - self.start[buckets]
        at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        norm = np.sqrt((q * q).sum()) or 1.0
        near = np.bincount(self.anchor[at], np.repeat(q, size) * self.weight[at], len(self.families)) / norm
        out = {}
        for family, least in LEAST_TOKENS.items():
            own = np.flatnonzero(self.families == family)
            k = int(own[near[own].argmax()]) if len(own) else -1
            out[family] = (float(near[k]), k) if words >= least and k >= 0 else (-1.0, -1)
        return out


RETRIEVED = "contact_similarity double, safety_similarity double, innocent_similarity double, safety_intent string"


def with_similarities(rows: DataFrame, anchors: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with their highest similarity to the contact, safety and innocent anchors (-1 where the text is too short), and the
    intent of the nearest safety anchor. anchors (family, intent, text) is a list of at most MOST_ANCHORS rows. No shuffle."""
    held = [tuple(r) for r in anchors.select("family", "intent", "text").limit(MOST_ANCHORS + 1).collect()]
    if len(held) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    shared = rows.sparkSession.sparkContext.broadcast(AnchorIndex(sorted(held)))
    place = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            best = [index.best(t) for t in batch.column(place).to_pylist()]
            near = [pa.array([b[f][0] for b in best], pa.float64()) for f in ("contact", "safety", "innocent")]
            intents = pa.array([index.intents[b["safety"][1]] if b["safety"][1] >= 0 else None for b in best], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *near, intents], [*batch.schema.names, *(x.split()[0] for x in RETRIEVED.split(", "))])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL(RETRIEVED).fields]))
