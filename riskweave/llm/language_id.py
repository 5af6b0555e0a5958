"""Language identification in two steps: first the family, then the languages within it.

Texts become shares of hashed byte 3-grams of their lower-cased UTF-8. Linear support vector machines, one against the
rest, choose the family; within it, one-versus-one machines separate the languages and vote (ties: summed margins).

Learning takes a sample of bounded size: of the ``LANGUAGES`` most frequent languages (ties: by name) at most ``sample`` documents
each, and at most about ``ROWS`` in all. Documents fall into buckets by a hash of their id, and the one with the smallest hash of
each bucket is taken, so the sample is repeatable and independent of partitions. Only fixed-size 3-gram counts of the sample reach the
driver (ROWS times 32 KB at most). Predicting is one pass without a shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing could be
learned; a null id is not held out and not learned from; repeated rows keep their rows; an empty table gives no rows; a very
long text is read whole; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, in_batches, materialize, quoted, steps, table, utf8

# Families of language codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk".split(),
    "baltic": "lt lv".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk ky tk tr tt ug uz".split(),
    "indo-aryan": "as bn gu hi mr ne or pa sd si ur".split(),
    "dravidian": "kn ml ta te".split(),
    "iranian": "fa ku ps tg".split(),
    "semitic": "am ar he mt".split(),
    "austronesian": "id jv mg ms su tl".split(),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}
DIMS = 8192
#: Bounds of the sample that is learned from: documents of a language, languages, documents in all.
SAMPLE, LANGUAGES, ROWS = 300, 200, 4_000


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the 3-gram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype(np.int64)


def text_ranges(at: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """For the rows a to b: first and last + 1 position of their 3-grams, relative to row a."""
    first = at[a:b] - at[a]
    return first, np.maximum(first, at[a + 1 : b + 1] - at[a] - 2)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 40) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, dual coordinate descent); y is 1 or -1."""
    rng = np.random.default_rng(0)
    norm = np.einsum("ij,ij->i", x, x) + 1e-12
    share = {s: max(1, int((y == s).sum())) for s in (1, -1)}
    most = np.array([cost * len(y) / (2 * share[int(s)]) for s in y])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / norm[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


@dataclass
class Model:
    """Weights over 3-gram shares: a column for each family, then one for each pair of languages of a family."""

    families: list[str]
    languages: list[list[str]]
    pairs: list[tuple[int, int, int]]  # family, language that is positive, language that is negative
    weights: np.ndarray  # DIMS x columns
    offsets: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        top = margins[:, : len(self.families)]
        family = top.argmax(1)
        others = np.where(np.arange(top.shape[1])[None, :] == family[:, None], -np.inf, top).max(1) if top.shape[1] > 1 else np.full(n, -1.0)
        sure = (top[np.arange(n), family] - others) / 2 if top.shape[1] > 1 else np.full(n, 3.0)
        found, score = [""] * n, np.empty(n)
        for i in range(n):
            f = int(family[i])
            votes, sums = Counter(), Counter()
            best = [(k + len(self.families), a, b) for k, (g, a, b) in enumerate(self.pairs) if g == f]
            for k, a, b in best:
                m = margins[i, k]
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
            chosen = max(range(len(self.languages[f])), key=lambda c: (votes[c], sums[c], -c))
            inner = min([abs(margins[i, k]) if (margins[i, k] >= 0) == (chosen == a) else -abs(margins[i, k]) for k, a, b in best if chosen in (a, b)], default=3.0)
            found[i] = self.languages[f][chosen]
            score[i] = 1 / (1 + np.exp(-2 * min(float(sure[i]), inner)))
        return found, score


def fit(counts: np.ndarray, languages: list[str]) -> Model | None:
    """counts: a row of 3-gram counts for each sampled document."""
    keep = counts.sum(1) > 0
    counts, languages = counts[keep], [x for x, k in zip(languages, keep, strict=True) if k]
    if not languages:
        return None
    x = counts / counts.sum(1, keepdims=True)
    mean = x.mean(0)
    scale = 1 / np.sqrt(mean + 1e-5)  # rare 3-grams count for more
    x = (x - mean) * scale
    named = np.array([FAMILY.get(c, c) for c in languages])
    codes = np.array(languages)
    families = sorted(set(named))
    members = [sorted(set(codes[named == f])) for f in families]
    columns, pairs = [], []
    for f in families:
        columns.append(svm(x, np.where(named == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1]))
    for g, own in enumerate(members):
        for a, b in combinations(range(len(own)), 2):
            rows = (codes == own[a]) | (codes == own[b])
            columns.append(svm(x[rows], np.where(codes[rows] == own[a], 1.0, -1.0)))
            pairs.append((g, a, b))
    weights = np.stack(columns, 1) * scale[:, None]
    return Model(families, members, pairs, weights.astype(np.float32), -(mean @ weights))


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """A bounded sample of docs (doc_id, text, lang), none of which is null."""
    frequent = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang").collect()  # at most LANGUAGES rows
    names = [r.lang for r in frequent]
    sample = min(sample, max(1, ROWS // max(1, len(names))))
    keys = ["lang", "doc_id", "text_key"]
    rows = docs.filter(F.col("lang").isin(names)).withColumn("text_key", F.xxhash64("text"))
    place = F.xxhash64("doc_id")
    chosen = rows.groupBy("lang", F.pmod(place, F.lit(sample)).alias("bucket")).agg(F.min(F.struct(place.alias("h"), "doc_id", "text_key")).alias("k"))
    chosen = materialize(chosen.select("lang", "k.doc_id", "k.text_key"), "sample")  # at most ROWS rows
    return rows.join(F.broadcast(chosen), keys, "left_semi").dropDuplicates(keys).drop("text_key")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """docs: doc_id, text and lang of the documents that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(0))
            rows = []
            for i in range(len(batch)):
                own = data[at[i] : at[i + 1]]
                rows.append(np.bincount(buckets(own), minlength=DIMS).astype("<f4").tobytes() if len(own) > 2 else bytes(4 * DIMS))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(rows, pa.binary())], ["lang", "counts"])

    usable = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = in_batches(sampled(usable, sample).select(F.lower("text"), "lang"), run, "lang string, counts binary").collect()  # bounded by the sample
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r.lang, bytes(r.counts)))
    return fit(np.stack([np.frombuffer(r.counts, "<f4") for r in rows]).astype(np.float64), [r.lang for r in rows])


def identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, score = ["und"] * len(batch), np.zeros(len(batch))
            for a, b in steps(at) if model else ():
                place = buckets(data[at[a] : at[b]]) if at[b] - at[a] > 2 else np.zeros(0, np.int64)
                first, last = text_ranges(at, a, b)
                total = np.zeros((b - a, model.weights.shape[1]))
                some = np.flatnonzero(last > first)
                if len(some):
                    cuts = np.stack([first[some], last[some]], 1).ravel()
                    for k in range(model.weights.shape[1]):
                        each = np.append(model.weights[:, k][place], np.float32(0))
                        total[some, k] = np.add.reduceat(each, np.minimum(cuts, len(place)), dtype=np.float64)[::2]
                margins = total / np.maximum(1, last - first)[:, None] + np.where((last > first)[:, None], model.offsets[None, :], 0.0)
                found, sure = model.predict(margins)
                for i in np.flatnonzero(letters[a:b]):
                    names[a + i], score[a + i] = found[i], sure[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.lower(quoted(text_col)), F.coalesce(quoted(text_col).rlike(r"\p{L}"), F.lit(False)))
    return in_batches(rows, run, f"doc_id {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = learn(docs.filter(~out).select("doc_id", "text", "lang"))
    return identified(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")
