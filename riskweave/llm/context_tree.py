"""Language model scoring with context-tree weighting.

A byte is coded as eight binary decisions; the decisions made so far name one of 255 nodes. Each node has a context
tree of its own over the bytes before, ``depth`` deep. A context's counts give a Krichevsky-Trofimov estimate; from the
leaves up, a context's weighted probability is half its own estimate and half the product of its longer contexts', so the
model mixes all depths by how well they coded the training documents. Trained, it predicts a bit by mixing the estimates
along the context's path with these posterior weights. A text's score is the log10 probability of its bytes (A-Z
lower-cased, zero bytes before the start) and of an end mark (the byte 255, which no UTF-8 text has); minus the score over
log10(2) and the number of bytes is the code length per byte.

Beside it stands the base score: add-one unigram log10 probabilities of the words and one end token.

Scale: a gram is ``depth`` bytes of context and the next byte. One pass counts the grams and words of the documents, pre-aggregated in
each task; grams of no training document are counted as 0. The log probability of each gram is worked out where all grams of its
last two context bytes pass in order, of which only those with the same third byte are held at once; what two or fewer bytes of
context need are tables of 65,536 rows at most, and the driver gets 256 rows. Up to ``HELD`` grams are broadcast (16 bytes each) and the
texts scored in one more pass, with the most frequent ``FREQUENT`` words broadcast and the others joined. A larger model is joined
instead, with the same result: the documents are cut into parts of about ``PART_BYTES`` and written with the different grams and
words of each, log probabilities and counts go to the parts by joins, and each part's texts are scored with the part's own. So
no model is too large, and its depth is a parameter.

Defined results: a null text counts as empty: no word, one end token, the end mark's probability, no code length per byte; a
null training flag counts as false; null ids and repeated rows keep their rows, and repeated rows count each in training;
without training documents every base probability is 1 / 1 and each bit of a text costs one bit; an empty table gives no rows; a
very long text is a part of its own; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, in_batches, materialize, quoted, steps, table, utf8

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LOWER_OF = np.frombuffer(LOWER, np.uint8)
END = 255
DEPTH, DEEPEST = 3, 6
#: Grams of a model that is broadcast, and words whose counts are.
HELD, FREQUENT = 4_000_000, 100_000
#: Text bytes of a part, and grams that are worked out at once where one third byte does not have more.
PART_BYTES, GRAMS = 16_000_000, 400_000
HALF = np.log(0.5)
NODES = 255


def ended(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some texts, lower-cased and with the end mark behind each, and their offsets."""
    cuts = at + np.arange(len(at))
    out = np.full(int(cuts[-1]), END, np.uint8)
    keep = np.ones(len(out), bool)
    keep[cuts[1:] - 1] = False
    out[keep] = LOWER_OF[data]
    return out, cuts


def gram_codes(data: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of some texts the bytes before it, the last first (zero before the start), and the byte, as one number."""
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    out = data.astype(np.int64)
    for k in range(1, depth + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        before[place < k] = 0
        out |= before << (8 * (depth - k + 1))
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return np.where(zeros + ones > 0, log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi), 0.0)


def next_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def splits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) at the nodes 1 to 255, for rows of 256 byte counts."""
    tree = np.zeros((*counts.shape[:-1], 512))
    tree[..., 256:] = counts
    for q in range(NODES, 0, -1):
        tree[..., q] = tree[..., 2 * q] + tree[..., 2 * q + 1]
    return tree[..., 2:512:2], tree[..., 3:512:2]


def weigh(counts: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A context's weighted log probability, its posterior weight of stopping, and its chance of a one, at each node."""
    zeros, ones = splits(counts)
    own = HALF + estimate(zeros, ones)
    total = np.logaddexp(own, HALF + children)
    return total, np.exp(own - total), next_one(zeros, ones)


class Level:
    """The contexts of ``d`` bytes of some grams: at each of the eight decisions the nodes that the grams reach."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, d: int, depth: int):
        key = (codes >> (8 * (depth - d + 1)) << 8) | (codes & 255)
        first, self.entry = (np.arange(len(codes)), np.arange(len(codes))) if d == depth else np.unique(key, return_index=True, return_inverse=True)[1:]
        key, total = key[first], np.bincount(self.entry, n)
        self.node, self.zeros, self.ones, self.first = [], [], [], []
        for j in range(8):
            prefix = key >> (8 - j)
            start = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            self.node.append(np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key)))))
            bit = (key >> (7 - j) & 1).astype(bool)
            self.ones.append(np.add.reduceat(np.where(bit, total, 0.0), start))
            self.zeros.append(np.add.reduceat(np.where(bit, 0.0, total), start))
            self.first.append(first[start])  # a gram of each node
        self.own = [estimate(z, o) for z, o in zip(self.zeros, self.ones, strict=True)]
        self.weighted = self.own  # of the deepest contexts

    def of(self, grams: np.ndarray, j: int) -> np.ndarray:
        """The nodes of some grams at decision j."""
        return self.node[j][self.entry[grams]]

    def mix(self, below: Level) -> None:
        """The weighted log probabilities, and the weights of stopping here, from those of the contexts one byte longer."""
        self.weighted, self.stop = [], []
        for j in range(8):
            children = np.bincount(self.of(below.first[j], j), below.weighted[j], len(self.own[j]))
            self.weighted.append(np.logaddexp(HALF + self.own[j], HALF + children))
            self.stop.append(np.exp(HALF + self.own[j] - self.weighted[j]))


def levels_of(codes: np.ndarray, n: np.ndarray, depth: int) -> list[Level]:
    """The contexts of 3 to ``depth`` bytes of some grams, which are sorted and hold all with their last three bytes."""
    out = [Level(codes, n, depth, depth)]
    for d in range(depth - 1, 2, -1):
        out.append(Level(codes, n, d, depth))
        out[-1].mix(out[-2])
    return out[::-1]


def pair_children(codes: np.ndarray, levels: list[Level], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of last bytes, and for each the sum of its longer contexts' weighted log probabilities at the 255 nodes."""
    pairs, row = np.unique(codes >> (8 * (depth - 1)), return_inverse=True)
    out = np.zeros(len(pairs) * 256)
    top = levels[0]
    for j in range(8):
        first = top.first[j]
        q = (1 << j) | ((codes[first] & 255) >> (8 - j))
        out += np.bincount(row[first] * 256 + q, top.weighted[j], len(out))
    return pairs, out.reshape(-1, 256)[:, 1:]


def log_probabilities(codes: np.ndarray, levels: list[Level], upper: np.ndarray, row: np.ndarray) -> np.ndarray:
    """log10 of each gram's probability; upper[0] and upper[1] have a row for each pair, ``row`` the gram's: the chance of a one that
    contexts of up to two bytes give, and the weight that is left for longer ones, at the 255 nodes."""
    every = np.arange(len(codes))
    out = np.zeros(len(codes))
    for j in range(8):
        at = levels[-1].of(every, j)
        one = next_one(levels[-1].zeros[j], levels[-1].ones[j])[at]
        for level in levels[-2::-1]:
            at = level.of(every, j)
            stop = level.stop[j][at]
            one = stop * next_one(level.zeros[j], level.ones[j])[at] + (1 - stop) * one
        q = ((1 << j) | ((codes & 255) >> (8 - j))) - 1
        one = upper[0, row, q] + upper[1, row, q] * one
        out += np.log10(np.where(codes >> (7 - j) & 1, one, 1 - one))
    return out


def emitted(docs: DataFrame, train: Column, id_col: str, text_col: str, depth: int, texts: bool) -> DataFrame:
    """Grams (part, code, n) and words (part, word, n) of parts of the documents, where n is the count in training documents; with
    texts, also the parts' texts (part, doc_id, text, train)."""
    names = ["kind", "part", "doc_id", "text", "train", "code", "word", "n"]
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        id_kind = None
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: list[Counter[bytes]] = [Counter(), Counter()]
        held = 0

        def filled(n: int, /, **columns) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), id_kind, pa.string(), pa.bool_(), pa.int64(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

        def of_kind(kind: str, n: int, /, **columns) -> pa.RecordBatch:
            return filled(n, kind=pa.array([kind] * n, pa.string()), part=pa.array(np.full(n, part)), **columns)

        def merged() -> None:
            codes, row = np.unique(np.concatenate([g[0] for g in grams]), return_inverse=True)
            grams[:] = [(codes, np.bincount(row, np.concatenate([g[1] for g in grams])).astype(np.int64))]

        def finished() -> Iterator[pa.RecordBatch]:
            merged()
            codes, n = grams.pop()
            for a in range(0, len(codes), 200_000):
                yield of_kind("gram", len(codes[a : a + 200_000]), code=pa.array(codes[a : a + 200_000]), n=pa.array(n[a : a + 200_000]))
            keys = list(words[0].keys() | words[1].keys())
            for a in range(0, len(keys), 200_000):
                some = keys[a : a + 200_000]
                yield of_kind("word", len(some), word=pa.array(some, pa.binary()), n=pa.array([words[1][w] for w in some], pa.int64()))
            words[0].clear()
            words[1].clear()

        for batch in batches:
            id_kind = batch.column(0).type
            data, at = utf8(batch.column(1))
            trained = np.array(batch.column(2))
            for a, b in steps(at):
                text, cuts = ended(data[at[a] : at[b]], at[a : b + 1] - at[a])
                codes = gram_codes(text, cuts, depth)
                learned = np.repeat(trained[a:b], np.diff(cuts))
                for side, weight in ((codes[learned], 1), (codes[~learned], 0)):
                    own = np.sort(side)
                    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
                    grams.append((own[start], weight * np.diff(np.append(start, len(own)))))
                whole = LOWER_OF[data[at[a] : at[b]]].tobytes()
                for i in range(a, b):
                    words[int(trained[i])].update(whole[at[i] - at[a] : at[i + 1] - at[a]].split())
                if texts:
                    yield of_kind("text", b - a, doc_id=batch.column(0).slice(a, b - a), text=batch.column(1).slice(a, b - a), train=batch.column(2).slice(a, b - a))
                held += len(text)
                if held > PART_BYTES:
                    yield from finished()
                    part, held = part + 1, 0
                elif len(grams) > 8:
                    merged()
        if held:
            yield from finished()

    schema = f"kind string, part long, doc_id {id_type}, text string, train boolean, code long, word binary, n long"
    return in_batches(rows, run, schema)


def pair_blocks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, n) of sorted rows in blocks that hold all grams with the same three last bytes."""
    rest = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for batch in batches:
        part = [batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)]
        rest = [np.concatenate(x) for x in zip(rest, part, strict=True)]
        if len(rest[0]) > GRAMS:
            cut = int(np.searchsorted(rest[0], rest[0][-1] >> (8 * (depth - 2)) << (8 * (depth - 2))))
            if cut:
                yield rest[0][:cut], rest[1][:cut]
                rest = [x[cut:] for x in rest]
    if len(rest[0]):
        yield rest[0], rest[1]


def pair_table(counts: DataFrame, depth: int) -> DataFrame:
    """(pair, counts, children) for each two last bytes: counts of the next byte, and sums over the longer contexts at the 255 nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in pair_blocks(batches, depth):
            pairs, children = pair_children(codes, levels_of(codes, n, depth), depth)
            row = np.searchsorted(pairs, codes >> (8 * (depth - 1)))
            counts = np.bincount(row * 256 + (codes & 255), n, len(pairs) * 256).reshape(-1, 256)
            blobs = [pa.array([x.tobytes() for x in m], pa.binary()) for m in (counts, children)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs), *blobs], ["pair", "counts", "children"])

    return in_batches(in_order(counts, depth).select("code", "n"), run, "pair long, counts binary, children binary")


def in_order(counts: DataFrame, depth: int) -> DataFrame:
    """Grams (and rows of their pair that have no code) dealt by their two last bytes, in order of these and of the code."""
    pair = F.shiftright("code", 8 * (depth - 1))
    pair = F.coalesce("pair", pair) if "pair" in counts.columns else pair
    rows = counts.withColumn("pair", pair)
    return rows.repartition("pair").sortWithinPartitions("pair", F.col("code").asc_nulls_first())


def added(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the blocks of a pair (or byte): their counts and sums added."""
    total = lambda c: np.stack([np.frombuffer(x) for x in pdf[c]]).sum(0).tobytes()
    return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "counts": [total("counts")], "children": [total("children")]})


def byte_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for the pairs of a last byte: their counts and weighted log probabilities added."""
    counts = np.stack([np.frombuffer(x) for x in pdf["counts"]])
    total, _, _ = weigh(counts, np.stack([np.frombuffer(x) for x in pdf["children"]]))
    return pd.DataFrame({"byte": [pdf["byte"].iloc[0]], "counts": [counts.sum(0).tobytes()], "children": [total.sum(0).tobytes()]})


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """(code, value): the log10 probability of each gram of counts (code, n)."""
    schema = "pair long, counts binary, children binary"
    pairs = materialize(pair_table(counts, depth).groupBy("pair").applyInPandas(added, schema), "pairs")  # at most 65,536 rows
    level = pairs.withColumn("byte", F.shiftright("pair", 8)).groupBy("byte").applyInPandas(byte_rows, "byte long, counts binary, children binary").collect()  # at most 256 rows
    counts1, children1 = np.zeros((256, 256)), np.zeros((256, NODES))
    for row in level:
        counts1[row.byte], children1[row.byte] = np.frombuffer(row.counts), np.frombuffer(row.children)
    total1, stop1, one1 = weigh(counts1, children1)
    _, stop0, one0 = weigh(counts1.sum(0), total1.sum(0))

    def above(pair: int, own: bytes, children: bytes) -> np.ndarray:
        """The chance of a one that contexts of up to two bytes give, and the weight that is left for longer ones."""
        _, stop, one = weigh(np.frombuffer(own), np.frombuffer(children))
        byte = pair >> 8
        known = stop0 * one0 + (1 - stop0) * (stop1[byte] * one1[byte] + (1 - stop1[byte]) * stop * one)
        return np.stack([known, (1 - stop0) * (1 - stop1[byte]) * (1 - stop)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper: dict[int, np.ndarray] = {}

        def grams() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code = batch.column(0)
                for i in np.flatnonzero(np.array(code.is_null())):
                    pair = batch.column(2)[i].as_py()
                    upper[pair] = above(pair, batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
                yield batch.select([0, 1]).filter(code.is_valid())

        for codes, n in pair_blocks(grams(), depth):
            levels = levels_of(codes, n, depth)
            pairs, row = np.unique(codes >> (8 * (depth - 1)), return_inverse=True)
            each = np.stack([upper[p] for p in pairs.tolist()], 1)
            for old in [p for p in upper if p < pairs[-1]]:
                del upper[old]
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(log_probabilities(codes, levels, each, row))], ["code", "value"])

    both = counts.select("code", "n").withColumns({"pair": F.lit(None).cast("long"), "counts": F.lit(None).cast("binary"), "children": F.lit(None).cast("binary")})
    both = both.unionByName(pairs.withColumns({"code": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}))
    return materialize(in_batches(in_order(both, depth).select("code", "n", "pair", "counts", "children"), run, "code long, value double"), "scores")


NAMES = ["doc_id", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]


def result(n_bytes: Column, n_words: Column, known: Column, logs: Column, score: Column, totals: tuple[int, int, int]) -> list[Column]:
    """The columns NAMES but the first: logs is the sum of log10(c + 1) over a text's words."""
    n_docs, train_tokens, distinct = totals
    size, end = float(np.log10(train_tokens + distinct + 1)), float(np.log10(n_docs + 1))
    tokens = n_words + 1
    bits = F.when(n_bytes > 0, -score / float(np.log10(2)) / n_bytes)
    columns = [n_bytes, tokens, known + int(n_docs > 0), F.lit(train_tokens).cast("long"), logs + end - tokens * size, score, bits]
    return [c.alias(n) for c, n in zip(columns, NAMES[1:], strict=True)]


def scored_rows(batch: pa.RecordBatch, place: int, depth: int, score) -> Iterator[tuple[int, int, np.ndarray, list[list[bytes]], np.ndarray]]:
    """(a, b, bytes, words and scores) of the texts a to b of a batch; score gives the log probability of each code."""
    data, at = utf8(batch.column(place))
    for a, b in steps(at):
        text, cuts = ended(data[at[a] : at[b]], at[a : b + 1] - at[a])
        each = np.concatenate([[0.0], np.cumsum(score(gram_codes(text, cuts, depth)))])
        whole = LOWER_OF[data[at[a] : at[b]]].tobytes()
        words = [whole[at[i] - at[a] : at[i + 1] - at[a]].split() for i in range(a, b)]
        yield a, b, np.diff(at[a : b + 1]), words, each[cuts[1:]] - each[cuts[:-1]]


def scored_in_memory(docs: DataFrame, values: DataFrame, words: DataFrame, totals: tuple[int, int, int], id_col: str, text_col: str, depth: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    found = values.toArrow()  # at most HELD rows
    code, value = (found.column(c).to_numpy() for c in ("code", "value"))
    by = np.argsort(code)
    model = context.broadcast((code[by], value[by]))
    top = words.filter("n > 0").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()  # at most FREQUENT rows
    frequent = context.broadcast({bytes(r.word): float(np.log10(r.n + 1)) for r in top})
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, known = TaskContext.get().partitionId() << 40, frequent.value
        codes, logs = model.value
        for batch in batches:
            for a, b, n_bytes, texts, score in scored_rows(batch, 1, depth, lambda c: logs[np.searchsorted(codes, c)]):
                near, base = np.zeros(b - a, np.int64), np.zeros(b - a)
                uid, word, times = [], [], []
                for i, own in enumerate(texts):
                    for w, t in Counter(own).items():
                        if w in known:
                            near[i] += t
                            base[i] += t * known[w]
                        else:
                            uid.append(number + i)
                            word.append(w)
                            times.append(t)
                own_id = pa.array(np.arange(number, number + b - a))
                number += b - a
                n = pa.array(np.array([len(x) for x in texts], np.int64))
                yield pa.RecordBatch.from_arrays([own_id, batch.column(0).slice(a, b - a), *map(pa.array, (n_bytes,)), n, *map(pa.array, (near, base, score)), pa.nulls(b - a, pa.binary()), pa.nulls(b - a, pa.int64())], names)
                if uid:
                    rest = [pa.nulls(len(uid), t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), *rest, pa.array(word, pa.binary()), pa.array(times, pa.int64())], names)

    names = ["uid", "doc_id", "n_bytes", "n", "near", "base", "score", "word", "times"]
    schema = f"uid long, doc_id {kind}, n_bytes long, n long, near long, base double, score double, word binary, times long"
    out = materialize(in_batches(rows, run, schema), "scored")  # numbered once, so the rows of a text find it
    rare = out.filter("word IS NOT NULL").select("uid", "word", "times").join(words.filter("n > 0"), "word")
    rare = rare.groupBy("uid").agg(F.sum("times").alias("far"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"))
    both = out.filter("word IS NULL").drop("word", "times").join(rare, "uid", "left")
    return both.select("doc_id", *result(F.col("n_bytes"), F.col("n"), F.col("near") + F.coalesce("far", F.lit(0)), F.col("base") + F.coalesce("more", F.lit(0.0)), F.col("score"), totals))


def scored_by_parts(docs: DataFrame, train: Column, values: DataFrame, words: DataFrame, totals: tuple[int, int, int], id_col: str, text_col: str, depth: int) -> DataFrame:
    rows = materialize(emitted(docs, train, id_col, text_col, depth, True), "parts")
    of = lambda kind: rows.filter(F.col("kind") == kind)
    none = lambda kind: F.lit(None).cast(kind)
    known = of("gram").select("part", "code").join(values, "code").select("part", "code", "value", none("binary").alias("word"), none("long").alias("n"))
    known = known.unionByName(of("word").select("part", "word").join(words, "word").select("part", none("long").alias("code"), none("double").alias("value"), "word", "n"))
    texts = of("text").select(F.col("part").alias("text_part"), "doc_id", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        grams = right.filter(right["code"].is_valid())
        code, value = (grams[c].to_numpy() for c in ("code", "value"))
        by = np.argsort(code)
        code, value = code[by], value[by]
        rest = right.filter(right["word"].is_valid())
        count = dict(zip(rest["word"].to_pylist(), rest["n"].to_pylist(), strict=True))
        logs = {w: float(np.log10(k + 1)) for w, k in count.items()}
        out = []
        for batch in left.to_batches():
            for a, b, n_bytes, own, score in scored_rows(batch, 2, depth, lambda c: value[np.searchsorted(code, c)]):
                sums = [np.array(x) for x in ([len(w) for w in own], [sum(count[x] > 0 for x in w) for w in own], [float(sum(map(logs.__getitem__, w))) for w in own])]
                out.append(pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *map(pa.array, (n_bytes, *sums, score))], ["doc_id", "n_bytes", "n", "near", "base", "score"]))
        return pa.Table.from_batches(out)

    found = texts.groupBy("text_part").cogroup(known.groupBy("part")).applyInArrow(run, f"doc_id {kind}, n_bytes long, n long, near long, base double, score double")
    return found.select("doc_id", *result(*[F.col(c) for c in ("n_bytes", "n", "near", "base", "score")], totals))


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, held: int = HELD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row, learned from those where train is true."""
    if not 3 <= depth <= DEEPEST:
        raise ValueError(f"a depth of 3 to {DEEPEST} bytes")
    counts = materialize(emitted(docs, train, id_col, text_col, depth, False).groupBy("word", "code").agg(F.sum("n").alias("n")), "counts")
    values = gram_scores(counts.filter("word IS NULL").select("code", "n"), depth)
    words = counts.filter("word IS NOT NULL").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()
    n_docs = docs.filter(F.coalesce(train, F.lit(False))).count()
    totals = n_docs, n + n_docs, v + (n_docs > 0)
    if values.count() <= held:
        return scored_in_memory(docs, values, words, totals, id_col, text_col, depth)
    return scored_by_parts(docs, train, values, words, totals, id_col, text_col, depth)


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = crc_mod(F.col("doc_id"), 7)
    found = scores(docs, rest != 2)
    return found.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
