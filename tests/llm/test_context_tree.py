import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import context_tree as C


def kt(n0, n1):
    return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)


def low(text):
    return (text or "").encode().translate(C.LOWER)


class Brute:
    """The recursion of context-tree weighting, node by node."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.n = defaultdict(lambda: [0, 0])
        self.kids = defaultdict(set)
        for text in texts:
            data = bytes(depth) + low(text) + b"\xff"
            for i in range(depth, len(data)):
                q = 1
                for b in range(7, -1, -1):
                    bit = data[i] >> b & 1
                    for d in range(depth + 1):
                        ctx = data[i - d : i]
                        self.n[q, ctx][bit] += 1
                        if d:
                            self.kids[q, ctx[1:]].add(ctx)
                    q = 2 * q + bit
        self.memo = {}

    def weighted(self, q, ctx):
        if (q, ctx) not in self.memo:
            own = kt(*self.n[q, ctx]) if (q, ctx) in self.n else 0.0
            if len(ctx) < self.depth:
                rest = sum(self.weighted(q, k) for k in self.kids.get((q, ctx), ()))
                m = max(own, rest)
                own = m + math.log(0.5 * math.exp(own - m) + 0.5 * math.exp(rest - m))
            self.memo[q, ctx] = own
        return self.memo[q, ctx]

    def one(self, q, path):
        p = None
        for ctx in reversed(path):
            n0, n1 = self.n.get((q, ctx), (0, 0))
            own = (n1 + 0.5) / (n0 + n1 + 1)
            if p is None:
                p = own
            else:
                w = math.exp(math.log(0.5) + kt(n0, n1) - self.weighted(q, ctx))
                p = w * own + (1 - w) * p
        return p

    def score(self, text):
        data, total = bytes(self.depth) + low(text) + b"\xff", 0.0
        for i in range(self.depth, len(data)):
            q = 1
            for b in range(7, -1, -1):
                bit = data[i] >> b & 1
                p = self.one(q, [data[i - d : i] for d in range(self.depth + 1)])
                total += math.log10(p if bit else 1 - p)
                q = 2 * q + bit
        return total


def corpus():
    rnd = random.Random(9)
    bits = ["th", "er", "ing", " ", " ", "é", "\n", "A", "ou", ".", "日"]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))) for i in range(60)]
    return [*docs, (100, None), (101, ""), (5, "Twice twice"), (5, "Twice twice"), (None, "no id"), (102, "zq\x00\x00x")]


TRAIN = "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2"


@pytest.mark.parametrize("depth, held", [(3, C.HELD), (5, 0)])
def test_scores_equal_the_recursion(spark, depth, held):
    C.FREQUENT = 10
    docs = corpus()
    train = [t for i, t in docs if i is not None and crc32(str(i).encode()) % 7 != 2]
    frame = spark.createDataFrame([(i, t, 0.0, "part", 1) for i, t in docs], "doc_id long, text string, score double, part string, train int")
    found = [sorted(map(tuple, C.scores(f, F.expr(TRAIN), depth=depth, held=held).collect()), key=lambda r: (str(r[0]), r[1])) for f in (frame.repartition(3), frame.orderBy(F.desc("text")).coalesce(1))]
    C.FREQUENT = 100_000
    words = Counter(w for t in train for w in low(t).split())
    n, v = sum(words.values()) + len(train), len(words) + 1
    brute = Brute(train, depth)
    want = []
    for i, t in docs:
        tokens = low(t).split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens) + math.log10((len(train) + 1) / (n + v + 1))
        want.append((i, len((t or "").encode()), len(tokens) + 1, sum(words[w] > 0 for w in tokens) + 1, n, base, brute.score(t)))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    for got in found:
        assert [r[:5] for r in got] == [r[:5] for r in want]
        for a, b in zip(got, want):
            assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)
            assert a[7] == (pytest.approx(-b[6] / math.log10(2) / b[1], rel=1e-5) if b[1] else None)


def test_parts_and_blocks_change_nothing():
    """The gram's probabilities by blocks of three last bytes equal those of all grams at once, and the bits of a byte sum to one."""
    rnd = random.Random(3)
    vocab = ["".join(rnd.choice("abcdeté") for _ in range(rnd.randrange(1, 6))) for _ in range(80)]
    text = " ".join(rnd.choice(vocab) for _ in range(900)).encode()
    data, cuts = C.ended(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    codes, n = np.unique(C.gram_codes(data, cuts, 4), return_counts=True)
    batches = [pa.RecordBatch.from_arrays([pa.array(codes[a : a + 50]), pa.array(n[a : a + 50])], ["code", "n"]) for a in range(0, len(codes), 50)]
    kept, C.GRAMS = C.GRAMS, 60
    try:
        blocks = list(C.pair_blocks(iter(batches), 4))
    finally:
        C.GRAMS = kept
    assert len(blocks) > 5 and np.array_equal(np.concatenate([b[0] for b in blocks]), codes)
    sums = {}
    for c, k in blocks:
        for pair, row in zip(*C.pair_children(c, C.levels_of(c, k, 4), 4)):
            sums[pair] = sums.get(pair, 0) + row
    whole = dict(zip(*C.pair_children(codes, C.levels_of(codes, n, 4), 4)))
    assert sums.keys() == whole.keys() and all(np.allclose(sums[p], whole[p]) for p in sums)
    # after one context, the probabilities of all 256 bytes
    c = np.unique(np.concatenate([codes, (codes[7] >> 8 << 8) + np.arange(256)]))
    weights = np.stack([np.full((1, 255), 0.1), np.full((1, 255), 0.8)])
    counts = np.zeros(len(c))
    counts[np.searchsorted(c, codes)] = n
    logs = C.log_probabilities(c, C.levels_of(c, counts, 4), weights, np.zeros(len(c), np.int64))
    assert (10 ** logs[c >> 8 == codes[7] >> 8]).sum() == pytest.approx(1)


def test_long_text_and_nothing_to_learn_from(spark):
    frame = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in C.scores(frame, F.lit(False)).collect()}
    assert got[1].score == pytest.approx(24 * math.log10(0.5), rel=1e-6) and got[2].score == pytest.approx(8 * math.log10(0.5), rel=1e-6)
    assert got[1].base_score == 0 and got[1].n_known == 0 and got[1].n_tokens == 2 and got[2].bits_per_byte is None
    assert C.scores(frame.limit(0), F.lit(True)).count() == 0
    long = spark.createDataFrame([(1, "some words " * 300_000), (2, "some words some words"), (3, "zq#!x")], "doc_id long, text string")
    row = {r.doc_id: r for r in C.scores(long, F.lit(True)).collect()}
    assert row[1].n_bytes == 3_300_000 and row[1].n_tokens == 600_001 and row[1].bits_per_byte < 0.01 and row[3].bits_per_byte > 5


def test_both_ways_score_alike(spark):
    """Held by the tasks or joined to parts: the size of the model changes no score."""
    rnd = random.Random(8)
    docs = [(i, " ".join(rnd.choice("one two three ünd fünf six".split()) for _ in range(rnd.randrange(40)))) for i in range(60)] + [(60, None), (None, "one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ways = [sorted((tuple(r) for r in C.scores(frame, F.expr("doc_id % 3 > 0"), held=held).collect()), key=lambda r: str(r[0])) for held in (C.HELD, 0)]
    for a, b in zip(*ways, strict=True):
        assert a[0] == b[0] and all(x == y or abs(x - y) < 1e-9 for x, y in zip(a[1:], b[1:], strict=True))
