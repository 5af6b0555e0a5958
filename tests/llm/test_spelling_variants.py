import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from riskweave.llm import spelling_variants as S


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if doc is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    words, out = plain_words(rows), {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v)) if close else None
        form = best if best and words[best] >= 10 * n else None
        out[w] = [n, len(close), form, words[form] if form else None]
    def root(w):
        return w if out[w][2] is None else root(out[w][2])
    return sorted((w, *x, root(w)) for w, x in out.items())


def texts(seed=3):
    rnd = random.Random(seed)
    stems = ["international", "aaaaaaaa", "abababab", "straßeéèÿ", "mitigate", "×÷wordings", "internationale", "nationals", "x" * 300]
    rows = [(None, "Nullable nullable nullablE"), (None, None), (7, None), (8, ""), (9, " 12 3 Ānothingā 中"), (10, "One" * 4000 + " " + "One" * 4000), (11, "tailé"), (11, "tailé")]
    for i in range(240):
        words = []
        for _ in range(40):
            w = list(rnd.choice(stems[: rnd.choice([2, 9])]))
            for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w[k : k + rnd.choice([0, 1])] = rnd.choice(["", "e", "é", "Q"])
            words.append("".join(w))
        rows.append((rnd.choice([i, 12]), rnd.choice([" ", ", ", "1"]).join(words)))
    return rows


def found(spark, rows, schema="doc_id long, text string, word int, n int, id int"):
    docs = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], schema).repartition(3)
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in S.grouped(docs).collect())


def test_equals_all_pairs(spark):
    rows = texts()
    expected = brute(rows)
    assert sum(x[2] > 0 for x in expected) > 50 and any(x[3] for x in expected)
    assert found(spark, rows) == expected


def test_nodes_with_many_words_are_salted(spark, monkeypatch):
    rows = texts(5)
    monkeypatch.setattr(S, "MANY", 2)
    monkeypatch.setattr(S, "FEW", 3)
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], "doc_id long, text string, word int, n int, id int") == []
    assert found(spark, [(1, None), (None, "")]) == []


def test_counts_survive_small_memory(spark, monkeypatch):
    rows = texts(9)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in part], pa.int64()), "text": pa.array([r[1] for r in part], pa.string())}) for part in (rows[:99], rows[99:])]
    monkeypatch.setattr(S, "HELD", 10)
    n = Counter()
    for batch in S.counted(iter(batches)):
        for w, k in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n[w] += k
    assert {w: k for w, k in n.items() if k >= 2} == plain_words(rows)


def test_checksums():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abczé ") for _ in range(3000)).encode() + b" " + b"q" * 200
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = S.runs(data, np.array([0, len(data)]))
    before = np.array([zlib.crc32(b"12:")] * len(starts), np.uint32)
    assert S.checksums(data, starts, ends, before).tolist() == [zlib.crc32(b"12:" + text[a:b]) for a, b in zip(starts, ends, strict=True)]


def test_a_word_has_few_light_edges(spark):
    rnd = random.Random(2)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(7, 14))) for _ in range(3000)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, id long")
    most = max(len(r.light) for r in S.light_edges(table).collect())
    assert most <= len(words).bit_length()
