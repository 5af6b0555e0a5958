import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskweave.llm import simhash_neardup as S


def brute(rows, words=4, threshold=4):
    """Fingerprints by counting bits, components over all pairs."""
    prints = []
    for _, text in rows:
        tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= threshold:
                parent[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return sorted(((doc, f"{prints[i]:016x}", smallest.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str)


def texts(n, seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(None, "null id here now it is"), (0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "a b c"), (5, "a b c"), (6, "é ñ A\x1cB c d e")]
    for k in range(n):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([30, 120, 400]))]
        for _ in range(rnd.choice([1, 1, 3, 8])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((100 + len(rows), " ".join(copy)))
    return rows


def found(spark, rows, **how):
    docs = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, fp int, root int")
    out = S.near_duplicates(docs, **how)
    return sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out.collect()), key=str)


def test_equals_all_pairs(spark):
    rows = texts(60)
    assert found(spark, rows) == brute(rows)


def test_crowded_anchors_are_tiled_without_loss(spark):
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(500)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rnd.randrange(500)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    assert found(spark, rows, tile=16) == brute(rows)


def test_every_pair_within_threshold_meets_at_a_home(spark):
    rnd = np.random.default_rng(3)
    code = S.Covering(4, 3)
    x = rnd.integers(0, 2**63, 200, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rnd.choice(64, rnd.integers(0, 5), replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    home, visit = {}, {}
    for anchor, value, is_home in code.replicate(np.concatenate([x, y])):
        for a, v, h in zip(anchor, value, is_home):
            visit.setdefault(int(v), set()).add(int(a))
            if h:
                home.setdefault(int(v), set()).add(int(a))
    assert all(home[int(a)] & visit[int(b)] for a, b in zip(x, y))
    assert all(len(v) == 3 for v in home.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
    assert S.deduplicated(docs).count() == 0


def test_long_chain_is_one_component(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = S.components(edges).collect()
    assert len(roots) == 201 and {r.root for r in roots} == {0}


def test_deduplicated_keeps_one_row_of_each_component(spark):
    rows = texts(30, 2)
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, k int")
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    groups = {c if c is not None else fp for _, fp, c in brute(rows)}
    got = kept.collect()
    assert len(got) == len(groups)
    assert {r.doc_id for r in got if r.doc_id is not None} == {g for g in groups if isinstance(g, int)}


def test_one_of_each_by_joins_where_keys_are_many(spark, monkeypatch):
    rows = texts(12)
    docs = spark.createDataFrame([(a, b, i % 2) for i, (a, b) in enumerate(rows + rows[:6])], "doc_id long, text string, row int").cache()
    few = sorted(map(str, S.deduplicated(docs).collect()))
    monkeypatch.setattr(S, "MOST_BROADCAST", 0)
    assert sorted(map(str, S.deduplicated(docs).collect())) == few and 0 < len(few) < docs.count()
