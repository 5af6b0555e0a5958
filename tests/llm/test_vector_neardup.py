import math
import random

import numpy as np

from riskweave.llm import vector_neardup as V


def brute(rows, threshold=0.95):
    usable = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if usable[i] and usable[j] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    parent[find(i)] = find(j)
    smallest = {}
    for i, (vec, _) in enumerate(rows):
        if vec is not None:
            smallest[find(i)] = min(vec, smallest.get(find(i), vec))
    return sorted(((vec, n[i], smallest.get(find(i)), vec == smallest.get(find(i))) for i, (vec, _) in enumerate(rows)), key=str)


def vectors(n, seed=1, size=64):
    """Vectors with copies at all cosines from 0.9 to 1, in groups of different size."""
    rng, rnd = np.random.default_rng(seed), random.Random(seed)
    rows = [(None, [1.0] * size), (None, None), (1, None), (2, []), (3, [0.0] * size), (4, [float("nan")] * size), (5, [float("inf")] + [0.0] * (size - 1)), (6, [None] + [1.0] * (size - 1)), (7, [1e-30] * size), (8, [3e30] * size), (9, [1.0] * (size + 3)), (9, [2.0] * (size + 3)), (10, [-0.0, *[1.0] * (size - 1)]), (11, [0.0, *[1.0] * (size - 1)])]
    while len(rows) < n:
        base = rng.standard_normal(size)
        base /= np.linalg.norm(base)
        for _ in range(rnd.choice([1, 2, 2, 5, 60])):
            away = rng.standard_normal(size)
            away -= away @ base * base
            cosine = rnd.choice([1.0, rnd.uniform(0.9, 1.0), rnd.uniform(0.94, 0.96)])
            v = cosine * base + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
            rows.append((100 + len(rows), (v * rnd.choice([1, 1, 3])).tolist()))
    return rows + rows[-3:]


def found(spark, rows, **how):
    df = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "vec_id long, embedding array<double>, node int, v int, size int").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df, **how).collect()), key=str)


def test_equals_all_pairs(spark):
    rows = vectors(700)
    assert found(spark, rows) == brute(rows)


def test_crowded_tiles_are_cut(spark):
    rows = vectors(400, 2)
    assert found(spark, rows, tile=20, shape=(0, 1)) == brute(rows)


def test_recall_with_many_tables(spark):
    """Tables as for a billion vectors: pairs at the threshold itself are met."""
    rows = vectors(900, 3)
    links, expected = sum(r[1] for r in found(spark, rows, shape=V.plan(10**9, 0.95))), sum(r[1] for r in brute(rows))
    assert links <= expected and links >= 0.995 * expected


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, None), (3, [0.0])]) == [(3, 0, 3, True), (None, 0, None, True)]


def test_plan_grows_slowly():
    assert V.plan(0, 0.95) == (0, 1) and V.plan(500, 0.95) == (0, 1)
    bits, tables = V.plan(10**9, 0.95)
    assert bits == 21 and tables <= 120


def test_bounds_hold_and_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    size = 64
    x, errors = rng.standard_normal(size), []
    x /= np.linalg.norm(x)
    for seed in range(400):
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
        q *= np.sign(np.diag(r))
        away = rng.standard_normal(size)
        away -= away @ x * x
        cosine = rng.uniform(0.5, 1)
        y = cosine * x + math.sqrt(1 - cosine**2) * away / np.linalg.norm(away)
        code = np.sign(x @ q) / math.sqrt(size)
        f, g = code @ (x @ q), code @ (y @ q)
        assert g >= math.cos(math.acos(f) + math.acos(cosine)) - 1e-9
        if cosine >= 0.95:
            assert g >= V.least_product(np.array([f]), size, 0.95, 6.0)[0]
        errors.append(g / f - cosine)
    assert abs(np.mean(errors)) < 4 * np.std(errors) / math.sqrt(len(errors))
