"""The inverted file against brute force, and how much of it queries visit."""

import numpy as np
import pyarrow as pa

from riskweave.operators import neighbours as V


def clustered(n, dim=16, groups=20, seed=3):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(groups, dim))
    return centres[pick.integers(0, groups, n)] + 0.15 * pick.normal(size=(n, dim))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")


def plain(rows, queries, k):
    ids, v = V.units(pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.float64())), len(rows[0][1]))
    at, out = {int(i): n for n, i in enumerate(ids)}, []
    for i in queries:
        if i in at:
            near = sorted((-round(float(s), 6), int(j)) for s, j in zip(v @ v[at[i]], ids, strict=True) if j != i)[:k]
            out += [(i, j, -s, n + 1) for n, (s, j) in enumerate(near)]
    return sorted(out)


def same(got, want):
    got = sorted(tuple(r) for r in got)
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


def test_equal_to_brute_force(spark):
    v = clustered(1500)
    rows = [(i, x.tolist(), "l") for i, x in enumerate(v)]
    rows[300:700] = [(i, rows[0][1], "copies") for i in range(300, 700)]  # a crowd of equal vectors, and broken ones
    rows[10:17] = [(10, None, None), (11, [], None), (12, [0.0] * 16, None), (13, [1.0, None] + [0.0] * 14, None), (14, [float("nan")] * 16, None), (15, [1.0] * 15, None), (None, [1.0] * 16, None)]
    rows[20] = (20, (-v[21]).tolist(), "opposite")
    df = frame(spark, rows)
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    for pivots, most in ((8, 50), (64, 20_000), (1, 100)):
        got = V.nearest(df.filter("vec_id % 10 = 0"), df, 3, pivots, most).collect()
        same(got, plain(rows, [r[0] for r in asked], 3))


def test_few_rows_and_none(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, None, "a")]
    assert sorted((r.id, r.vec_id, r.similarity, r.place) for r in V.nearest(frame(spark, rows), frame(spark, rows), 5).collect()) == [(1, 2, 0.0, 1), (2, 1, 0.0, 1)]
    for empty in (frame(spark, []), frame(spark, [(3, None, "a"), (4, [0.0, 0.0], "b")])):
        assert V.nearest(empty, empty).columns == ["id", "vec_id", "similarity", "place"] and V.nearest(empty, empty).count() == 0
    assert V.nearest(frame(spark, []), frame(spark, rows)).count() == 0


def test_queries_visit_a_part_only(spark):
    for n in (1000, 4000):
        v = clustered(n)
        rows = frame(spark, [(i, x.tolist(), "l") for i, x in enumerate(v)])
        held = V.inverted_file(rows, 64, 200)
        assert held.size.sum() == n
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        ids = np.arange(0, n, 20)
        marks = np.array([np.sort(np.delete(u @ u[i], i))[-3] for i in ids])
        _, places = held.visits(ids, u[ids], marks)
        sizes = dict(zip(*np.unique(held.places(np.arange(n), u), return_counts=True), strict=True))
        assert sum(sizes.get(p, 0) for p in places) < 0.4 * n * len(ids)
