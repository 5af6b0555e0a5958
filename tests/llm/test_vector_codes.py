import hashlib
import random

import numpy as np

from riskweave.llm import vector_codes as V


def brute(rows, entries, parts=4, rounds=4, scale=1024):
    """Lloyd rounds with all distances, in whole numbers."""
    usable = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)
    kept = sorted(((i, label, [int(np.floor(scale * x)) for x in v]) for i, label, v in rows if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    at = [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in at]
    far = lambda x, y: sum((s - t) ** 2 for s, t in zip(x, y, strict=True))
    near = lambda p, v: min((far(v[at[p][0] : at[p][1]], y), e) for e, y in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(p, r[2])[1] for r in kept] for p in range(parts)]
        for p, (a, b) in enumerate(at):
            for e in range(len(books[p])):
                own = [r[2][a:b] for r, x in zip(kept, found[p], strict=True) if x == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for i, label, v in kept:
        pairs = [near(p, v) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in pairs), sum(d for d, _ in pairs)))
    digest = hashlib.sha256(",".join(str(x) for book in books for y in book for x in y).encode()).hexdigest()
    label_error = {}
    for _, label, _, error in out:
        label_error[label] = label_error.get(label, 0) + error
    return sorted(((i, label, code, error, label_error[label], digest) for i, label, code, error in out), key=str)


def vectors(n, seed, width=10, grid=None):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 0.2) for _ in range(width)] for _ in range(9)]
    rows = []
    for i in range(n):
        v = [c + rnd.gauss(0, 0.03) for c in rnd.choice(centres)]
        rows.append((rnd.choice([i, i, 4]), rnd.choice([None, 1, 1, 1, 2]), [round(x * grid) / grid for x in v] if grid else v))
    odd = [(None, 1, [0.1] * width), (3, 2, None), (5, None, []), (6, 1, [0.1, None, *[0.0] * (width - 2)]), (7, 1, [float("nan")] * width), (8, 1, [float("inf")] * width), (9, 1, [0.5] * (width - 1)), rows[0], rows[0]]
    return rows + odd


def found(spark, rows, entries, kind="double"):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, label int, embedding array<{kind}>, v int, code int").repartition(3)
    out, books = V.compressed(df, entries=entries)
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out.collect()), key=str), books


def test_equals_all_distances(spark):
    rows = vectors(250, 1)
    assert found(spark, rows, 32)[0] == brute(rows, 32)


def test_ties_go_to_the_lower_index(spark):
    rows = vectors(250, 2, grid=4)  # few different values: many entries tie and some stay unused
    expected = brute(rows, 64)
    assert found(spark, rows, 64)[0] == expected


def test_few_and_no_rows(spark):
    rows = vectors(3, 4)
    assert found(spark, rows, 256)[0] == brute(rows, 256)
    assert found(spark, [(1, 1, None), (None, None, [float("nan")])], 256)[0] == []
    assert found(spark, [], 256)[0] == []


def test_bounds_prune_and_never_err():
    rng = np.random.default_rng(5)
    centres = rng.integers(-1000, 1000, (40, 8))
    x = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 8))
    book = V.Codebook(x[:64].copy())
    at, upper, lower = book.nearest(x)
    compared = []
    for _ in range(4):
        new = np.array([x[at == e].sum(0) // max(1, (at == e).sum()) if (at == e).any() else book.entries[e] for e in range(64)])
        book = V.Codebook(new, book.entries)
        small, step = V.packed_down(lower)
        kept = small * step[:, None] * (1 - V.ROOM)
        assert (kept <= lower).all()
        d = V.squared(x, book.entries)
        shifted = np.maximum(kept - book.moved[None, :], 0)
        assert (shifted <= np.sqrt(d) * (1 + 1e-12)).all()
        bound = np.maximum(shifted, book.half[at])
        compared.append(float((bound <= (upper + book.moved[at])[:, None]).mean()))
        at, upper, lower = book.again(x, at, upper, kept)
        assert (at == d.argmin(1)).all() and (upper >= np.sqrt(d.min(1))).all() and (lower <= np.sqrt(d)).all()
    assert compared[-1] < 0.25


def test_large_whole_numbers_stay_exact():
    x = np.array([[V.LARGEST - 1] * 8, [1 - V.LARGEST] * 8], np.int64)
    assert V.squared(x, x)[0, 1] == sum((2 * (V.LARGEST - 1)) ** 2 for _ in range(8))
