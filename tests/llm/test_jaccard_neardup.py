import random
import re

import corpus_pipeline
from riskweave.llm import jaccard_neardup as J


def shingles(text, words=5):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """component_id by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    return [min((d for (d, _), y in zip(rows, label, strict=True) if y == x and d is not None), default=None) for x in label]


def corpus():
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = say(45)
    rows = [(None, "null id here now it is"), (0, None), (1, ""), (2, " \t"), (3, "One"), (4, "one"), (5, "a b c"), (5, "a b c")]
    for k in range(40):
        base = say(rnd.choice([30, 120, 300])) + (passage if k % 2 else [])
        rows.append((len(rows), " ".join(base)))
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randrange(1, 2 + len(copy) // 35)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    base = say(100)
    for _ in range(60):  # one dense group, whose shingles are all common
        copy = list(base)
        copy[rnd.randrange(100)] = copy[rnd.randrange(100)] = rnd.choice(vocab)
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(passage + say(12))) for i in range(50)]  # mostly a common passage
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == sorted(zip([d for d, _ in rows], brute(rows), strict=True), key=str)


def test_stage_drops_near_copies(spark, tmp_path):
    """Pairs of similarity 0.8 to 0.9, of which fingerprints of 4 bits find few."""
    rnd = random.Random(6)
    rows, near = [], 0
    for k in range(60):
        base = [f"v{rnd.randrange(3000)}" for _ in range(200)]
        copy = list(base)
        for i in (20, 90, 160)[: 2 + k % 2]:
            copy[i] = "other"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        near += 0.8 <= len(a & b) / len(a | b) <= 0.91
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path)).collect()
    assert near == 60 and sorted(r.doc_id for r in kept) == list(range(0, 120, 2))


def test_near_copies_that_are_no_links_meet_seldom(spark, monkeypatch):
    """800 changed copies of one text, mostly of similarity 0.5 to 0.8: what all have in common must not bring all pairs together."""
    rnd = random.Random(7)
    base = [f"u{i}" for i in range(150)]
    rows = []
    for k in range(800):
        copy = list(base)
        for i in rnd.sample(range(150), 8):
            copy[i] = f"x{k}y{i}"
        rows.append((k, " ".join(copy)))
    compared, before = [], J.materialize

    def counted(df, tag):
        out = before(df, tag)
        compared.append(out.count() if tag == "pairs" else 0)
        return out

    monkeypatch.setattr(J, "materialize", counted)
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == list(zip(range(800), brute(rows), strict=True))
    assert sum(compared) < 30 * len(rows)
