import math
import random
import re
from itertools import combinations

from riskweave.llm import decontamination as D


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, items):
    out = set()
    for doc_id, text in docs:
        a = tokens(text)
        for item_id, item in items:
            b = tokens(item)
            if len(b) < D.LEAST:
                continue
            width = min(len(b), D.WINDOW)
            least = math.ceil(D.SHARE * width) if len(b) >= D.WINDOW else width
            if any(sum(x == y for x, y in zip(a[i : i + width], b[j : j + width])) >= least for i in range(len(a) - width + 1) for j in range(len(b) - width + 1)):
                out.add((doc_id, item_id))
    return out


def test_masks_find_every_window_within_the_share():
    most = D.WINDOW - math.ceil(D.SHARE * D.WINDOW)
    ones = [[i for i, c in enumerate(m) if c == "1"] for m in D.MASKS]
    for bad in combinations(range(D.WINDOW), most):
        assert any(not {s + i for i in o} & set(bad) for o, m in zip(ones, D.MASKS) for s in range(D.WINDOW - len(m) + 1))


def test_rows_equal_brute_force(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Ñandú", "x9"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, say(rnd.choice([3, 5, 7, 8, 12, 13, 20, 45]))) for i in range(40)] + [(90, None), (91, ""), (92, "w1 w2"), (0, "again " + say(15))]
    docs = [(1, None), (2, ""), (3, "w1 w2"), (None, say(5) + " " + items[6][1] + " " + say(9))]
    for i in range(120):
        item = tokens(rnd.choice(items)[1])
        cut = rnd.randrange(len(item) + 1) if rnd.random() < 0.3 else 0
        part = item[cut:]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 6])):
            if part:
                part[rnd.randrange(len(part))] = "zz"
        docs.append((10 + i, say(rnd.randrange(0, 30)) + ", " + "-".join(part).upper() + ".\n" + say(rnd.randrange(0, 30))))
    docs += [docs[5], docs[5], (900, say(3000) + " " + items[7][1])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(a, b, "q") for a, b in items], "item_id long, text string, doc_id string")
    got = D.contaminated(frame, bench).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len({(r.doc_id, r.item_id) for r in got})
    clean = D.clean_documents(frame, bench)
    bad = {d for d, _ in want}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in docs if d not in bad)
    assert clean.columns == frame.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0
    assert D.clean_documents(docs, none).count() == 1
    assert D.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")).count() == 0
