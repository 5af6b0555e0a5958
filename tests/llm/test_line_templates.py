import random
import re
from collections import defaultdict

from riskweave.llm import line_templates as L


def masked(line):
    return tuple("<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line))


def need(n):
    return L.LONG_DOCS if n >= L.LONG else L.SHORT_DOCS


def brute(docs):
    """The same tree with dictionaries of Python."""
    texts = {text for _, text in docs if text is not None}
    where = defaultdict(set)
    for text in texts:
        for line in text.split("\n"):
            if len(masked(line)) >= L.LEAST_TOKENS:
                where[masked(line)].add(text)
    often = {t for t, d in where.items() if len(d) >= need(len(t))}
    copies = set()
    for text in texts:
        lines = [masked(x) for x in text.split("\n")]
        lost, words = sum(len(t) for t in lines if t in often), sum(map(len, lines))
        if lost > L.COPY_SHARE * words and (len(often.intersection(lines)) > 1 or lost >= L.WHOLE_SHARE * words):
            copies.add(text)
    own = {t: len(d - copies) for t, d in where.items()}
    recurs = lambda n, group: sum(own[t] for t in group) >= max(need(n), L.OWN_SHARE * sum(len(where[t]) for t in group))
    recurring = {t for t in where if recurs(len(t), [t])}
    leaves = defaultdict(list)
    for t in where:
        if len(t) >= L.LEAST_CONSTANT:
            leaves[len(t), t[: L.DEPTH]].append(t)
    more = set()
    for (n, _), lines in leaves.items():
        votes = defaultdict(int)
        for t in lines:
            for i, x in enumerate(t):
                votes[i, x] += own[t]
        groups = defaultdict(list)
        for t in lines:
            template = tuple((i, x) for i, x in enumerate(t) if votes[i, x] >= need(n))
            fixed = sum(x != "<*>" for _, x in template)
            if t not in recurring and fixed >= L.CONSTANT * n and fixed >= L.LEAST_CONSTANT:
                groups[template].append(t)
        for template, found in groups.items():
            agree = [t for t in lines if t in recurring and all(t[i] == x for i, x in template)]
            if recurs(n, found + agree):
                more |= set(found)
    recurring |= more
    out = []
    for doc_id, text in docs:
        parts = text.split("\n") if text is not None else []
        gone = [i for i, p in enumerate(parts) if masked(p) in recurring]
        new = text if not gone else "\n".join(p for i, p in enumerate(parts) if i not in gone)
        out.append((doc_id, new, len(gone)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    vocab = [f"{a}{b}" for a in "bcdfghklmn" for b in ("an", "el", "ir", "op", "us")]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage = say(60)
    docs = []
    for i in range(90):
        body = [say(rnd.randrange(4, 30)) for _ in range(rnd.randrange(4, 9))]
        if i % 3 == 0:
            body.insert(1, f"Posted on 2024-01-{i} by user{i} at site")
        if i % 4 == 0:
            body.append(f"Read more about {rnd.choice(vocab)}x{'abcdefghij'[i % 10]} in the weekly letter of news")
        if i % 30 == 0:
            body.insert(2, passage)
        if i % 5 == 0:
            body += ["All rights reserved", "All rights reserved", "", "short one"]
        docs.append((i, "\n".join(body)))
    docs += [(200 + i, docs[1][1]) for i in range(12)] + [(docs[3]), (docs[3]), (None, docs[5][1]), (300, None), (301, ""), (302, "\n\n"), (303, "All rights reserved"), (304, "x" * 50_000)]
    docs += [(310, "Posted on 2024-01-7 by user7 at site"), (311, "own little words\nPosted on 2024-01-7 by user7 at site")]
    base = [say(14) for _ in range(12)]  # near copies: each has another line of its own
    docs += [(400 + i, "\n".join([*base[: i % 12], say(14), *base[i % 12 + 1 :]])) for i in range(30)]
    long, notice = say(50), say(9)  # the larger part of many texts, which are no copies
    docs += [(600 + i, f"{say(20)}\n{long}") for i in range(30)] + [(700 + i, f"{notice}\n{say(4)}") for i in range(40)]
    return [*docs, (500, "\n".join([say(9) for _ in range(20_000)] + ["All rights reserved"]))]


def test_rows_equal_brute_force(spark):
    docs = corpus()
    frame = spark.createDataFrame([(a, b, 1, 2, 3, 4) for a, b in docs], "doc_id long, text string, leaf int, text_key int, drop int, row int")
    want = brute(docs)
    for most_held in (L.MOST_HELD, 0):
        got = L.without_templates(frame, most_held=most_held).select("row.doc_id", "text", "n_dropped").collect()
        assert sorted(map(tuple, got), key=str) == want
    assert sum(r[2] for r in want) > 40 and all(r[2] == 0 for r in want if r[0] in range(400, 430))  # near copies stay whole
    assert not any(x in (r[1] or "") for r in want for x in ("weekly letter", "Posted on"))
    assert all(r[2] == 1 for r in want if r[0] in range(600, 740))
    assert dict((r[0], r[1]) for r in want)[310] == ""
    clean = L.deduplicated_lines(frame, chars_col="leaf")
    assert clean.columns == frame.columns
    assert sorted(((r.doc_id, r.text, r.text_key, r.drop, r.row) for r in clean.collect()), key=str) == sorted(((r[0], r[1], 2, 3, 4) for r in want), key=str)


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert L.deduplicated_lines(frame, chars_col="n_chars").count() == 0


def test_recurring_variants_support_their_template(spark):
    """11 documents share one line, 9 more have 9 other values in it: the template stands in 20."""
    line = "Read more about the {} in our weekly letter of news"
    words = ["river"] * 11 + ["moon", "sun", "star", "tree", "bird", "fish", "stone", "wind", "rain"]
    own = [" ".join(f"{a}{'abcdefghijklmnopqrst'[i]}" for a in "bcdfghklmnprstvwz") for i in range(20)]
    docs = [(i, f"{own[i]}\n{line.format(w)}") for i, w in enumerate(words)]
    got = {r.doc_id: r.text for r in L.deduplicated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(own))
