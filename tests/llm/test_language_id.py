import math
import random

from riskweave.llm import language_id as L

STEMS = {
    "en": ["th", "ing", "er", "tion", "and", "ough", "ly"],
    "de": ["sch", "ung", "ein", "tz", "ä", "keit", "pf"],
    "fr": ["eau", "ç", "oi", "tion", "é", "aux", "elle"],
    "es": ["ción", "ñ", "ll", "ado", "ez", "mente", "rr"],
}


def texts(n, words, seed):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lang = rnd.choice(list(STEMS))
        out.append((i + seed * 10_000, " ".join("".join(rnd.choice(STEMS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(words)), lang))
    return out


def test_held_out_accuracy_and_edges(spark):
    schema = "doc_id long, text string, lang string"
    model = L.learn(spark.createDataFrame(texts(400, 40, 1), schema), sample=60)
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    unseen = texts(300, 30, 2)
    odd = [(-1, None, "en"), (-2, "", "en"), (-3, "12 34 !!", "en"), (-4, "é", "fr"), (-5, "x", None), (None, "the thing and the", None)]
    got = {r.doc_id: r for r in L.identified(spark.createDataFrame([(*r, 1) for r in unseen + odd], schema + ", score int"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in unseen) >= 290
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    assert got[-4].lang_pred in STEMS and all(0 <= r.score <= 1 for r in got.values())


def plain_prediction(model, text):
    """Counts, margins, votes and ties of one text in plain Python."""
    data = text.lower().encode()
    at = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        mixed = (a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF
        k = (mixed * 0x27D4EB2F & 0xFFFFFFFF) >> 19
        at[k] = at.get(k, 0) + 1
    n = max(1, len(data) - 2)
    margin = [sum(m * float(model.weights[k, j]) for k, m in at.items()) / n + (float(model.offsets[j]) if at else 0.0) for j in range(model.weights.shape[1])]
    f = max(range(len(model.families)), key=lambda g: (margin[g], -g))
    votes, sums = {}, {}
    for j, (g, a, b) in enumerate(model.pairs, len(model.families)):
        if g == f:
            won = a if margin[j] >= 0 else b
            votes[won] = votes.get(won, 0) + 1
            sums[a], sums[b] = sums.get(a, 0) + margin[j], sums.get(b, 0) - margin[j]
    best = max(range(len(model.languages[f])), key=lambda c: (votes.get(c, 0), sums.get(c, 0), -c))
    sure = [(margin[f] - max(m for g, m in enumerate(margin[: len(model.families)]) if g != f)) / 2] if len(model.families) > 1 else [3.0]
    sure += [margin[j] if best == a else -margin[j] for j, (g, a, b) in enumerate(model.pairs, len(model.families)) if g == f and best in (a, b)] or [3.0]
    return model.languages[f][best], 1 / (1 + math.exp(-2 * min(sure)))


def test_predictions_equal_plain_ones(spark):
    schema = "doc_id long, text string, lang string"
    model = L.learn(spark.createDataFrame([*texts(300, 30, 4), *((50_000 + i, t.replace("e", "ij"), "nl") for i, t, lang in texts(300, 30, 5) if lang == "de")], schema), sample=40)
    assert len(model.pairs) == 4
    rows = texts(120, 12, 6) + [(-1, "ab", None), (-2, "é" * 40, None), (-3, "the thing " * 20_000, None), (-4, "THE Thing", None)]
    got = {r.doc_id: r for r in L.identified(spark.createDataFrame([(*r, "x", 1.0) for r in rows], schema + ", lang_pred string, score double"), model).collect()}
    for i, text, _ in rows:
        name, score = plain_prediction(model, text)
        assert got[i].lang_pred == name and abs(got[i].score - score) < 1e-3, text[:40]


def test_nothing_or_one_language_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    assert L.learn(spark.createDataFrame([(1, "a text", None), (2, None, "en"), (None, "b", "en")], schema)) is None
    docs = spark.createDataFrame([(1, "some words", "xx"), (1, "some words", "xx")], schema)
    assert [r.lang_pred for r in L.identified(docs, L.learn(docs)).collect()] == ["xx", "xx"]
    assert [r.lang_pred for r in L.identified(docs, None).collect()] == ["und", "und"]
    assert L.identified(docs.limit(0), L.learn(docs)).count() == 0


def test_sample_is_bounded_and_repeatable(spark):
    docs = spark.createDataFrame(texts(2000, 3, 3), "doc_id long, text string, lang string")
    one = L.sampled(docs, 20)
    assert one.count() <= 20 * 4
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in L.sampled(docs.repartition(7), 20).collect())
    dirty = spark.range(900).selectExpr("id AS doc_id", "'a text' AS text", "concat('x', id % 450) AS lang")
    assert L.sampled(dirty, 300).select("lang").distinct().count() == L.LANGUAGES and L.sampled(dirty, 300).count() <= L.ROWS
