"""The number grammar against plain rules over made-up rows of tokens, and against SQL over planted documents."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskweave import assets as A
from riskweave.functions import normalise as N
from riskweave.functions import numbers
from riskweave.functions import numbers as G

CASES = [
    ("call nine eight seven", "987"), ("ninety eight", "908"), ("double seven eight", "778"), ("double 7 eight", "778"), ("triple twenty", "20"), ("double", ""),
    ("deux chats", ""), ("deux 5", "25"), ("double deux", "22"),  # other languages: beside any number
    ("i won 5 games", "5"), ("5 won 6", "516"), ("won nine", "19"), ("won 6", "16"), ("we won", ""),  # words of another meaning: inside a dictation
    ("to 5", "5"), ("to five", "25"), ("sevn 5", "5"), ("sevn five", "75"), ("sveen five", "75"), ("seven fire", "7"),  # grammar and errors: beside a spelled number
    ("s1x", "6"), ("f0ur", "4"), ("oneseventwo", "172"), ("xxoneseventwoyy", "172"), ("onetwo", ""), ("fivefour9", "549"), ("nine99", "999"), ("room99", "99"), ("", ""), (None, None),
]


def test_each_class_has_its_rule(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, t string")
    got = [r.d for r in rows.select("i", N.number_digits(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [d for _, d in CASES]


def plainly(tokens):
    """The rules once more, token by token."""
    found = [G.classified(t) for t in tokens]
    name = lambda i: KIND[found[i][0]] if 0 <= i < len(tokens) else None
    KIND = {**G.KINDS, "W": "word"}
    value = []
    for i, (c, v) in enumerate(found):
        sides = [s for s in (name(i - 1), name(i + 1)) if s]
        said = any(s in ("core", "glued", "risky", "homophone", "fuzzy") for s in sides)
        number = any(s != "word" for s in sides)
        every = bool(sides) and all(s != "word" for s in sides)
        rule = {"core": True, "glued": True, "digits": True, "risky": number, "homophone": said or every, "fuzzy": said, "modifier": False, "word": False}
        value.append(v if rule[KIND[c]] else None)
    for i in range(len(tokens) - 1):
        if found[i][0] == "M" and value[i + 1] is not None and len(value[i + 1]) == 1:
            value[i], value[i + 1] = "", value[i + 1] * A.REPEATS[tokens[i]]
    return "".join(f" {t} " if v is None else v for t, v in zip(tokens, value, strict=True))


def test_rows_of_tokens_by_brute_force():
    rng = random.Random(5)
    words = ["seven", "twenty", "oneseventwo", "deux", "saat", "won", "first", "to", "for", "sevn", "double", "triple", "5", "42", "house", "plain"]
    for _ in range(4000):
        tokens = rng.choices(words, k=rng.randint(0, 7))
        assert G.read_numbers(" ".join(tokens))[0] == plainly(tokens), tokens


def most_words(token):
    """(words, digits) of the stretch with most core words on end, the longest and then the first of several; by trying every start."""
    def run(i):
        best = (0, 0, "")
        for w, v in A.CORE_NUMBERS.items():
            if token.startswith(w, i):
                n, length, rest = run(i + len(w))
                best = max(best, (n + 1, length + len(w), v + rest), key=lambda b: b[:2])
        return best

    return max((run(i) for i in range(len(token))), key=lambda b: b[:2])[::2]


def test_longest_split_by_brute_force():
    rng = random.Random(6)
    parts = ["one", "seven", "seventy", "teen", "six", "sixty", "ty", "ten", "x", "eight", "eighty"]
    for _ in range(2000):
        token = "".join(rng.choices(parts, k=rng.randint(1, 6)))
        words, low, high, value = G.split(token)
        assert (words, value) == most_words(token), token
        assert re.fullmatch("(?:" + "|".join(A.CORE_NUMBERS) + "){%d}" % words, token[low:high])


def test_a_very_long_token_and_text():
    assert G.read_numbers("seventwo" * 5000)[1] == [("glued", "72" * 5000)]
    assert len(G.read_numbers("house seven " * 20000)[1]) == 20000


def test_query_equals_sql_on_planted_documents(spark, tmp_path):
    rng = random.Random(7)
    words = ["seven", "twenty", "deux", "saat", "won", "first", "to", "for", "sevn", "sveen", "nin", "eihgt", "double", "5", "42", "house", "plain", "s1x", "oneseventwo", "fivefour9", "Größe", "ｎｉｎｅ", "५"]
    docs = [(i, rng.choice([" ", ", ", "-"]).join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = duck.sql(entry.oracle_sql()["number_classes"]).df()
    got = entry.queries()["number_classes"](spark, str(tmp_path)).toPandas()
    columns = sorted(sql.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, sql[columns].values.tolist()))
    assert (got[["core", "risky", "homophone", "fuzzy", "glued", "written"]].sum() > 0).all()


@pytest.mark.parametrize("text", ["week 98765 43210", "98765 43210"])
def test_written_numbers_alone_are_not_spelled(spark, text):
    assert not spark.createDataFrame([(text,)], "t string").select(G.spelled(G.numbers(F.col("t"))).alias("s")).first().s


def test_misread_words_are_looked_up(monkeypatch):
    """Each word's class comes from one lookup that gives what comparing it with all core words gives."""
    words = [w for w in numbers.A.CORE_NUMBERS if len(w) >= numbers.FUZZY_FROM]
    tokens = {w[:i] + c + w[j:] for w in words for i in range(len(w) + 1) for j in (i, i + 1, i + 2) for c in ("", "q", "é", w[i : i + 2][::-1])}
    tokens = sorted(t for t in tokens if len(t) >= numbers.FUZZY_FROM and t.isalpha() and t not in numbers.listed() and t not in numbers.A.NEAR_NUMBERS)
    slow = {t: next((numbers.A.CORE_NUMBERS[w] for w in words if numbers.near(t, w)), None) for t in tokens}
    monkeypatch.setattr(numbers, "near", None)
    numbers.classified.cache_clear()
    assert {t: (numbers.classified(t) if slow[t] is not None else None) for t in tokens} == {t: ("Z", v) if v is not None else None for t, v in slow.items()}
    assert len([v for v in slow.values() if v is not None]) > 300 and all(numbers.classified(t)[0] in "WGC" for t in tokens if slow[t] is None)
