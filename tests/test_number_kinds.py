"""Kinds of numbers are sought near digits only; what is found is what the whole text has."""

import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskweave.functions import normalise as N

WORDS = sorted({w for p in N.NUMBER_KINDS.values() for w in re.findall("[a-z]{2,}", re.sub(r"\[[^]]*\]|\\.", " ", p))})
NUMBERS = ["5", "12", "1999", "10.5", "3/5", "8.8.8.8", "1,250.00", "10:30", "2024-05-06", "1/2/2024", "560001", "ab12", "12abcde1234f1z5", "abcde1234f", "abcd-1xx", "$ 5", "€9", "3rd", "50 %", "4 out of 10"]
PARTS = [" ", " ", "", ".", ": ", "#-", "\n", "é", "́" * 30, "😀" * 26, "é", "_", "per|night"]
EXACT = ["reservation: abcd-1xx", "reservation: abcd-123", "booking#-zzzz-9ab", "september .5", "2 september", "5an|person", "wifi abcd", "password: abcdefghijklmnop", "pass x", "bypass abcd", "4 out of 100", "flight ab 12", "in 1999", "since: 2001", "pincode: 560001", "almost 7", "motorway: 5", "sac 9954", "abcde1234f", "apartment .4", "7 percent", "8 minutes"]


def texts(seed):
    """Texts of numbers, words that go with them and stretches without either, just long enough to be cut or not."""
    pick = random.Random(seed)
    filler = lambda: "".join(pick.choice("qxj ́é😀") if pick.random() < 0.1 else "q" for _ in range(pick.choice([0, 0, 1, N.REACH - 1, 2 * N.REACH - 1, 2 * N.REACH, 3 * N.REACH])))
    part = lambda: pick.choice((pick.choice(WORDS), pick.choice(NUMBERS), pick.choice(PARTS), pick.choice(PARTS)))
    for _ in range(1500):
        yield "".join(f"{filler()}{pick.choice(('', ' '))}{pick.choice(EXACT) if pick.random() < 0.2 else ''.join(part() for _ in range(6))}{pick.choice(('', ' '))}{filler()}" for _ in range(3))


def test_kinds_near_digits_are_those_of_the_whole_text(spark):
    odd = [None, "", "7", "q" * 500, "q" * 500 + "7", "7" + "q" * 500, *EXACT]
    rows = spark.createDataFrame([(t,) for t in [*odd, *texts(1)]], "t string").withColumn("near", N.near_digits(F.col("t")))
    cases = [c for n, p in N.NUMBER_KINDS.items() for c in (F.count_if(F.col("t").rlike(p)), F.count_if(N.has_kind(F.col("t"), F.col("near"), n) != F.col("t").rlike(p)), F.count_if(N.has_kind(F.col("t"), F.col("near"), n)))]
    got = list(rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cases)]).first())
    for name, found, other, near in zip(N.NUMBER_KINDS, got[::3], got[1::3], got[2::3], strict=True):
        assert found == near and other == 0 and found, name


def test_stretches_without_digits_are_cut(spark):
    cut = lambda t: spark.createDataFrame([(t,)], "t string").select(N.near_digits(F.col("t"))).first()[0]
    long = "word " * 20_000
    assert cut(long) is None and cut(None) is None and cut("5 km") == "5 km"
    assert len(cut(f"{long}in 1999 {long}at 5 km {long}")) < 300
    assert cut("7" + "q" * (2 * N.REACH) + "7") == "7" + "q" * N.REACH + "\n" + "q" * N.REACH + "7"
    assert cut("7" + "q" * (2 * N.REACH - 1) + "7") == "7" + "q" * (2 * N.REACH - 1) + "7"


def test_query_seeks_kinds_near_digits_and_equals_sql(spark, tmp_path):
    said = ["In 1999 it cost 20 USD", "wifi: ABCDE", "pass", None, "", "ROOM 5 " + "on and on " * 50 + " about 7 days", "on and on"]
    rows = [(i, lang, t) for i, (lang, t) in enumerate((x, t) for x in ("en", None, "de") for t in (said if x != "de" else [None, "no digit"]))]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["numeric_context_counts"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, duck.sql(entry.oracle_sql()["numeric_context_counts"]).fetchall()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(t#", plan)) <= 2 and len(set(re.findall(r"RLIKE\((near#\d+)", plan))) == 1  # a digit, and the kind without one
