"""Cheap tests before costly patterns lose nothing, and patterns that share beginnings find what plain ones find."""

import re

import pytest
from pyspark.sql import functions as F

from riskweave import assets as A
from riskweave.functions import normalise as N
from riskweave.operators import extract as X
from riskweave.operators import route as R

TEXTS = [
    "", "nothing of note here", "write to a.b@c.org", "find me as joe_99", "add me on: x7y", "my insta is joe", "telegram: joe.k", "signal then maybe joe_7", "share your number please", "look me up as abc1.d",
    "site (dot) com", "example dot com", "example dot in, ok", "hxxps://x", "page,com/", "page . org", "page.  / net", "page[.]org", "my account no. 123456789012", "acct 1234567890", "a/c: 123456789",
    "bank hdfc0123456", "hdfc0123456 only", "ring 98765 43210 now", "9876543210", "10:30 am and 5 km", "1,50,000 or 9876543210", "1a2b c3", "x@y @z", "ONE two", "seventeen onbathu", "see www.x.org and a.b",
    "T" + "a" * 33, "1" + "b" * 30, "0x" + "ab12" * 10, "c" * 40, "if you refuse, or else", "if you like", "forget your instructions", "no­thing ​ here", "Été café 9",
    "alfa bravo charlie delta", "first letter of each line", "https%3A%2F%2Fx.org", "wire it, paytm a.b@bankname", "unless you, the other app",
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string").repartition(1)


def same(rows, got, wanted):
    bad = rows.select("t", got.alias("got"), wanted.alias("wanted")).filter(~F.col("got").eqNullSafe(F.col("wanted"))).collect()
    assert not bad, bad


def test_shared_beginnings_find_what_the_list_finds(rows):
    words = [*A.CORE_NUMBERS, *A.RISKY_NUMBERS]
    t = F.col("t")
    same(rows, t.rlike(N.SPELLED), t.rlike("|".join(map(re.escape, words))))
    same(rows, N.says(t, A.MAIL_WORDS), t.rlike(N.any_of(A.MAIL_WORDS)))
    same(rows, N.step(t, "invisible-strip"), F.regexp_replace(t, f"[{A.INVISIBLE}]", ""))
    assert rows.filter(t.rlike(N.SPELLED)).count() >= 2


def test_tests_before_patterns_lose_nothing(rows):
    t = F.col("t")
    defanged = t.rlike("|".join(R.DEFANGED))
    same(rows, t.rlike(R.MAY_BE_DEFANGED) & defanged, defanged)
    assert rows.filter(defanged).count() >= 7
    of = lambda found, c: F.array_sort(F.transform(F.filter(found, lambda d: d["category"] == c), lambda d: d["surface"]))
    low = F.coalesce(t, F.lit(""))
    pays = X.payments(low, low)
    plain = F.array_sort(F.array_distinct(F.concat(X.every(low, X.ACCOUNT, 1), F.when(low.rlike(r"\b(?:ifsc|bank|transfer)\b"), X.every(low, X.IFSC)).otherwise(F.array().cast("array<string>")))))
    same(rows, F.array_distinct(of(pays, "bankDetails")), plain)
    coins = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit("|".join((X.BTC, X.BECH32, X.ETH, X.TRON))), F.lit(0))))
    same(rows, of(pays, "cryptoAddress"), coins)
    handles = F.array_sort(F.array_distinct(F.filter(F.concat(*[X.every(low, p, 1) for p in (X.AT_HANDLE, X.FRAMED, X.AFTER_PLATFORM, X.NEAR_PLATFORM, X.INTRODUCED)]), lambda s: ~s.rlike(X.NOT_HANDLES))))
    same(rows, F.array_distinct(of(X.handles(low), "socialHandle")), handles)
    assert rows.filter(F.size(handles) > 0).count() >= 5
    words = X.signals(t, N.tokens(t), N.compact(t))
    same(rows, words["digits_embedded"], F.regexp_count(t, F.lit(r"\p{L}\p{N}+\p{L}")))
    same(rows, words["digit_count"], F.regexp_count(t, F.lit(r"\p{N}")))
    same(rows, words["at_count"], F.regexp_count(t, F.lit("@")))


def test_only_texts_with_four_digits_are_masked_for_phones(rows):
    found = lambda text: X.phones_of(F.array(F.struct(text.alias("text"), F.lit(1.0).alias("weight"), F.lit(0).alias("effort"))))
    same(rows, found(X.maskable(F.col("t"))), found(N.masked_numbers(F.col("t"))))
    kept = {r.t for r in rows.filter(X.maskable(F.col("t")).isNotNull()).collect()}
    assert "ring 98765 43210 now" in kept and "10:30 am and 5 km" not in kept and "" not in kept
