import re

import pytest

from riskweave.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


PROSE = "The house is on the hill and it was built by a family that had come from the north with all of their things. " * 1
TEXTS = [None, "", " \t", "one", "a b c d", "a b c d e", "a a a a a a", "a b c d e f a b c d e", "x\n\nx\n x\nx\r", "é# *ñ <p> $%&|", "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7", "日本 語 テ", PROSE, PROSE.upper() * 4, "w%%% " * 120, " ".join(str(i) for i in range(20_000))]


def test_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", i, True) for i, t in enumerate(TEXTS)] + [(None, PROSE, None, 1, False), (3, "one", "en", 1, True)], "doc_id long, text string, lang string, n_words int, kept boolean")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    for i, text in enumerate(TEXTS[:-1]):
        n = brute(text)
        assert tuple(got[i])[1:6] == n, text
        assert got[i].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not got[i].kept or not got[i].base_failed
    assert got[len(TEXTS) - 1].n_repeat_words == 0 and len(Q.quality(docs).collect()) == len(TEXTS) + 2
    assert got[None].n_words == 22 or got[None].n_words > 0


def test_divergence_rejects_odd_documents_and_keeps_prose(spark):
    plain = [(i, " ".join(f"{a} of the {b} and to {a}{b} in that {i} house" for a, b in [("tree", "river"), ("stone", "field"), ("cloud", "lamp")]) + f" with {i} more words from here. " + " ".join(f"the w{i}x{j} of" for j in range(40)), "en") for i in range(30)]
    shout = (100, " ".join(f"WORD{j} SHOUTS!!" for j in range(80)), "en")
    lists = (101, " ".join(f"term{j}q" for j in range(150)), "en")
    docs = spark.createDataFrame([*plain, shout, lists], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert all(got[i].kept for i in range(30))
    assert not got[100].kept and not got[101].kept and not got[100].base_failed
    assert {r.doc_id for r in Q.good_documents(docs).collect()} == set(range(30))
    assert Q.good_documents(docs).columns == docs.columns


@pytest.mark.parametrize("rows", [[], [(1, PROSE, "xx")]])
def test_without_references(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.kept for r in Q.quality(docs).collect()] == [True] * len(rows)
