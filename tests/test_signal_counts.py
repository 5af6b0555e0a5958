"""signal_counts on texts that the driver's tables do not hold, against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TEXTS = [
    "", None, " ", "call me 5", "PİNG ME", "émail", "mailé", "inbox٣", "İmail", "e-mail", "my_mail", "1inbox", "GMAIL.", "٣٤ ½ Ⅷ @@",
    "5" * 41 + "x" * 599, "5" * 201 + "x" * 2999, "5" * 83 + "x" * 557, "no digits",
]


def both(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in entry.queries()["signal_counts"](spark, str(folder)).collect()]
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return sorted(map(repr, got)), sorted(map(repr, duck.sql(entry.oracle_sql()["signal_counts"]).fetchall()))


@pytest.mark.parametrize("rows", [[(1, "")], [(1, None), (None, "a@1")], [], list(enumerate(TEXTS))], ids=["empty", "null", "no rows", "odd"])
def test_odd_texts_equal_sql(spark, tmp_path, rows):
    got, wanted = both(spark, tmp_path, rows)
    assert got == wanted and len(got) == len(rows)


def test_counts_make_no_string_for_each_match(spark, tmp_path):
    spark.createDataFrame([(1, "5" * 200_000 + "@" * 300_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["signal_counts"](spark, str(tmp_path))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [tuple(r)[1:5] for r in out.collect()] == [(300_000, 200_000, 500_000, 0.4)]
