"""Similarities to anchors where the texts stand, against the joins."""

from pyspark.sql import functions as F

from riskweave.operators import retrieve as R

ANCHORS = [(1, "pay me outside the app"), (2, "call me on my phone now"), (3, "the room was clean"), (4, "pay me pay me"), (6, "où est la plage")]
TEXTS = [(10, "Pay me, outside the app!"), (11, "the room"), (12, "la plage où"), (13, None), (14, ""), (15, "zzz"), (16, "pay me " * 50), (17, "the phone"), (17, "on my room"), (None, "clean me")]


def test_texts_are_compared_in_place_and_only_texts_are_shuffled(spark):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    anchors = spark.createDataFrame(ANCHORS, "item_id long, text string")
    labels = anchors.select(F.col("item_id").alias("anchor"), (F.col("item_id") % 3 != 0).alias("positive"))
    for grams in (False, True):
        got = R.best_margins(texts, anchors, labels, "doc_id", "text", "item_id", "text", grams)
        want = R.best_margins(texts, anchors, labels, "doc_id", "text", "item_id", "text", grams, most=3)  # by joins
        rows = lambda df: sorted((str(r.id), str(r.nearest), *(round(r[c], 9) for c in ("similarity", "negative", "margin"))) for r in df.collect())
        assert rows(got) == rows(want) and len(rows(got)) >= 6
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Aggregate" not in plan and "Join" not in plan
