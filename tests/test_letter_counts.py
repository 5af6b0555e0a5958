"""Counting letter pairs without a row for each pair, and readings without their digits."""

from pyspark.sql import functions as F

from riskweave.operators import letters as LT


def test_pairs_are_counted_by_batch_and_digits_only_where_asked(spark):
    rows = spark.createDataFrame([("the house-boat é1 aa",), (None,), ("",), ("x",), ("uifsf jt b ipvtf po uif ijmm",)], "t string")
    found = rows.select(F.explode(LT.pairs_of(F.col("t"))).alias("p")).groupBy("p").count().collect()
    counts = [[{r.p: r["count"] for r in found}.get(a + b, 0) for b in LT.LETTERS] for a in LT.LETTERS]
    model = LT.fit(rows, "t")
    assert model.pairs == tuple(tuple(LT.scores(LT.np.array(row)).tolist()) for row in counts)
    with_digits, without = (rows.select(LT.unshifted(F.col("t"), model, digits=d).alias("r")).collect() for d in (True, False))
    assert all(a.r[:5] == b.r[:5] and b.r.digits is None for a, b in zip(with_digits, without, strict=True))
