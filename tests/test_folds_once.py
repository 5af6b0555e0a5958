import __spark_entry__ as entry


def test_safety_findings_folds_a_text_once(spark, tmp_path):
    spark.createDataFrame([(1, "you are vermin", "en", "web", 14)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["safety_findings"](spark, str(tmp_path))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("(?s)(.)\\1{2,}") == 1
    assert rows.count() >= 1
