from lettermill.llm import decontaminate, packing


def test_stages_and_run(spark, tmp_path):
    import corpus_pipeline

    words = [f"word{k}x" for k in range(400)]
    text = lambda k, n=60: " ".join(words[(k * 37 + i * (k % 11 + 1)) % 400] for i in range(n))
    rows = [(0, text(1), "en", "a", 1), (1, text(1), "en", "a", 1), (2, None, None, None, None), (3, "12 34", "en", "b", 5), (4, text(5) + " password=abcdef99", "en", "b", 1), (5, text(8), "en", "a", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text(8, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = d, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == d.columns
        at = spark.createDataFrame(at.collect(), d.schema)
        kept.append(sorted(r.doc_id for r in at.collect()))
    assert kept == [[0, 1, 4, 5], [0, 4, 5], [0, 4], [0, 4]]
    assert "[SECRET]" in at.filter("doc_id = 4").first().text
    assert decontaminate.overlaps(spark, at, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 4}
    assert packing.pack(spark, at).count() > 0
