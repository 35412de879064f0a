from loomline.llm.shingles import batches


def test_python_gets_few_whole_texts_at_a_time(spark):
    import corpus_pipeline as c

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        docs = spark.createDataFrame([(i, f"text {i} here") for i in range(9)], "doc_id long, text string")
        spark.conf.set(name, "10000")
        assert c.packing(spark, docs, "").count() == 9 and int(spark.conf.get(name)) <= 2000
        spark.conf.set(name, "70")  # what asks for less stays
        assert c.packing(spark, docs, "").count() == 9 and spark.conf.get(name) == "70"
    finally:
        spark.conf.set(name, before)
    assert max(j - i for i, j in batches(["x" * 1000] * 2000)) * 1000 <= 300_000
