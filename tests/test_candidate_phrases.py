from quillon.operators import match


def test_phrases_are_ranked_without_a_shuffle_of_windows(spark):
    docs = spark.createDataFrame([(1, "The red kinase of the cell, process"), (2, "of the"), (3, None), (4, "kinase")], "doc_id long, text string")
    found = match.candidate_phrases(docs, max_ngram=3, limit=4)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in found.orderBy("doc_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 1] == ["cell process", "red kinase", "kinase", "cell"] and got[-1] == (4, 1, "kinase")


def test_texts_of_one_id_are_ranked_together(spark):
    docs = spark.createDataFrame([(1, "red kinase"), (1, "blue kinase repair"), (2, "red kinase")], "doc_id long, text string")
    got = [tuple(r) for r in match.candidate_phrases(docs, max_ngram=2, limit=3).orderBy("doc_id", "rank").collect()]
    assert got == [(1, 1, "kinase repair"), (1, 2, "blue kinase"), (1, 3, "red kinase"), (2, 1, "red kinase"), (2, 2, "kinase"), (2, 3, "red")]
