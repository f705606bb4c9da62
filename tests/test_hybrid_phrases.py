from quillon.operators import match


def test_hybrid_phrases_of_long_texts(spark):
    words = [f"w{i}" for i in range(200)]
    docs = spark.createDataFrame([(1, "The " + " ".join(words))], "doc_id long, text string")
    got = {r["phrase"] for r in match.hybrid_phrases(docs).collect()}
    windows = {" ".join(words[i : i + n]) for n in range(1, 6) for i in range(201 - n)}
    assert windows <= got and got - windows == {"the " + " ".join(words)}
