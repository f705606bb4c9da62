from quillon.llm import decontaminate


def test_every_alignment_is_tried(spark):
    item = "a farmer buys {} sacks of grain and then sells {} of them at the old market before noon"
    twice = lambda *own: " ".join(f"{item.format(a, b)}." for a, b in own)
    docs = spark.createDataFrame([(1, twice((4, 4), (3, 5))), (2, twice((4, 4), (8, 9))), (3, twice((4, 4), (7, 7))), (4, twice((8, 9), (3, 5)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item.format(3, 5))], "item_id long, text string")
    rows = decontaminate.contaminated_pairs(docs, bench).collect()
    assert {r["doc_id"]: r["kind"] for r in rows} == {1: "exact", 2: "reparameterised", 4: "exact"} and len(rows) == 3
    assert [r[0] for r in decontaminate.decontaminate(docs, bench).select("doc_id").collect()] == [3]
