"""Benchmark items of null and repeated ids; inner column names that a caller's table has too."""

from pyspark.sql import functions as F

from quillon.llm import decontaminate, mixing, ngram_join

A = "the quick brown fox jumps over the lazy dog near the old river bank"
B = "every good student reads several long books about history during the summer months"


def test_null_and_repeated_item_ids(spark):
    docs = spark.createDataFrame([(1, f"start {A} end"), (2, f"start {B} end"), (3, "nothing of either stands in this text at all my friend")], "doc_id long, text string")
    items = spark.createDataFrame([(None, A), (7, A), (7, B), (7, B), (8, None), (None, "")], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.contaminated_pairs(docs, items).select("doc_id", F.coalesce("item_id", F.lit(-1)), "matched", "item_windows", "kind").collect()))
    n, m = len(A.split()) - 7, len(B.split()) - 7
    assert got == [(1, -1, n, n, "exact"), (1, 7, n, n, "exact"), (2, 7, m, m, "exact")]
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items.where("item_id is null")).orderBy("doc_id").collect()] == [2, 3]


def test_inner_names_of_the_callers_table(spark):
    inner = ("own", "key", "source", "row", "size", "taken", "copy", "hash", "id", "twice")
    rows = [(i, f"{A} {i} {B}" if i % 2 else A, "a") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in inner:
        docs = docs.withColumn(f"__{c}", F.lit(c))
    bench = spark.createDataFrame([(1, B)], "item_id long, text string")
    for made in (mixing.mix(docs), ngram_join.keep_one(docs), decontaminate.decontaminate(docs, bench)):
        assert made.columns == docs.columns
        out = made.collect()
        assert out and all(r[f"__{c}"] == c for r in out for c in inner)
