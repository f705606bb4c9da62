def test_candidate_phrases_are_those_of_the_documents(spark):
    from quillon.plans.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    ids = {r[0] for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 100").select("doc_id").collect()}
    assert {r[0] for r in QUERIES["text_candidate_phrases"](spark, sf).select("doc_id").distinct().collect()} >= ids
