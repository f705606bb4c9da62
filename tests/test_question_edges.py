"""The steps of a question's graph read edges and seeds that were made once."""

from quillon.operators import graph


def test_edges_are_made_once(spark, tmp_path):
    rows = [("1", "GO_Term", "p1", "PMID", "literature"), ("2", "GO_Term", "p1", "PMID", "literature"), ("2", "GO_Term", "1", "GO_Term", "is_a"), ("g", "Gene", "2", "GO_Term", "mention")]
    spark.createDataFrame(rows, "src string, src_type string, dst string, dst_type string, relationship string").write.parquet(str(tmp_path / "source"))
    papers = spark.createDataFrame([(7, "PMID:p1")], "query_id int, pmid string")
    out = graph.question_graph(papers, spark.read.parquet(str(tmp_path / "source")).distinct())
    assert out.inputFiles() and all("/graph-" in f for f in out.inputFiles())
    assert sorted(map(tuple, out.collect())) == sorted((7, *r) for r in rows)
