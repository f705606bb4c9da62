from pyspark.sql import functions as F

from quillon.functions.vectorised import hash_embed
from quillon.operators import vectors
from quillon.sources.ontology import NODE_COLUMNS


def test_each_node_is_embedded_in_its_row(spark):
    columns = ", ".join(f"{c} string" for c in NODE_COLUMNS)
    node = lambda kind, id_, name: (kind, id_, name, *[None] * (len(NODE_COLUMNS) - 3))
    nodes = spark.createDataFrame([node("Gene", "Gene:1", "kinase"), node("PMID", "1", "repair"), node("PMID", "1", "other repair")], columns)
    index = vectors.build_node_index(nodes, lambda df, k, t: hash_embed(df, k, t))
    assert index.columns == [*NODE_COLUMNS, "text", "embedding"]
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    alone = {r["text"]: r["embedding"] for r in hash_embed(index, "text", "text").collect()}
    got = index.select("name", "text", "embedding").collect()
    assert sorted(r["name"] for r in got) == ["kinase", "other repair", "repair"]  # one row each, of one id too
    assert all(r["embedding"] == alone[r["text"]] for r in got)
    assert index.where(F.size("embedding") != 256).isEmpty()
