"""A node table beyond its bound is met by a shuffled join, however small its file makes it look."""

from quillon.operators import ontology
from quillon.plans import shared


def test_many_nodes_are_not_broadcast(spark, monkeypatch, tmp_path):
    spark.range(300).withColumnRenamed("id", "term_id").write.parquet(str(tmp_path / "nodes"))
    nodes = spark.read.parquet(str(tmp_path / "nodes"))
    edges = spark.createDataFrame([(k, (k - 3) // 3) for k in range(3, 400)] + [(k, (k - 3) // 4) for k in range(4, 400, 4)], "child long, parent long").distinct()
    plans, real = [], ontology.write_shared
    monkeypatch.setattr(ontology, "write_shared", lambda df, label: (plans.append((label, df._jdf.queryExecution().executedPlan().toString())), real(df, label))[1])
    few = ontology.reach_labels(nodes, edges)
    assert "BroadcastHashJoin" in dict(plans)["edges"]
    plans.clear()
    monkeypatch.setattr(shared, "BROADCAST_KEYS", 16)
    many = ontology.reach_labels(nodes, edges)
    assert "BroadcastHashJoin" not in dict(plans)["edges"] and dict(plans)["edges"].count("SortMergeJoin") == 2
    inside = ontology.edges_inside(edges, nodes, "child", "parent").distinct()
    known = ontology.reach_labels(nodes, inside, ontology.closure(inside))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == sorted(map(tuple, known.collect()))
    depths = [sorted(map(tuple, x.collect())) for x in (ontology.node_depths(nodes, inside, [0, 1, 2]), ontology.depths_below(nodes, ontology.closure(inside), [0, 1, 2]))]
    assert depths[0] == depths[1]
