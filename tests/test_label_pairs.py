import pytest

from quillon.operators import ontology


@pytest.mark.parametrize("ranges", [1, 3, 256])
def test_pairs_are_judged_without_carrying_lists(spark, monkeypatch, ranges):
    monkeypatch.setattr(ontology, "LABEL_RANGES", ranges)
    up = {c: {(c - 1) // 3, *({(c - 1) // 4} if c % 4 == 0 else ())} for c in range(1, 60)}
    above: dict[int, set] = {0: set()}
    for c in sorted(up):
        above[c] = set(up[c]).union(*(above[p] for p in up[c]))
    edges = spark.createDataFrame([(c, p) for c, ps in up.items() for p in ps], "child long, parent long")
    nodes = spark.range(61).withColumnRenamed("id", "term_id")
    labels = ontology.reach_labels(nodes, edges)
    assert labels.where("size(more) > 0").count() > 0
    rows = [(a, b) for a in range(60) for b in range(60)] + [(0, 59), (None, 3), (3, None), (99, 1), (60, 60)]
    found = ontology.label_pairs(spark.createDataFrame(rows, "a long, b long"), labels)
    got = sorted((r["a"], r["b"]) for r in found.collect())
    assert got == sorted((a, b) for a, b in rows if b in above and a in above[b])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "exists(" not in plan and "struct(pre" not in plan
