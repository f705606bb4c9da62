"""Many queries among few items, and places that meet in bins, carry no more than they need."""

import numpy as np

from quillon.operators import match, vectors


def test_few_items_are_held_and_no_query_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(vectors, "write_shared", None)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.RandomState(5)
    x, q = rng.randint(-3, 4, (9, 4)).astype(float), rng.randint(-3, 4, (50, 4)).astype(float)
    items = spark.createDataFrame([*((f"n{i}", v.tolist()) for i, v in enumerate(x)), ("n99", None)], "node_id string, embedding array<float>")
    queries = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(q)), (100, None), (101, [])], "query_id long, embedding array<float>")
    near = {"topk_cosine": lambda v: -(x @ v), "topk_l2": lambda v: ((x - v) ** 2).sum(1)}
    for name, distance in near.items():
        for k in (1, 20):
            want = {(i, n, f"n{j}") for i in range(50) for n, j in enumerate(np.argsort(distance(q[i]), kind="stable")[:k], 1)}
            assert {(r["query_id"], r["rank"], r["node_id"]) for r in getattr(vectors, name)(queries, items, k).collect()} == want


def test_bins_hold_places_without_text(spark):
    spans = spark.createDataFrame([(1, "long", 0, 900), (1, "none", 900, 910), (1, "empty", 5, 5), (2, "other", 0, 3)], "doc_id long, sentence string, start int, end int")
    hits = spark.createDataFrame([(1, 100, 700), (1, 890, 900)], "doc_id long, start int, end int")
    out = match.overlaps(spans, hits)
    assert {(r["sentence"], r["covered"]) for r in out.collect()} == {("long", 610), ("none", 0), ("empty", 0), ("other", 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("sentence" in line for line in plan.split("\n") if "Aggregate" in line)
