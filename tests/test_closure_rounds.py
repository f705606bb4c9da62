"""Rounds of the closure, and depths taken from it."""

import random

import pytest

from quillon.operators import ontology


@pytest.mark.parametrize(("depth", "tables"), [(1, 2), (2, 3), (3, 3), (5, 4), (8, 5)])
def test_no_round_follows_the_longest_way(spark, monkeypatch, depth, tables):
    written, write = [], ontology.write_shared
    monkeypatch.setattr(ontology, "write_shared", lambda df, label: written.append(label) or write(df, label))
    edges = spark.createDataFrame([(i + 1, i) for i in range(depth)] + [(1, 1)], "child long, parent long")
    rows = sorted(map(tuple, ontology.closure(edges).collect()))
    assert rows == [(a, b, b - a) for a in range(depth + 1) for b in range(a + 1, depth + 1)]
    assert len(written) == tables


@pytest.mark.parametrize("cycle", [False, True])
def test_pairs_and_depths_equal_a_search_from_each_node(spark, cycle):
    rng = random.Random(cycle)
    edges = {(i, rng.randrange(max(0, i - 6), i)) for i in range(3, 40) for _ in range(2)} | ({(5, 17), (0, 8), (9, 9)} if cycle else set())
    nodes = spark.createDataFrame([(i,) for i in range(45) if i != 2], "term_id long")
    e = spark.createDataFrame(sorted(edges), "child long, parent long")
    want = {}
    for a in range(40):
        level, seen, d = {a}, {a}, 0
        while level:
            level, d = {c for c, p in edges if p in level} - seen, d + 1
            seen |= level
            want |= {(a, c): d for c in level}
    pairs = ontology.closure(e)
    rows = pairs.collect()
    assert {(r["ancestor"], r["descendant"]): r["dist"] for r in rows} == want and len(rows) == len(want)
    depths = sorted(map(tuple, ontology.depths_below(nodes, pairs, [0, 1, 2]).collect()))
    assert depths == sorted(map(tuple, ontology.node_depths(nodes, e, [0, 1, 2]).collect()))
