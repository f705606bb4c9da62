"""Genes of a term and all below it, counted by sets and by gene."""

import random

import pytest

from quillon.operators import ic, ontology


@pytest.mark.parametrize("most", [0, 6, 1 << 12])
def test_counts_equal_the_rows(spark, monkeypatch, most):
    monkeypatch.setattr(ic, "SET_GENES", most)
    rng = random.Random(5)
    edges = [(k, p) for k in range(3, 60) for p in {(k - 3) // 3, (k - 3) // 4}]
    rows = [(rng.choice([None, *range(12)]), rng.choice((59, 2, rng.randrange(62)))) for _ in range(150)] + [(1, None)]
    rows = [r for r in rows if r[1] != 61]
    above = {k: {k} for k in range(62)}
    for k, p in edges:
        above[k] |= above[p]
    want = {}
    for gene, term in rows:
        for t in above.get(term, ()):
            want.setdefault(t, set()).add(gene)
    annotations = spark.createDataFrame(rows, "gene long, term_id long")
    pairs = ontology.closure(spark.createDataFrame(edges, "child long, parent long"))
    monkeypatch.setattr(ic, "propagate_annotations", None)  # no (term, gene) rows are made
    assert sorted(map(tuple, ic.propagated_counts(annotations, pairs).collect())) == sorted((t, len(g)) for t, g in want.items())
    nodes = spark.createDataFrame([(k,) for k in range(62)], "term_id long")
    got = {r[0]: r[1] for r in ic.annotation_counts(nodes, pairs, annotations, bitmaps=False).collect()}
    assert got == {k: len(want.get(k, set()) - {None}) for k in range(62)}
