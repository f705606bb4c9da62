"""Repeated ids, tables without rows, infinite values, clashing columns and sums beyond 64 bits of the top-k search."""

import math
import random

import pytest

from quillon.llm import topk_search

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k=5):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (own, q) in enumerate(use):
        if own % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for j, (i, v) in enumerate(use) if j != at and len(v) == len(q)))[:k]
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_repeated_ids_and_rows(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(60), [rng.choice((-0.5, 0.25, 1.0)) for _ in range(3)]) for _ in range(300)]
    rows += rows[:40] + [(50, [1.0, 1.0, 1.0])] * 9 + [(0, [math.inf, 0.0, 0.0]), (100, []), (None, [1.0, 1.0, 1.0]), (150, [1.0, 2.0])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", score int, dim string").repartition(3)
    assert sorted(map(tuple, topk_search.top_k(docs).collect())) == brute(rows)


def test_no_rows(spark):
    assert topk_search.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_components_are_exact_or_refused(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) * 2**21 for _ in range(4)]) for i in range(60)]
    assert sorted(map(tuple, topk_search.top_k(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [2.0**40]), (1, [2.0**40])], SCHEMA)).collect()
