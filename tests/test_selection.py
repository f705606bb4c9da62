"""Choice of representative terms against the plain greedy rules, in one round and in many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import ic, ontology


def graph(seed):
    rng = random.Random(seed)
    nodes = [(i, f"ns{i % 2}" if i > 2 else "ns0") for i in range(90)]
    edges = sorted({(i, rng.randrange(max(0, i // 4 - 2), max(1, i // 2))) for i in range(3, 90) for _ in range(rng.choice((1, 1, 2)))})
    return nodes, edges


def below(nodes, edges):
    """Leaves below each term in its own namespace, and the leaves of each namespace."""
    kids, space = {}, dict(nodes)
    for c, p in edges:
        kids.setdefault(p, set()).add(c)

    def down(x):
        return {z for y in kids.get(x, ()) for z in {y} | down(y)}

    ends = {x for x in space if x not in kids}
    return {x: {y for y in down(x) & ends if space[y] == space[x]} for x in space}, ends


def greedy(candidates, value, under, ends, total, most, enough, static):
    chosen, covered, left = [], set(), sorted(candidates)
    order = sorted(left, key=lambda x: (-value(x, len(under[x])), x))
    while left and len(chosen) < most and len(covered) / max(1, total) < enough:
        if static:
            if not order:
                break
            x = order.pop(0)
            if not under[x] - covered and x not in ends:
                continue
        else:
            x = min(left, key=lambda x: (-value(x, len(under[x] - covered)), x))
            if value(x, len(under[x] - covered)) <= 0:
                break
            left.remove(x)
        chosen.append(x)
        covered |= under[x] | ({x} & ends)
    return chosen


@pytest.mark.parametrize("size", [4, 1024])
def test_choices_equal_the_greedy_rules(spark, monkeypatch, size):
    monkeypatch.setattr(ic, "ROUND_CANDIDATES", size)
    nodes, edges = graph(size)
    under, ends = below(nodes, edges)
    n = spark.createDataFrame(nodes, "term_id long, namespace string")
    e = spark.createDataFrame(edges, "child long, parent long")
    c, d = ontology.closure(e), ontology.node_depths(n, e, [0, 1, 2])
    content = ic.ic_structural(n, c)
    depth, worth = dict(map(tuple, d.select("term_id", "depth").collect())), dict(map(tuple, content.collect()))
    kin = dict(map(tuple, ontology.descendant_counts(n, c).collect()))
    for most, enough in ((500, 0.95), (3, 1.0))[: 2 if size == 4 else 1]:
        got = {"ic": ic.select_by_ic(n, e, c, d, content, min_depth=1, min_descendants=1, ic_max=20.0, max_nodes=most, coverage=enough), "static": ic.select_static(n, e, c, d, min_depth=1, min_descendants=1, max_nodes=most, coverage=enough)}
        for how, table in got.items():
            rows = table.collect()
            for space in ("ns0", "ns1"):
                own = [x for x, s in nodes if s == space]
                total = sum(x in ends for x in own)
                fit = [x for x in own if 1 <= depth[x] <= 6 and kin[x] >= 1]
                if how == "ic":
                    want = greedy([x for x in fit if 1 <= worth[x] <= 20], lambda x, k: worth[x] * math.log2(k + 1), under, ends, total, most, enough, False)
                else:
                    want = greedy(fit or own, lambda x, k: k / (1 + 0.05 * abs(depth[x] - 3.5)), under, ends, total, most, enough, True)
                assert [r["term_id"] for r in sorted((r for r in rows if r["namespace"] == space), key=lambda r: r["rank"])] == want
            assert {r["rank"] for r in rows} <= set(range(1, most + 1))
    chosen = got["ic"].select("term_id", "namespace", "rank")
    assert {tuple(r) for r in ic.rep_members(c, chosen).collect()} == {(r["ancestor"], r["descendant"]) for r in c.collect() if r["ancestor"] in {x["term_id"] for x in chosen.collect()}}
    assert ic.compressed_terms(n, chosen).count() == chosen.count()
    top = ic.top_by_ic(chosen, content, 2).collect()
    for space in {r["namespace"] for r in top}:
        want = sorted((r["term_id"] for r in chosen.where(F.col("namespace") == space).collect()), key=lambda x: (-worth[x], x))[:2]
        assert [r["term_id"] for r in sorted((r for r in top if r["namespace"] == space), key=lambda r: r["place"])] == want


def test_nothing_to_choose_from(spark):
    n, e = spark.createDataFrame([], "term_id long, namespace string"), spark.createDataFrame([], "child long, parent long")
    c = spark.createDataFrame([], "ancestor long, descendant long, dist int")
    d = spark.createDataFrame([], "term_id long, depth int")
    assert ic.select_static(n, e, c, d).count() == 0
