"""Edges past a query's bound stay at their node; what is found is what all edges give."""

import random

from pyspark.sql import functions as F

from quillon.operators import graph

COLUMNS = "src string, src_type string, dst string, dst_type string, relationship string"


def _edges(rng: random.Random) -> list[tuple]:
    rows = [(f"g{rng.randrange(400)}", "Gene", f"t{rng.randrange(30)}", "GO_Term", "mention") for _ in range(1500)]
    rows += [(f"t{rng.randrange(30)}", "GO_Term", f"p{rng.randrange(50)}", "PMID", rng.choice("ab")) for _ in range(900)]
    rows += [(f"t{rng.randrange(30)}", "GO_Term", f"t{rng.randrange(30)}", "GO_Term", "is_a") for _ in range(60)]
    rows += [(f"r{rng.randrange(9)}", "RTO_Term", f"t{rng.randrange(30)}", "GO_Term", "trait") for _ in range(40)]
    rows += [(f"t{rng.randrange(30)}", "Gene", f"t{rng.randrange(30)}", "PMID", "odd") for _ in range(40)]
    return rows + rows[::3]


def _first(rows: set, n: int) -> list[tuple]:
    return sorted(rows, key=lambda r: (r[0], r[2], r[4], r[1], r[3]))[:n]


def _want(terms: set, rows: list[tuple]) -> set:
    parts = [({r for r in rows if r[1] == r[3] == "GO_Term" and (r[0] in terms or r[2] in terms)}, 80), ({r for r in rows if r[1] == "Gene" and r[2] in terms}, 30), ({r for r in rows if r[3] == "PMID" and r[0] in terms}, 20), ({r for r in rows if r[1] == "RTO_Term" and r[2] in terms}, 20)]
    return {r for part, n in parts for r in _first(part, n)}


def test_bounded_edges_are_the_first(spark):
    rng = random.Random(8)
    rows, queries = _edges(rng), {q: {f"t{rng.randrange(32)}" for _ in range(rng.choice((1, 3, 20, 60)))} for q in range(25)}
    edges = spark.createDataFrame(rows, COLUMNS)
    seeds = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id int, term_id string")
    got = {}
    for r in graph.graph_neighbourhood(seeds, edges).collect():
        got.setdefault(r[0], set()).add(tuple(r)[1:])
    assert got == {q: w for q, ts in queries.items() if (w := _want(ts, rows))}
    numbered = seeds.withColumn("place", F.expr("row_number() over (partition by query_id order by term_id)")).withColumn("n_seeds", F.expr("count(*) over (partition by query_id)"))
    for kind, side, n, of in (("src_type = 'Gene'", "dst", 30, lambda r: r[1] == "Gene" and r[2]), ("dst_type = 'PMID'", "src", 20, lambda r: r[3] == "PMID" and r[0])):
        left = graph._first_edges(edges.where(kind), numbered, side, n).collect()
        every = sum(min(n, len({r for r in rows if of(r) == t})) for ts in queries.values() for t in ts)
        assert len(left) < every / 3


def test_a_question_finds_an_edge_once(spark):
    rng = random.Random(9)
    rows = _edges(rng)
    papers = spark.createDataFrame([(q, f"PMID:p{rng.randrange(50)}") for q in range(9) for _ in range(2)], "query_id int, pmid string")
    out = list(map(tuple, graph.question_graph(papers, spark.createDataFrame(rows, COLUMNS)).collect()))
    assert len(out) == len(set(out)) > 0
    seeds = {}
    for q, t in graph.seeds_from_papers(papers, spark.createDataFrame(rows, COLUMNS)).collect():
        seeds.setdefault(q, set()).add(t)
    for q, terms in seeds.items():
        own = {r for r in rows if r[1] == r[3] == "GO_Term" and r[0] != r[2]}
        direct = {r for r in own if r[0] in terms and r[2] in terms}
        near = lambda m: {x for r in own for x in (r[0], r[2]) if m in (r[0], r[2]) and x != m and x in terms}  # noqa: B023, E731
        through = {r for r in own for a, m in ((r[0], r[2]), (r[2], r[0])) if a in terms and len(near(m)) > 1}
        assert {r[1:] for r in out if r[0] == q} == _want(terms, rows) | set(_first(direct or through, 120))
