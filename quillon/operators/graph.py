"""Neighbourhoods in a typed graph: graph_edges(src, src_type, dst, dst_type, relationship)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import write_shared


def _limited(edges: DataFrame, by: str, n: int) -> DataFrame:
    """At most n edges of each query, in total order."""
    order = Window.partitionBy(by).orderBy("src", "dst", "relationship")
    return edges.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).drop("k")


def _lists(edges: DataFrame, seeds: DataFrame, side: str, n: int) -> DataFrame:
    """(side, all): the first n distinct edges of each seed's node by its ``side``, in order, as one list.

    A hub's edges are cut here, before they meet the queries. Equal ones have one rank, so
    no pass tells them apart before.
    """
    nodes = seeds.select(F.col("term_id").alias(side)).distinct()
    edge = ["src", "dst", "relationship", "src_type", "dst_type"]
    near = edges.join(nodes, side, "left_semi").withColumn("k", F.dense_rank().over(Window.partitionBy(side).orderBy(*edge))).where(F.col("k") <= n)
    return write_shared(near.groupBy(side).agg(F.array_sort(F.collect_set(F.struct(*edge))).alias("all")), "graph-lists")


#: Seeds of a query by which its edges are bounded, the first by term.
BOUND_SEEDS = 64


def _bounds(seeds: DataFrame, lists: DataFrame, side: str, n: int) -> DataFrame:
    """(query_id, bound): a ``src`` up to which a query has at least n edges, or null where some of its seeds have fewer.

    A list's 1st, 2nd, 4th, .. edge stands for those since the one before. In order of
    their ``src`` these add up to n at the bound. Of a list by ``src`` all are alike.
    """
    share, long = F.ceil(F.lit(n) / F.col("n_seeds")), F.size("all")
    if side == "src":
        heads, marks = lists.select(side, long.alias("long")), [F.struct(F.col("src").alias("at"), F.col("long").alias("n"))]
    else:
        places = [(0 if k == 0 else 1 << k - 1, 1 << k) for k in range(n.bit_length())]
        heads = lists.select(side, *[F.get(F.col("all.src"), b - 1).alias(f"at{b}") for _, b in places])
        marks = [F.when((F.lit(a) < share) & F.col(f"at{b}").isNotNull(), F.struct(F.col(f"at{b}").alias("at"), F.lit(b - a).alias("n"))) for a, b in places]
    own = seeds.where(F.col("place") <= BOUND_SEEDS).withColumnRenamed("term_id", side).join(heads, side)
    own = own.select("query_id", F.filter(F.array(*marks), lambda x: x.isNotNull()).alias("marks"))
    sums = own.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("marks"))).alias("marks"))
    step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when(acc["n"] < n, x["at"]).otherwise(acc["at"]).alias("at"))
    end = F.aggregate("marks", F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("at")), step)
    return sums.select("query_id", F.when(end["n"] >= n, end["at"]).alias("bound"))


def _first_edges(edges: DataFrame, seeds: DataFrame, side: str, n: int) -> DataFrame:
    """(query_id, edge), distinct: among them each query's first n edges by ``side`` of ``seeds(query_id, term_id, place, n_seeds)``.

    An edge among a query's first n is among the first n of its seed, as all are in one
    total order. Where the lists hold far more than n a query, edges past a bound that n
    of them keep are left out before they leave their node.
    """
    lists = _lists(edges, seeds, side, n)
    met = seeds.where("place = 1").agg(F.avg("n_seeds")).first()[0] or 0
    kept = F.col("all")
    if met * (lists.agg(F.avg(F.size("all.src"))).first()[0] or 0) > 2 * n:
        seeds = seeds.join(_bounds(seeds, lists, side, n), "query_id", "left")
        kept = F.filter("all", lambda x: F.coalesce(x["src"] <= F.col("bound"), F.lit(True)))
    rows = seeds.withColumnRenamed("term_id", side).join(lists, side).select("query_id", F.explode(kept).alias("x"))
    return rows.select("query_id", *[f"x.{c}" for c in edges.columns])


def _around(seeds: DataFrame, edges: DataFrame, term_limit: int, gene_limit: int, paper_limit: int, trait_limit: int) -> tuple[DataFrame, DataFrame]:
    """The edges among terms around each query's seeds, and those to genes, papers and traits."""
    edges = edges.select("src", "src_type", "dst", "dst_type", "relationship")
    own = Window.partitionBy("query_id")
    s = seeds.select("query_id", "term_id").where("term_id is not null").distinct()
    s = write_shared(s.withColumn("place", F.row_number().over(own.orderBy("term_id"))).withColumn("n_seeds", F.count("*").over(own)), "graph-places")
    terms = edges.where("src_type = 'GO_Term' and dst_type = 'GO_Term'")
    # Only an edge among terms can be met from both its ends.
    near = _first_edges(terms, s, "src", term_limit).unionByName(_first_edges(terms, s, "dst", term_limit)).distinct()
    parts = [
        (edges.where("src_type = 'Gene'"), "dst", gene_limit),
        (edges.where("dst_type = 'PMID'"), "src", paper_limit),
        (edges.where("src_type = 'RTO_Term'"), "dst", trait_limit),
    ]
    genes, papers, traits = (_limited(_first_edges(e, s, side, n), "query_id", n) for e, side, n in parts)
    return _limited(near, "query_id", term_limit), genes.unionByName(papers).unionByName(traits)


def graph_neighbourhood(seeds: DataFrame, edges: DataFrame, *, term_limit: int = 80, gene_limit: int = 30, paper_limit: int = 20, trait_limit: int = 20) -> DataFrame:
    """Edges around each query's terms: ``seeds(query_id, term_id)``."""
    terms, others = _around(seeds, edges, term_limit, gene_limit, paper_limit, trait_limit)
    return terms.unionByName(others).select("query_id", *edges.columns)


def seeds_from_papers(papers: DataFrame, edges: DataFrame, *, limit: int = 20) -> DataFrame:
    """(query_id, term_id): terms that mention the papers of ``papers(query_id, pmid)``, with or without prefix."""
    key = lambda c: F.regexp_replace(c, "^PMID:", "")
    p = papers.select("query_id", key(F.col("pmid")).alias("key")).distinct()
    e = edges.where("dst_type = 'PMID' and src_type = 'GO_Term'").select(F.col("src").alias("term_id"), key(F.col("dst")).alias("key"))
    found = e.join(p, "key").select("query_id", "term_id").distinct()
    order = Window.partitionBy("query_id").orderBy("term_id")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def two_hop_edges(seeds: DataFrame, edges: DataFrame, *, limit: int = 120) -> DataFrame:
    """Term edges between two seeds of a query; only where it has none, those on undirected ways of two steps.

    What decides is found first, by ends alone: a node that two seeds of a query have as
    a neighbour, or that is a seed itself and neighbour of another. Edges meet only those.
    """
    e = edges.where("src_type = 'GO_Term' and dst_type = 'GO_Term' and src <> dst").select("src", "dst", "relationship").distinct()
    both = e.select("src", "dst", "relationship", F.col("src").alias("a"), F.col("dst").alias("m")).unionByName(e.select("src", "dst", "relationship", F.col("dst").alias("a"), F.col("src").alias("m")))
    s = seeds.select("query_id", "term_id").where("term_id is not null").distinct()
    ends = s.withColumnRenamed("term_id", "a").join(both.select("a", "m"), "a").select("query_id", "m", "a")
    ends = ends.unionByName(s.select("query_id", F.col("term_id").alias("m"), F.lit(None).cast("string").alias("a")))
    own = F.max(F.when(F.col("a").isNull(), 1).otherwise(0)) == 1
    middles = ends.groupBy("query_id", "m").agg(own.alias("seed"), (F.min("a") < F.max("a")).alias("several"), F.count("a").alias("n"))
    middles = write_shared(middles.where("n > 0 and (seed or several)").select("query_id", "m", "seed", "several"), "graph-middles")
    near = middles.join(both, "m").join(s.withColumnRenamed("term_id", "a"), ["query_id", "a"], "left_semi")
    through = near.where("several").join(middles.where("seed").select("query_id").distinct(), "query_id", "left_anti")
    found = near.where("seed").unionByName(through).select("query_id", "src", "dst", "relationship").distinct()
    return _limited(found, "query_id", limit)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "relationship"])


def limit_graph(nodes: DataFrame, edges: DataFrame, n_nodes: int = 200, n_edges: int = 400) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, and the first edges with both ends among them."""
    kept = nodes.orderBy("node_id").limit(n_nodes)
    ids = F.broadcast(kept.select("node_id"))  # n_nodes rows
    inside = dedupe_edges(edges).join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, inside.select(*edges.columns).orderBy("src", "dst", "relationship").limit(n_edges)


def question_graph(papers: DataFrame, edges: DataFrame, *, seed_limit: int = 20, **limits) -> DataFrame:
    """The graph around the terms of a question's papers: edges among them, by two steps where there are none, then their genes, papers and traits.

    Edges and seeds are read by each of these steps, so both are made once. ``edges`` may
    repeat. An edge can be found twice only among terms, or if it leads from a gene or
    trait to a paper; others are not told apart again.
    """
    edges = write_shared(edges, "graph-edges")
    seeds = write_shared(seeds_from_papers(papers, edges, limit=seed_limit), "graph-seeds")
    ways = two_hop_edges(seeds, edges).select("query_id", "src", F.lit("GO_Term").alias("src_type"), "dst", F.lit("GO_Term").alias("dst_type"), "relationship")
    sizes = {"term_limit": 80, "gene_limit": 30, "paper_limit": 20, "trait_limit": 20} | limits
    terms, others = (x.select(*ways.columns) for x in _around(seeds, edges, **sizes))
    if not edges.where("dst_type = 'PMID' and src_type in ('Gene', 'RTO_Term')").isEmpty():
        others = others.distinct()
    return ways.unionByName(terms).distinct().unionByName(others)
