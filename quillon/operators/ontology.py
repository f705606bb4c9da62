"""The ontology's graph as tables: edges(child, parent), closure(ancestor, descendant, dist)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import shared
from ..plans.shared import broadcast_if, write_shared


def closure(edges: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs with the least distance, in rounds that double the ways.

    Once all pairs up to a distance d are known, a pair of up to 2 d is one of exactly
    d followed by a known one, and the least sum is its distance. So a graph of depth h
    takes log2(h) rounds, however deep, and each of them reads a table a round. What was
    known goes into the same aggregation and wins there, so it is not joined again. A
    round without a pair of exactly 2 d is the last, as a longer way would begin with one.
    Pairs of a node with itself are dropped, so cycles end too.
    """
    known = write_shared(edges.where("child <> parent").select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("dist")).distinct(), "closure")
    reach = 1
    while True:
        first = known.where(F.col("dist") == reach).select("ancestor", F.col("descendant").alias("middle"))
        rest = known.select(F.col("ancestor").alias("middle"), "descendant", (F.col("dist") + reach).alias("dist"))
        more = first.join(rest, "middle").where("ancestor <> descendant").select("ancestor", "descendant", "dist")
        step = more.unionByName(known).groupBy("ancestor", "descendant").agg(F.min("dist").alias("dist")).where(F.col("dist") > reach)
        step = write_shared(step, "closure")
        known, reach = known.unionByName(step), 2 * reach
        if step.where(F.col("dist") == reach).isEmpty():
            return known


def depths_below(nodes: DataFrame, pairs: DataFrame, roots: list) -> DataFrame:
    """As ``node_depths``, of a closure that is known anyway: one pass over its pairs and no round a level."""
    top = nodes.where(F.col("term_id").isin(roots)).select("term_id")
    down = pairs.where(F.col("ancestor").isin(roots)).join(F.broadcast(top.withColumnRenamed("term_id", "ancestor")), "ancestor", "left_semi")  # the roots
    found = down.groupBy(F.col("descendant").alias("term_id")).agg(F.min("dist").alias("depth"))
    depth = F.when(F.col("term_id").isin(roots), 0).otherwise(F.coalesce("depth", F.lit(0)))
    return nodes.select("term_id").join(found, "term_id", "left").select("term_id", depth.alias("depth"))


#: Rounds after which what was found so far is written as one table.
JOINED_ROUNDS = 16


def node_depths(nodes: DataFrame, edges: DataFrame, roots: list) -> DataFrame:
    """(term_id, depth): shortest way down from any root; 0 where there is none. One round a level."""
    level = write_shared(nodes.where(F.col("term_id").isin(roots)).select("term_id"), "depths")
    found, depth = level.withColumn("depth", F.lit(0)), 0
    while True:
        depth += 1
        below = edges.join(level, edges["parent"] == level["term_id"]).select(F.col("child").alias("term_id")).distinct()
        level = write_shared(below.join(found, "term_id", "left_anti"), "depths")
        if level.isEmpty():
            break
        found = found.unionByName(level.withColumn("depth", F.lit(depth)))
        if depth % JOINED_ROUNDS == 0:
            found = write_shared(found, "depths")
    return nodes.select("term_id").join(found, "term_id", "left").select("term_id", F.coalesce("depth", F.lit(0)).alias("depth"))


#: Siblings that are numbered in one task.
SIBLINGS = 1 << 14


def edges_inside(edges: DataFrame, nodes: DataFrame, *ends: str) -> DataFrame:
    """Edges whose ``ends`` are among the nodes, which are broadcast only if they are few."""
    n = broadcast_if(nodes.select("term_id"), shared.BROADCAST_KEYS)
    for end in ends:
        edges = edges.join(n.withColumnRenamed("term_id", end), end, "left_semi")
    return edges


def reach_labels(nodes: DataFrame, edges: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(term_id, pre, last, more): numbers by which two terms tell whether one is above the other; see ``above``.

    Each term keeps one parent, which makes a forest. ``pre`` numbers it from the roots
    down, a term before all below it, and ``last`` is the highest number below a term: it
    is 1 more than its earlier siblings' trees hold, added up from the root. What a term
    reaches by the other edges are whole subtrees of the forest; those outside its own
    are listed in ``more``, without those inside another of the list. Siblings are summed
    in groups by a hash and then over the groups, so no parent's children meet in one
    task. Edges with a cycle raise an error. ``reach`` is the closure of the edges, all
    of which are then among the nodes, where it is known anyway.
    """
    n = nodes.select("term_id").distinct()
    e = edges.where("child <> parent").select("child", "parent").distinct()
    e = write_shared(edges_inside(e, nodes, "child", "parent"), "edges")
    tree = e.groupBy("child").agg(F.min("parent").alias("parent"))
    down, reach = closure(tree), closure(e) if reach is None else reach
    # Every cycle has an edge whose child is above its parent.
    if not e.join(reach.select(F.col("descendant").alias("parent"), F.col("ancestor").alias("child")), ["child", "parent"], "left_semi").isEmpty():
        raise ValueError("the edges have a cycle")
    size = down.groupBy(F.col("ancestor").alias("term_id")).agg((F.count("*") + 1).alias("size"))
    groups = n.count() // SIBLINGS + 1
    t = n.join(size, "term_id", "left").join(tree.withColumnRenamed("child", "term_id"), "term_id", "left")
    t = t.select("term_id", "parent", F.coalesce("size", F.lit(1)).alias("size"), F.pmod(F.xxhash64("term_id"), F.lit(groups)).alias("g"))
    earlier = lambda *by: F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("term_id" if "g" in by else "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = t.groupBy("parent", "g").agg(F.sum("size").alias("size"))
    sums = sums.select(F.col("parent").alias("p"), F.col("g").alias("pg"), earlier("parent").alias("base"))
    t = t.withColumn("inside", earlier("parent", "g")).join(sums, F.col("parent").eqNullSafe(F.col("p")) & (F.col("g") == F.col("pg")))
    t = write_shared(t.select("term_id", "size", (F.col("base") + F.col("inside") + 1).alias("own")), "labels")
    above = down.join(t.select(F.col("term_id").alias("ancestor"), F.col("own").alias("up")), "ancestor").groupBy(F.col("descendant").alias("term_id")).agg(F.sum("up").alias("up"))
    pre = F.col("own") + F.coalesce("up", F.lit(0))
    label = write_shared(t.join(above, "term_id", "left").select("term_id", pre.alias("pre"), (pre + F.col("size") - 1).alias("last")), "labels")
    other = e.join(tree, ["child", "parent"], "left_anti").withColumnRenamed("parent", "term_id")
    from_above = other.join(reach.select(F.col("descendant").alias("term_id"), "ancestor"), "term_id").select(F.col("ancestor").alias("term_id"), "child")
    far = other.unionByName(from_above).distinct().join(label.select(F.col("term_id").alias("child"), F.col("pre").alias("a"), F.col("last").alias("b")), "child").join(label, "term_id")
    far = far.where((F.col("a") < F.col("pre")) | (F.col("a") > F.col("last")))
    before = Window.partitionBy("term_id").orderBy("a", F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    far = far.withColumn("reached", F.max("b").over(before)).where("reached is null or b > reached")
    more = far.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("more"))
    return label.join(more, "term_id", "left").withColumn("more", F.coalesce("more", F.array().cast("array<struct<a: bigint, b: bigint>>")))


def above(a: Column, b: Column) -> Column:
    """Whether the term labelled ``a`` is a strict ancestor of the one labelled ``b`` (structs of pre, last and more)."""
    inside = (a["pre"] < b["pre"]) & (b["pre"] <= a["last"])
    return F.coalesce(inside | F.exists(a["more"], lambda i: (i["a"] <= b["pre"]) & (b["pre"] <= i["b"])), F.lit(False))


#: Ranges of a forest's numbers, in which pairs and lists of one term are judged apart.
LABEL_RANGES = 256


def label_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (a, b) in which a is a strict ancestor of b, by labels.

    What a term reaches are intervals of numbers without a number in common. They and
    the rows' numbers of b are put in one order for each a and range of numbers, and a
    row stays where the interval that began last reaches it. So no row carries a list:
    those of terms near the root hold a share of all terms.
    """
    used = rows.select(F.col("a").alias("term_id")).distinct()
    reached = F.array_append(F.col("more"), F.struct((F.col("pre") + 1).alias("a"), F.col("last").alias("b")))
    own = labels.join(used, "term_id", "left_semi").select("term_id", F.explode(reached).alias("x")).select("term_id", "x.a", "x.b").where("a <= b")
    width = F.broadcast(labels.agg((F.floor(F.max("last") / LABEL_RANGES) + 1).alias("__w")))  # one row
    part = lambda c: F.floor(c / F.col("__w"))
    ends = own.join(width).select(F.col("term_id").alias("a"), F.explode(F.sequence(part(F.col("a")), part(F.col("b")))).alias("__r"), F.col("a").alias("__at"), F.col("b").alias("__to"))
    points = rows.join(labels.select(F.col("term_id").alias("b"), F.col("pre").alias("__at")), "b").join(width)
    points = points.withColumn("__r", part(F.col("__at"))).drop("__w").withColumn("__row", F.lit(True))
    order = Window.partitionBy("a", "__r").orderBy("__at", F.col("__row").asc_nulls_first())
    both = points.unionByName(ends, allowMissingColumns=True).withColumn("__to", F.max("__to").over(order))
    return both.where("__row and __to >= __at").select(*rows.columns)


def descendant_counts(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy(F.col("ancestor").alias("term_id")).agg(F.count("*").alias("n_descendants"))
    return nodes.select("term_id").join(n, "term_id", "left").select("term_id", F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("parent").alias("term_id")), "term_id", "left_anti").select("term_id")


def ancestors(ids: DataFrame, pairs: DataFrame, depths: DataFrame) -> DataFrame:
    """(term_id, ancestor, depth, rank): all ancestors of each id, by depth."""
    j = ids.join(pairs.select(F.col("descendant").alias("term_id"), "ancestor"), "term_id").join(depths.select(F.col("term_id").alias("ancestor"), "depth"), "ancestor")
    order = Window.partitionBy("term_id").orderBy("depth", "ancestor")
    return j.select("term_id", "ancestor", "depth", F.row_number().over(order).alias("rank"))


def ancestor_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows (a, b) in which a is a strict ancestor of b."""
    return rows.join(pairs.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b")), ["a", "b"], "left_semi")


def best_ancestor(ids: DataFrame, pairs: DataFrame, depths: DataFrame, *, max_depth: int = 5) -> DataFrame:
    """(term_id, best): the term if it is high enough, else its nearest ancestor that is, else the term."""
    own = ids.join(depths, "term_id")
    up = pairs.join(depths.select(F.col("term_id").alias("ancestor"), F.col("depth").alias("d")), "ancestor").where(F.col("d") <= max_depth)
    near = up.groupBy(F.col("descendant").alias("term_id")).agg(F.min_by("ancestor", F.struct("dist", "ancestor")).alias("near"))
    j = own.join(near, "term_id", "left")
    return j.select("term_id", F.when(F.col("depth") <= max_depth, F.col("term_id")).otherwise(F.coalesce("near", "term_id")).alias("best"))


def dag_stats(nodes: DataFrame, depths: DataFrame) -> DataFrame:
    """(kind, value, n): terms by namespace and by depth."""
    a = nodes.groupBy(F.col("namespace").alias("value")).agg(F.count("*").alias("n")).select(F.lit("namespace").alias("kind"), "value", "n")
    b = depths.groupBy(F.col("depth").cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("depth").alias("kind"), "value", "n")
    return a.unionByName(b)
