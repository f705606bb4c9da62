"""URL filters by rules and by labelled path templates.

For each host a tree of path segments is built level by level from counts alone.
Segments that look variable (numbers, hexadecimal ids, dates) become wildcards at
once; a node with more than ``max_children`` children of which none holds half the
pages has them replaced by a wildcard. Labelled branches whose share of blocked
pages does not differ from their siblings' by a two-proportion test are merged;
branches without labels keep their segment.

A template's purity is its share of blocked pages, smoothed at each node on the way
from the host down to it: the node's own share is drawn towards that of the same path
on all other hosts of the table, this towards the parent node's purity, and the host's
towards the whole table's. So a branch without labels is judged by what its path
means elsewhere, and by its parent where it stands nowhere else. Labels that a node
shares whole with its child are counted at the child alone. A template is rejected if
its purity reaches ``purity`` and at least ``min_labelled`` labelled pages stand on
its host or, on any host, below a path of its own; with fewer the table's own share
must reach ``purity`` too.

Defined cases: a null url or one without ``://`` has an empty host and path and is
judged by no rule; a table without labels rejects nothing; equal rows are judged
alike; segments beyond the first ``max_depth`` take no part in the tree, so very long
urls are a few segments. Extra columns are passed through, but for columns of the result's own
names (host, path, rule, template, purity, verdict), which are replaced. Every step
but the rules works on counts; hosts, nodes and paths with very many pages, paths or
children are counted before they are joined and joined by broadcast (``join_hot``),
so no task holds all of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import join_hot, write_shared

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"^(?:\d+|[0-9a-f]{8,}|\d{4}-\d{2}(?:-\d{2})?)(?:\.[a-z]{2,5})?$"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(u, URL, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(u, URL, 2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _level(nodes: DataFrame, i: int, max_children: int, z: float) -> DataFrame:
    """``nodes`` with segment i of each path generalised below its prefix; paths without one stay."""
    seg = F.get("segs", F.lit(i))
    ended = nodes.where(F.size("segs") <= i)
    open_ = nodes.where(F.size("segs") > i).withColumn("seg", F.when(F.rlike(seg, F.lit(VARIABLE)), F.lit("*")).otherwise(seg))
    grouped = open_.groupBy("host", "prefix", "seg").agg(F.count("*").alias("n"), F.sum("n").alias("cn"), F.sum("labelled").alias("cl"), F.sum("blocked").alias("cb"))
    children = write_shared(grouped, "children")
    parents = children.groupBy("host", "prefix").agg(
        F.count("*").alias("n"), (F.max("cn") / F.sum("cn")).alias("top"), (F.sum("cb") / F.nullif(F.sum("cl"), F.lit(0))).alias("pool")
    )
    # The counts of a parent's children and of a child's paths are both called n.
    both = join_hot(children.withColumnRenamed("n", "paths"), parents, ["host", "prefix"])
    labelled = F.nullif("cl", F.lit(0))
    alike = F.abs(F.col("cb") / labelled - F.col("pool")) <= z * F.sqrt(F.col("pool") * (1 - F.col("pool")) / labelled)
    wide = (F.col("n") > max_children) & (F.col("top") < 0.5)
    name = F.when(wide | (F.col("seg") == "*"), "*").when((F.col("cl") > 0) & alike, "*alike").otherwise(F.col("seg"))
    names = write_shared(both.select("host", "prefix", "seg", F.col("paths").alias("n"), name.alias("name")), "names")
    joined = join_hot(open_.withColumnRenamed("n", "pages"), names, ["host", "prefix", "seg"])
    grown = joined.select("host", "shape", "segs", F.concat("prefix", F.lit("/"), "name").alias("prefix"), F.col("pages").alias("n"), "labelled", "blocked")
    return grown.unionByName(ended)


def path_templates(pages: DataFrame, *, max_depth: int = 6, max_children: int = 12, z: float = 1.96) -> DataFrame:
    """(host, shape, template, n, labelled, blocked) from ``pages(host, path, label)``.

    ``label`` is block, allow or null; ``shape`` is what pages are joined back by.
    """
    counts = pages.select("host", path_shape(F.col("path"), max_depth).alias("shape"), "label").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")
    )
    nodes = write_shared(counts.withColumn("segs", F.split("shape", "/")).withColumn("prefix", F.lit("")), "paths")
    deepest = nodes.agg(F.max(F.size("segs"))).first()[0] or 0
    for i in range(min(max_depth, deepest)):
        nodes = write_shared(_level(nodes, i, max_children, z), "paths")
    return nodes.select("host", "shape", F.col("prefix").alias("template"), "n", "labelled", "blocked")


def path_shape(path: Column, max_depth: int = 6) -> Column:
    """The path's first ``max_depth`` segments, variable ones as ``*``."""
    segs = F.slice(F.split(F.regexp_replace(path, "^/", ""), "/"), 1, max_depth)
    return F.array_join(F.transform(segs, lambda s: F.when(F.rlike(s, F.lit(VARIABLE)), F.lit("*")).otherwise(s)), "/")


def _evidence(templates: DataFrame) -> DataFrame:
    """(host, prefix, l, b, ol, ob): labelled and blocked pages below each node, and below its paths on other hosts."""
    parts, segs = F.split("template", "/"), F.split("shape", "/")
    places = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("prefix"), F.when(i > 1, F.array_join(F.slice(segs, 1, i - 1), "/")).alias("raw")),
    )
    rows = templates.select("host", "labelled", "blocked", F.explode(places).alias("at")).groupBy("host", "at.prefix", "at.raw")
    rows = write_shared(rows.agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "nodes")
    # Paths below the root that stand on several hosts; the root of a host is its own.
    paths = rows.where("raw is not null").groupBy("raw").agg(F.count("*").alias("n"), F.sum("l").alias("tl"), F.sum("b").alias("tb")).where("n > 1 and tl > 0")
    others = join_hot(rows, write_shared(paths, "paths"), ["raw"])
    # A path of one host lies in one node of it, so what is not the row's own is of other hosts.
    others = others.select("host", "prefix", F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("b"), (F.col("tl") - F.col("l")).alias("ol"), (F.col("tb") - F.col("b")).alias("ob"))
    own = rows.select("host", "prefix", "l", "b", F.lit(0).cast("long").alias("ol"), F.lit(0).cast("long").alias("ob"))
    return own.unionByName(others).groupBy("host", "prefix").agg(*[F.sum(c).alias(c) for c in ("l", "b", "ol", "ob")])


def judge_templates(templates: DataFrame, *, purity: float = 0.8, prior: float = 4.0, min_labelled: int = 3) -> DataFrame:
    """(host, template, n, labelled, purity, verdict) of ``path_templates``' result."""
    t = templates.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"))
    total = templates.agg(((F.sum("blocked") + 1) / (F.sum("labelled") + 2)).alias("all_rate"), F.sum("labelled").alias("all_labelled"))
    parts = F.split("template", "/")
    # The host is level 0, with the empty prefix.
    levels = t.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("level", "prefix"))
    nodes = write_shared(_evidence(templates).withColumnRenamed("host", "h"), "evidence")
    hit = join_hot(write_shared(levels.withColumnRenamed("host", "h"), "levels"), nodes.join(levels.groupBy(F.col("host").alias("h"), "prefix").agg(F.count("*").alias("below")), ["h", "prefix"]), ["h", "prefix"], "below")
    up = hit.groupBy(F.col("h").alias("host"), "template", "n", "labelled").agg(F.sort_array(F.collect_list(F.struct("level", "l", "b", "ol", "ob"))).alias("up"))
    t = up.join(F.broadcast(total))  # one row
    zero = F.lit(0).cast("long")

    def own(x: Column, i: Column) -> Column:
        """A level's counts without those that its child has all of."""
        child = F.get("up", i + 1)
        mine = child.isNull() | (child["l"] != x["l"]) | (child["b"] != x["b"])
        theirs = child.isNull() | (child["ol"] != x["ol"]) | (child["ob"] != x["ob"])
        return F.struct(*[F.when(which, x[c]).otherwise(zero).alias(c) for which, c in ((mine, "l"), (mine, "b"), (theirs, "ol"), (theirs, "ob"))])

    t = t.withColumn("steps", F.transform("up", own))
    fold = lambda p, x: (x["b"] + prior * ((x["ob"] + prior * p) / (x["ol"] + prior))) / (x["l"] + prior)
    t = t.withColumn("purity", F.aggregate("steps", F.col("all_rate"), fold))
    seen = F.array_max(F.transform("up", lambda x: x["l"] + x["ol"]))
    enough = (seen >= min_labelled) | ((F.col("all_labelled") >= min_labelled) & (F.col("all_rate") >= purity))
    bad = enough & (F.col("purity") >= purity)
    return t.select("host", "template", "n", "labelled", "purity", F.when(bad, "block").otherwise("allow").alias("verdict"))


def filter_urls(pages: DataFrame, *, rules: Sequence[tuple[str, str, str]] = RULES, labels: Column | None = None, **options) -> DataFrame:
    """``pages`` with host, path, rule, template, purity and verdict.

    Labels for the templates are ``labels`` (a column of block, allow or null), or
    else the verdicts of the rules on the pages that they fit.
    """
    depth = options.get("max_depth", 6)
    made = ("host", "path", "rule", "template", "purity", "verdict")
    pages = pages.select(F.struct(*[c for c in pages.columns if c not in made]).alias("__page"), *([labels.alias("__label")] if labels is not None else []))
    judged = with_host_path(pages, "__page.url")
    judged = judged.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.withColumn("label", F.col("__label") if labels is not None else F.col("hit.verdict")).withColumn("shape", path_shape(F.col("path"), depth))
    templates = path_templates(judged.select("host", "path", "label"), **options)
    verdicts = judge_templates(templates).select("host", "template", "purity", F.col("verdict").alias("learned"))
    spread = templates.groupBy("host", "template").agg(F.count("*").alias("shapes"))
    known = join_hot(templates, write_shared(verdicts.join(spread, ["host", "template"]), "verdicts"), ["host", "template"], "shapes")
    # Every page has a shape of its host, so the inner join keeps all.
    out = join_hot(judged, write_shared(known.select("host", "shape", "template", "purity", "learned", "n"), "known"), ["host", "shape"])
    return out.select("__page.*", "host", "path", F.col("hit.rule").alias("rule"), "template", "purity", F.coalesce("hit.verdict", "learned").alias("verdict"))
