"""Information content and choice of representative terms."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import BROADCAST_BYTES, broadcast_if, write_shared
from .ontology import descendant_counts, leaves


def ic_structural(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(term_id, ic): -log2((descendants + 1) / (2 * nodes))."""
    n = nodes.agg(F.count("*").alias("n"))
    c = descendant_counts(nodes, closure).join(F.broadcast(n))  # one row
    return c.select("term_id", (-F.log2((F.col("n_descendants") + 1) / (2 * F.col("n")))).alias("ic"))


def propagate_annotations(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term_id, gene), distinct: genes of a term and of all its descendants."""
    own = annotations.select("term_id", "gene").distinct()
    up = own.join(closure.select(F.col("descendant").alias("term_id"), "ancestor"), "term_id").select(F.col("ancestor").alias("term_id"), "gene")
    return own.unionByName(up).distinct()


#: Annotations below a term from which its genes are counted by gene and no longer as one set.
SET_GENES = 1 << 12


def propagated_counts(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term_id, n_genes): how many rows ``propagate_annotations`` has for each term; a null gene is one of them.

    Most terms have few annotations below them: these unite the gene sets of their
    descendants, so what moves is a set a pair of terms and not a row a pair and gene.
    The few with more, which are all above some others, are counted by gene. An
    annotation is led to the first of them above it, a gene's rows meet in one group of
    at most as many rows as there are such terms, and there the terms above those
    are added, told apart and counted, so no (term, gene) row is shuffled.
    """
    own = write_shared(annotations.select("term_id", "gene").where("term_id is not null").distinct(), "gene-rows")
    up = closure.groupBy(F.col("descendant").alias("term_id")).agg(F.collect_list("ancestor").alias("up"))
    used = own.groupBy("term_id").agg(F.count("*").alias("n")).join(up, "term_id", "left")
    paths = write_shared(used.select("term_id", "n", F.concat(F.array("term_id"), F.coalesce("up", F.array().cast(f"array<{dict(own.dtypes)['term_id']}>"))).alias("up")), "gene-paths")
    total = paths.select("n", F.explode("up").alias("term_id")).groupBy("term_id").agg(F.sum("n").alias("n"))
    large = write_shared(total.where(F.col("n") > SET_GENES).select("term_id"), "gene-terms")
    held = broadcast_if(large, LARGE_TERMS)
    # Terms with few annotations.
    sets = own.join(held, "term_id", "left_anti").groupBy("term_id").agg(F.collect_list("gene").alias("genes"), F.max(F.col("gene").isNull().cast("int")).alias("none"))
    sets = sets.join(paths.select("term_id", "up"), "term_id").select(F.explode("up").alias("term_id"), "genes", "none").join(held, "term_id", "left_anti")
    few = sets.groupBy("term_id").agg(F.flatten(F.collect_list("genes")).alias("genes"), F.max("none").alias("none"))
    few = few.select("term_id", (F.size(F.array_distinct("genes")) + F.col("none")).cast("long").alias("n_genes"))
    # Terms with many: the first of them above each annotated term, then those above these.
    pairs = closure.join(broadcast_if(large.select(F.col("term_id").alias("ancestor")), LARGE_TERMS), "ancestor", "left_semi")
    step = pairs.where("dist = 1").join(broadcast_if(large.select(F.col("term_id").alias("descendant")), LARGE_TERMS), "descendant", "left_anti")
    step = write_shared(step.select(F.col("descendant").alias("s"), F.col("ancestor").alias("top")), "gene-steps")
    tops = paths.select("term_id", F.explode("up").alias("s")).join(broadcast_if(step, LARGE_TERMS), "s").select("term_id", "top").distinct()
    tops = tops.unionByName(paths.select("term_id").join(held, "term_id", "left_semi").withColumn("top", F.col("term_id")))
    above = pairs.join(broadcast_if(large.select(F.col("term_id").alias("descendant")), LARGE_TERMS), "descendant", "left_semi").groupBy(F.col("descendant").alias("top")).agg(F.collect_list("ancestor").alias("more"))
    above = large.select(F.col("term_id").alias("top")).join(above, "top", "left").select("top", F.concat(F.array("top"), F.coalesce("more", F.array().cast(f"array<{dict(large.dtypes)['term_id']}>"))).alias("all"))
    above = write_shared(above, "gene-above")
    met = own.join(tops, "term_id").select("gene", "top").distinct().join(broadcast_if(above, LARGE_TERMS, BROADCAST_BYTES), "top")
    many = met.groupBy("gene").agg(F.flatten(F.collect_list("all")).alias("all")).select(F.explode(F.array_distinct("all")).alias("term_id"))
    return few.unionByName(many.groupBy("term_id").agg(F.count("*").alias("n_genes")))


#: Terms with many annotations, and steps to them, that may be broadcast; beyond, the joins are shuffled.
LARGE_TERMS = 1 << 20


#: Genes of one bitmap, of the 32768 that Spark's bitmaps hold; half, as a hash deals genes unevenly.
BITMAP_GENES = 1 << 14


def gene_numbers(annotations: DataFrame) -> DataFrame:
    """(gene, bucket, bit): a bit of a bitmap for each distinct gene, dealt to bitmaps by a hash so that no task numbers all."""
    genes = annotations.select("gene").where("gene is not null").distinct()
    buckets = genes.count() // BITMAP_GENES + 1
    dealt = genes.withColumn("bucket", F.pmod(F.xxhash64("gene"), F.lit(buckets)).cast("int"))
    bit = F.row_number().over(Window.partitionBy("bucket").orderBy("gene")) - 1
    fits = F.assert_true(F.col("bit") < 32768, F.lit("a bitmap has more genes than bits"))
    return dealt.withColumn("bit", bit).withColumn("bit", F.when(fits.isNull(), F.col("bit")))


def gene_bitmaps(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(term_id, bucket, genes): genes of a term and of all its descendants as bitmaps, one for each bucket of gene_numbers.

    A term's own bitmaps are built first and those of all below are united, so an
    ancestor's work follows its descendants and not their annotations.
    """
    numbers = write_shared(gene_numbers(annotations), "gene-numbers")
    own = annotations.select("term_id", "gene").join(numbers, "gene").groupBy("term_id", "bucket").agg(F.bitmap_construct_agg(F.col("bit")).alias("genes"))
    own = write_shared(own, "gene-bitmaps")
    up = own.join(closure.select(F.col("descendant").alias("term_id"), "ancestor"), "term_id").select(F.col("ancestor").alias("term_id"), "bucket", "genes")
    return own.unionByName(up).groupBy("term_id", "bucket").agg(F.bitmap_or_agg("genes").alias("genes"))


#: Bytes of a (term, gene) row and of a bitmap, by which the form that moves less is taken.
ROW_BYTES, BITMAP_BYTES = 16, 4096


def annotation_counts(nodes: DataFrame, closure: DataFrame, annotations: DataFrame, *, bitmaps: bool | None = None) -> DataFrame:
    """(term_id, n_genes): genes of each term and of all its descendants.

    As sets of genes or as bitmaps, by what would be fewer bytes; the result is the same.
    """
    live = annotations.join(nodes.select("term_id"), "term_id", "left_semi")
    if bitmaps is None:
        n = live.agg(F.count("*").alias("rows"), F.approx_count_distinct("term_id").alias("terms"), F.approx_count_distinct("gene").alias("genes")).first()
        bitmaps = n["terms"] * (n["genes"] // BITMAP_GENES + 1) * BITMAP_BYTES < n["rows"] * ROW_BYTES
    if bitmaps:
        n = gene_bitmaps(live, closure).groupBy("term_id").agg(F.sum(F.bitmap_count("genes")).alias("n_genes"))
    else:
        n = propagated_counts(live.where("gene is not null"), closure)
    return nodes.select("term_id").join(n, "term_id", "left").select("term_id", F.coalesce("n_genes", F.lit(0)).alias("n_genes"))


def ic_annotation(nodes: DataFrame, closure: DataFrame, annotations: DataFrame, *, counts: DataFrame | None = None) -> DataFrame:
    """(term_id, ic): -log2((genes + 1) / (G + N)); structural content where nothing is annotated. ``counts`` from annotation_counts, if known."""
    live = annotations.join(nodes.select("term_id"), "term_id", "left_semi")
    if live.isEmpty():
        return ic_structural(nodes, closure)
    totals = nodes.agg(F.count("*").alias("n")).join(F.broadcast(live.agg(F.countDistinct("gene").alias("g"))))  # one row each
    c = (annotation_counts(nodes, closure, live) if counts is None else counts).join(F.broadcast(totals))
    return c.select("term_id", (-F.log2((F.col("n_genes") + 1) / (F.col("g") + F.col("n")))).alias("ic"))


#: Candidates of a namespace that meet in one task of a round.
ROUND_CANDIDATES = 1024


def _cover_pairs(nodes: DataFrame, edges: DataFrame, closure: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates with their namespace's number of leaves and ``is_leaf``, and the (namespace, term_id, leaf) below them."""
    ends = leaves(nodes, edges).join(nodes.select("term_id", "namespace"), "term_id").select(F.col("term_id").alias("leaf"), "namespace")
    total = ends.groupBy("namespace").agg(F.count("*").alias("n_leaves"))
    own = ends.select(F.col("leaf").alias("term_id"), "namespace", F.lit(True).alias("is_leaf"))
    c = candidates.join(total, "namespace", "left").join(own, ["term_id", "namespace"], "left").fillna({"n_leaves": 0, "is_leaf": False})
    below = closure.join(ends, closure["descendant"] == ends["leaf"]).select(F.col("ancestor").alias("term_id"), "namespace", "leaf")
    return c, below.join(candidates.select("namespace", "term_id"), ["namespace", "term_id"], "left_semi")


def _bits(numbers) -> int:
    """A bit set of leaf numbers."""
    if numbers is None or not len(numbers):
        return 0
    raw = bytearray(max(numbers) // 8 + 1)
    for x in numbers:
        raw[x >> 3] |= 1 << (x & 7)
    return int.from_bytes(raw, "little")


def _numbered(lists, own) -> tuple[list[int], list[int]]:
    """Bit sets of the leaves below and of the candidates that are leaves, under numbers given in this task."""
    number: dict = {}
    of = lambda x: number.setdefault(x, len(number))
    return [_bits([of(x) for x in ([] if below is None else below)]) for below in lists], [0 if x is None else 1 << of(x) for x in own]


def _best_gains(frame: pd.DataFrame, room: int, need: float, size: int) -> tuple[list, bool]:
    """Greedy by IC * log2(new leaves + 1), and whether nothing is left to choose.

    A gain only falls as leaves get covered, so a stale bound that still leads is exact.
    The last row stands for all candidates outside the round: it stops the round once it leads.
    """
    sets, own = _numbered(frame["below"], [t if leaf else None for t, leaf in zip(frame["term_id"], frame["is_leaf"], strict=True)])
    outside = len(sets) - 1 if len(sets) > size else -1
    gain = lambda i, covered: frame["ic"][i] * math.log2((sets[i] & ~covered).bit_count() + 1)
    heap = [(-gain(i, 0), frame["term_id"][i], i) for i in range(len(sets))]
    heapq.heapify(heap)
    chosen, covered = [], 0
    while heap and len(chosen) < room and covered.bit_count() < need:
        _, term, i = heapq.heappop(heap)
        if i == outside:
            return chosen, False
        now = (-gain(i, covered), term, i)
        if heap and now > heap[0]:
            heapq.heappush(heap, now)
        elif now[0] >= 0:
            break
        else:
            chosen.append(term)
            covered |= sets[i] | own[i]
    return chosen, True


def _next_in_order(frame: pd.DataFrame, room: int, need: float, size: int) -> tuple[list, bool]:
    """In the given order; a term that adds no leaf and is none is passed over."""
    sets, own = _numbered(frame["below"], [t if leaf else None for t, leaf in zip(frame["term_id"], frame["is_leaf"], strict=True)])
    chosen, covered = [], 0
    for i, term in enumerate(frame["term_id"][:size]):
        if len(chosen) >= room or covered.bit_count() >= need:
            return chosen, True
        if sets[i] & ~covered or own[i]:
            chosen.append(term)
            covered |= sets[i] | own[i]
    return chosen, len(sets) <= size


def _select(candidates: DataFrame, below: DataFrame, order: list, pick, most: int, enough: float, static: bool, size: int | None = None) -> DataFrame:
    """(namespace, term_id, rank) by rounds of ``size`` (ROUND_CANDIDATES) leading candidates a namespace.

    Each round counts the leaves that are still open below each candidate over the
    cluster, hands the leaders of each namespace with their open leaves to ``pick``, and
    takes the leaves of those chosen away. Only the chosen, at most ``most`` a namespace,
    and a flag a namespace are kept between rounds. ``order`` may use ``n_open`` and ``ic``;
    it is fixed from the start if ``static``.
    """
    below, candidates = write_shared(below, "cover-leaves"), write_shared(candidates, "cover-candidates")
    key, kinds, size = ["namespace", "term_id"], dict(candidates.dtypes), size or ROUND_CANDIDATES
    if static:
        n_all = below.groupBy(*key).agg(F.count("*").alias("n_all"))
        candidates = write_shared(candidates.join(n_all, key, "left").fillna({"n_all": 0}), "cover-order")
    chosen = seen = candidates.select(*key, F.lit(0).alias("rank")).where("false")
    done, covered = seen.select("namespace"), below.select("namespace", "leaf").where("false")
    while True:
        left = candidates.join(done, "namespace", "left_anti").join(seen, key, "left_anti")
        open_leaves = below.join(covered, ["namespace", "leaf"], "left_anti")
        counted = open_leaves.groupBy(*key).agg(F.count("*").alias("n_open"))
        place = F.row_number().over(Window.partitionBy("namespace").orderBy(*order, "term_id"))
        lead = left.join(counted, key, "left").fillna({"n_open": 0}).withColumn("place", place).where(F.col("place") <= size + 1)
        lead = lead.join(open_leaves.join(lead.select(*key), key, "left_semi").groupBy(*key).agg(F.collect_list("leaf").alias("below")), key, "left")
        n_chosen, n_covered = (t.groupBy("namespace").agg(F.count("*").alias(n)) for t, n in ((chosen, "n_chosen"), (covered, "n_covered")))
        lead = lead.join(n_chosen, "namespace", "left").join(n_covered, "namespace", "left").fillna({"n_chosen": 0, "n_covered": 0})

        def run(group: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("place").reset_index(drop=True)
            before = int(frame["n_chosen"][0])
            need = enough * max(1, int(frame["n_leaves"].max())) - int(frame["n_covered"][0])
            ids, ended = pick(frame, most - before, need, size)
            tried = list(frame["term_id"][:size]) if static else ids
            rank = {t: before + i + 1 for i, t in enumerate(ids)}
            return pd.DataFrame({"namespace": [group[0]] * (len(tried) + 1), "term_id": pd.Series([*tried, None], dtype=object), "rank": pd.Series([*(rank.get(t) for t in tried), None], dtype=object), "ended": [ended] * (len(tried) + 1)})

        found = write_shared(lead.groupBy("namespace").applyInPandas(run, f"namespace {kinds['namespace']}, term_id {kinds['term_id']}, rank int, ended boolean"), "cover-round")
        now = found.where("rank is not null").select(*key, "rank")
        gone = now.select(*key).join(below, key).select("namespace", "leaf").unionByName(now.join(candidates.where("is_leaf"), key).select("namespace", F.col("term_id").alias("leaf")))
        chosen, seen = chosen.unionByName(now), seen.unionByName(found.where("term_id is not null").select(*key, "rank"))
        done = done.unionByName(found.where("ended").select("namespace").distinct())
        covered = write_shared(covered.unionByName(gone).distinct(), "covered")
        if found.where("not ended").isEmpty():
            return chosen


def select_by_ic(nodes: DataFrame, edges: DataFrame, closure: DataFrame, depths: DataFrame, ic: DataFrame, *, min_depth: int = 2, max_depth: int = 6, min_descendants: int = 5, max_nodes: int = 500, coverage: float = 0.95, ic_min: float = 1.0, ic_max: float = 8.0, min_annotations: int = 0, counts: DataFrame | None = None) -> DataFrame:
    """(namespace, term_id, rank) chosen in each namespace, each time the highest IC * log2(new leaves + 1), ties by id."""
    c = nodes.join(depths, "term_id").join(descendant_counts(nodes, closure), "term_id").join(ic, "term_id")
    c = c.where(F.col("depth").between(min_depth, max_depth) & (F.col("n_descendants") >= min_descendants) & F.col("ic").between(ic_min, ic_max))
    if min_annotations and counts is not None:
        c = c.join(counts, "term_id").where(F.col("n_genes") >= min_annotations)
    pairs = _cover_pairs(nodes, edges, closure, c.select("namespace", "term_id", "ic"))
    return _select(*pairs, [F.desc(F.col("ic") * F.log2(F.col("n_open") + 1))], _best_gains, max_nodes, coverage, False)


def select_static(nodes: DataFrame, edges: DataFrame, closure: DataFrame, depths: DataFrame, *, min_depth: int = 2, max_depth: int = 6, min_descendants: int = 10, max_nodes: int = 500, coverage: float = 0.95) -> DataFrame:
    """(namespace, term_id, rank) by leaf cover and depth; a namespace without candidates takes all its terms as such."""
    all_terms = nodes.join(depths, "term_id").join(descendant_counts(nodes, closure), "term_id")
    fits = F.col("depth").between(min_depth, max_depth) & (F.col("n_descendants") >= min_descendants)
    any_fit = F.max(fits.cast("int")).over(Window.partitionBy("namespace"))
    c = all_terms.withColumn("fit", fits).withColumn("any", any_fit).where((F.col("any") == 0) | F.col("fit"))
    pairs = _cover_pairs(nodes, edges, closure, c.select("namespace", "term_id", "depth"))
    worth = F.col("n_all") / (1 + 0.05 * F.abs(F.col("depth") - (min_depth + max_depth) / 2))
    return _select(*pairs, [F.desc(worth)], _next_in_order, max_nodes, coverage, True)


def compressed_terms(terms: DataFrame, selected: DataFrame) -> DataFrame:
    return terms.join(selected.select("term_id"), "term_id", "left_semi")


def top_by_ic(selected: DataFrame, ic: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("namespace").orderBy(F.desc("ic"), "term_id")
    return selected.join(ic, "term_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("namespace", "place", "term_id", "ic")


def compare_ic(structural: DataFrame, annotated: DataFrame, counts: DataFrame) -> DataFrame:
    a = structural.withColumnRenamed("ic", "ic_structural").join(annotated.withColumnRenamed("ic", "ic_annotation"), "term_id")
    return a.join(counts, "term_id").select("term_id", "ic_structural", "ic_annotation", "n_genes")


def rep_members(closure: DataFrame, selected: DataFrame) -> DataFrame:
    """(rep_id, member_id): descendants of each chosen term."""
    reps = selected.select(F.col("term_id").alias("ancestor"))
    return closure.join(reps, "ancestor", "left_semi").select(F.col("ancestor").alias("rep_id"), F.col("descendant").alias("member_id"))
