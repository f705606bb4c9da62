"""Uniting evidence of several sources by (document, term)."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import parts_for


@dataclass(frozen=True)
class Preset:
    vector_threshold: float
    llm_threshold: float
    weight_dict: float
    weight_vector: float
    weight_llm: float
    consensus_bonus: float
    final_threshold: float
    min_consensus: int = 1


#: Named parameter sets.
PRESETS = {
    "strict": Preset(0.72, 0.65, 0.70, 0.20, 0.10, 0.06, 0.80),
    "balanced": Preset(0.60, 0.50, 0.60, 0.25, 0.15, 0.05, 0.70),
    "recall": Preset(0.50, 0.40, 0.50, 0.30, 0.20, 0.03, 0.58),
    "conservative": Preset(0.72, 0.65, 0.70, 0.20, 0.10, 0.06, 0.80, 2),
}


def best_per_term(hits: DataFrame) -> DataFrame:
    """One row for each (doc_id, term_id): the highest score, then the first by ``pos``."""
    order = Window.partitionBy("doc_id", "term_id").orderBy(F.desc("score"), "pos")
    return hits.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


SOURCES = ("dict", "vector", "llm")


def _weighted(scores: list[Column], weights: list[Column], bonus: Column) -> tuple[Column, Column]:
    """(sources that are there, their weighted mean with a bonus for each further one)."""
    parts = list(zip(scores, weights, strict=True))
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    mean = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0)) / F.greatest(total, F.lit(1e-8))
    n = sum((c.isNotNull().cast("int") for c in scores), F.lit(0))
    return n, F.least(F.lit(1.0), mean + F.greatest(n - 1, F.lit(0)) * bonus)


def _order() -> tuple[Column, ...]:
    """Hits count in the order of their sources, then of their places, the better score first."""
    return F.when(F.col("source") == "dict", 0).when(F.col("source") == "vector", 1).otherwise(2), F.when(F.col("start") >= 0, F.col("start")), -F.col("score")


def fuse_sources(hits: DataFrame, preset: Preset) -> DataFrame:
    """Scores by source and their weighted mean with a bonus for each further source.

    ``hits(doc_id, term_id, source, score, match_type, span, start, end)``. The span is
    the first that has a place, the match type exact if any is, else that of the first
    hit, in the order of _order.
    """
    by = lambda s: F.max(F.when(F.col("source") == s, F.col("score"))).alias(s)
    place = F.min_by(F.struct("span", "start", "end"), F.struct(F.when(F.col("start") >= 0, 0).otherwise(1), *_order()))
    kind = F.min_by("match_type", F.struct(F.when(F.col("match_type") == "exact", 0).otherwise(1), *_order(), F.col("match_type")))
    g = hits.groupBy("doc_id", "term_id").agg(*map(by, SOURCES), place.alias("p"), kind.alias("match_type"))
    n, fused = _weighted([F.col(s) for s in SOURCES], [F.lit(w) for w in (preset.weight_dict, preset.weight_vector, preset.weight_llm)], F.lit(preset.consensus_bonus))
    return g.withColumn("n_sources", n).withColumn("fused", fused).select("doc_id", "term_id", "p.*", "match_type", *SOURCES, "n_sources", "fused")


def accept_fused(fused: DataFrame, preset: Preset) -> DataFrame:
    """Rows with strong literal evidence, or enough fused score and sources; ``source`` names these."""
    strong = F.col("match_type").isin("exact", "synonym", "go_id") & (F.coalesce("dict", F.lit(0.0)) >= 0.95)
    enough = (F.col("fused") >= preset.final_threshold) & (F.col("n_sources") >= preset.min_consensus)
    names = F.array_join(F.array_sort(F.filter(F.array(*[F.when(F.col(s).isNotNull(), F.lit(s)) for s in ("dict", "vector", "llm")]), lambda x: x.isNotNull())), "+")
    return fused.where(strong | enough).withColumn("source", names).withColumn("score", F.round("fused", 3))


def merge_two_sources(literal: DataFrame, model: DataFrame, *, threshold: float = 0.55) -> DataFrame:
    """(doc_id, term_id, score, source): literal hits united with model hits of enough confidence."""
    a = literal.groupBy("doc_id", "term_id").agg(F.max("score").alias("a"))
    b = model.where((F.col("confidence") >= threshold) & F.col("term_id").isNotNull()).groupBy("doc_id", "term_id").agg(F.max("confidence").alias("b"))
    j = a.join(b, ["doc_id", "term_id"], "full_outer")
    return j.select("doc_id", "term_id", F.greatest("a", "b").alias("score"), F.concat_ws("+", F.when(F.col("a").isNotNull(), F.lit("nltk")), F.when(F.col("b").isNotNull(), F.lit("llm"))).alias("source"))


def retrieve_candidates(dict_hits: DataFrame, vector_hits: DataFrame, *, k: int = 12, threshold: float = 0.70) -> DataFrame:
    """(doc_id, term_id, score, source, rank): per term the better of both sources, the k best.

    Hits are dealt by document into as many partitions as their rows ask for.
    """
    a = dict_hits.where(~T.is_generic(F.col("span"))).select("doc_id", "term_id", "score", F.lit("dict").alias("source"))
    b = vector_hits.where(F.col("score") >= threshold).select("doc_id", "term_id", "score", F.lit("vector").alias("source"))
    hits = a.unionByName(b)
    hits = hits.repartition(max(parts_for(hits.count()), hits.sparkSession.sparkContext.defaultParallelism), "doc_id")
    best = hits.groupBy("doc_id", "term_id").agg(F.max_by(F.struct("score", "source"), F.struct("score", F.when(F.col("source") == "dict", 1).otherwise(0))).alias("x"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("x.score"), "term_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("doc_id", "term_id", "x.score", "x.source", "rank")


def preset_sweep(hits: DataFrame, presets: dict[str, Preset] = PRESETS) -> DataFrame:
    """(preset, doc_id, term_id) accepted under each preset.

    Hits are grouped once, without a preset: a source's best score passes a preset's
    threshold if any of its scores does, so the presets, one row each, meet the groups
    and not the hits. Of match types only those beside a dictionary hit decide, so the
    first of these is kept, and the best score of an exact hit of each source.
    """
    best = lambda s, name, cond=F.lit(True): F.max(F.when((F.col("source") == s) & cond, F.col("score"))).alias(name)
    literal = F.struct(*_order(), F.col("match_type"))
    g = hits.groupBy("doc_id", "term_id").agg(
        *[best(s, s) for s in SOURCES], *[best(s, f"exact_{s}", F.col("match_type") == "exact") for s in SOURCES],
        F.min_by("match_type", F.when(F.col("source") == "dict", literal)).alias("kind"),
    )
    table = F.array(*[F.struct(F.lit(name).alias("preset"), *[F.lit(v).alias(k) for k, v in asdict(p).items()]) for name, p in presets.items()])
    g = g.withColumn("p", F.explode(table)).select("*", "p.*")
    passed = lambda c, s: F.when(F.col(c) >= F.col(f"{s}_threshold"), F.col(c)) if s != "dict" else F.col(c)
    n, fused = _weighted([passed(s, s) for s in SOURCES], [F.col(f"weight_{s}") for s in SOURCES], F.col("consensus_bonus"))
    exact = F.coalesce(*[passed(f"exact_{s}", s) for s in SOURCES]).isNotNull()
    strong = (exact | F.col("kind").isin("synonym", "go_id")) & (F.col("dict") >= 0.95)
    enough = (n > 0) & (fused >= F.col("final_threshold")) & (n >= F.col("min_consensus"))
    return g.where(F.coalesce(strong, F.lit(False)) | enough).select("preset", "doc_id", "term_id")
