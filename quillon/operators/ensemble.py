"""The annotators in a cascade: dictionary, then vectors for what it leaves open, then a model's answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.shared import write_shared
from .fusion import Preset, accept_fused, fuse_sources
from .match import annotate_dictionary, uncovered_sentences
from .vectors import topk_cosine


def annotate_ensemble(docs: DataFrame, terms: DataFrame, items: DataFrame, encoder: Callable[[DataFrame, str, str], DataFrame], model_hits: DataFrame, preset: Preset, *, alias: DataFrame | None = None, most_covered: float = 0.6) -> DataFrame:
    """(doc_id, term_id, span, start, end, match_type, source, score, ..) of ``docs(doc_id, text)``.

    Sentences of which dictionary hits cover at most ``most_covered`` are looked up
    among ``items(node_id, embedding)``, each distinct sentence once; the best item
    counts if it reaches the preset's threshold. ``model_hits(doc_id, term_id, span,
    confidence)`` are located in the text. All hits are fused by document and term.
    """
    columns = ["doc_id", "term_id", "source", "score", "match_type", "span", "start", "end"]
    # Read twice, as are the open sentences.
    literal = write_shared(annotate_dictionary(docs, terms, alias=alias), "literal-hits")
    sentences = write_shared(uncovered_sentences(docs, literal, most=most_covered).withColumn("query_id", F.xxhash64("sentence")), "open-sentences")
    near = topk_cosine(encoder(sentences.select("query_id", "sentence").dropDuplicates(["query_id"]), "query_id", "sentence"), items, 1)
    near = near.where(F.col("similarity") >= preset.vector_threshold).select("query_id", F.col("node_id").alias("term_id"), F.col("similarity").alias("score"))
    vector = sentences.join(near, "query_id").select("doc_id", "term_id", "score", F.lit("vector").alias("match_type"), F.col("sentence").alias("span"), "start", "end")
    told = model_hits.where((F.col("confidence") >= preset.llm_threshold) & F.col("term_id").isNotNull())
    told = told.join(docs.select("doc_id", "text"), "doc_id").withColumn("at", T.locate_span("text", "span"))
    told = told.select("doc_id", "term_id", F.col("confidence").alias("score"), F.lit("llm").alias("match_type"), "at.span", "at.start", "at.end")
    hits = literal.withColumn("source", F.lit("dict")).select(*columns)
    for name, part in (("vector", vector), ("llm", told)):
        hits = hits.unionByName(part.withColumn("source", F.lit(name)).select(*columns))
    return accept_fused(fuse_sources(hits, preset), preset)
