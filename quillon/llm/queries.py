"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_middle, lexical_search, license_scan, line_dedup, lm_scoring, mixing, ngram_join, quality_rules, token_files, topk_search, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokenize_to_files(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    deleted = F.coalesce(F.aggregate("deleted_runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"] + 1), F.lit(0).cast("long"))
    return out.select("doc_id", deleted.alias("deleted_lines"), F.md5("text").alias("kept_md5"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(license_scan.scan_licenses(_table(spark, sf_dir, "documents")))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return pairs.select("doc_id", "item_id", "matched", "item_windows", "kind")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "p_low_quality", "p_toxic", "rejected")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "class_id", "copy_id", "n_copies", "n_links", "n_classes")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.cascade(_table(spark, sf_dir, "documents")))


_ALL = (op1_mix_sources, op2_token_files, op3_line_dedup, op4_license_scan, op5_lm_scoring, op6_url_filter, op7_decontaminate, op8_exact_top_k, op9_toxicity, op10_ngram_jaccard, op11_fill_middle, op12_lexical_search, op13_quality_rules)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op8_exact_top_k": topk_search.ORACLE, "op11_fill_middle": fill_middle.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_quality_rules": quality_rules.ORACLE}
