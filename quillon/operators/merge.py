"""Removing redundant terms of a document by the ontology's hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .match import words_of
from .ontology import above

#: Terms kept of a namespace.
LIMITS = {"biological_process": 2, "molecular_function": 1, "cellular_component": 1}
#: Names that stand for one concept.
CLUSTERS = {
    "photosynthesis": ("photosynthesis", "carbon fixation", "photosynthetic acclimation", "light harvesting", "light reaction", "photosystem ii assembly"),
    "dna_repair": ("dna repair", "double-strand break repair", "genome maintenance", "repair factor recruitment"),
    "transmembrane_transport": ("transmembrane transport", "potassium ion transport", "ion transport", "metabolite transport", "transporter activity"),
    "signal_transduction": ("signal transduction", "signaling cascade", "mapk cascade", "kinase signaling", "receptor signaling"),
    "translation": ("translation", "translational initiation", "translational elongation", "ribosome biogenesis", "ribosomal assembly"),
}


def cluster_of(rows: DataFrame, clusters: dict[str, tuple[str, ...]] = CLUSTERS) -> DataFrame:
    """``rows(name, ..)`` with the first cluster that lists the lower-cased name, else null."""
    out = F.lit(None).cast("string")
    for cluster, names in reversed(clusters.items()):
        out = F.when(F.lower(F.trim("name")).isin(*names), cluster).otherwise(out)
    return rows.withColumn("cluster", out)


def merge_score(candidates: DataFrame, docs: DataFrame, depths: DataFrame) -> DataFrame:
    """``candidates(doc_id, term_id, name, span, score, ..)`` with ``final`` from text, model, depth and bonus.

    Terms are met before documents, so the rows leave dealt by ``doc_id``. A document's
    words are cut once, not for each candidate.
    """
    text = docs.select("doc_id", F.lower("text").alias("__t")).withColumn("__tw", words_of(F.regexp_replace("__t", "[/-]", " ")))
    c = candidates.join(depths.select("term_id", "depth"), "term_id", "left").join(text, "doc_id")
    name, span = F.lower(F.trim("name")), F.lower(F.trim(F.coalesce("span", F.lit(""))))
    c = c.withColumn("__nw", words_of(name))
    inside = (name != "") & F.contains(F.col("__t"), name)
    overlap = F.size(F.array_intersect("__tw", "__nw")) / F.greatest(F.size("__nw"), F.lit(1))
    text = F.when(inside, 1.0).when((span != "") & (span == name), 0.95).when((span != "") & F.contains(name, span), 0.75).when(name == "", 0.0).otherwise(F.least(F.lit(0.8), overlap))
    bonus = F.least(F.lit(0.25), F.when(F.contains(F.col("__t"), F.lower("name")), 0.15).otherwise(0.0) + F.when((span != "") & (span == F.lower("name")), 0.10).otherwise(0.0))
    model = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))
    deep = F.least(F.lit(1.0), F.coalesce("depth", F.lit(0)) / 12.0)
    final = F.round(F.least(F.lit(1.0), 0.45 * text + 0.25 * model + 0.20 * deep + 0.10 * bonus), 4)
    return c.withColumn("final", final).drop("__t", "__tw", "__nw", "depth")


def _best(rows: DataFrame) -> DataFrame:
    """The candidate of each term with the highest given score; of equal ones the first by ``pos`` if there is one, else by final score and span."""
    first = [F.col("pos")] if "pos" in rows.columns else []
    order = Window.partitionBy("doc_id", "term_id").orderBy(F.desc("score"), *first, F.desc("final"), "span")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def _without_kin(rows: Column, kind: str) -> Column:
    """Of rows (namespace, label, ..) in order, those without an ancestor or descendant of their namespace among the ones kept before."""
    kin = lambda x, y: x["namespace"].eqNullSafe(y["namespace"]) & (above(x["label"], y["label"]) | above(y["label"], x["label"]))
    kept = F.aggregate(rows, F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: kin(x, y)), acc).otherwise(F.array_append(acc, x)))
    return F.when(F.size(rows) < 2, rows).otherwise(kept)


def _label(labels: DataFrame) -> DataFrame:
    return labels.select("term_id", F.struct("pre", "last", "more").alias("label"))


def drop_hierarchy_conflicts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """By document and namespace, in score order: terms without an ancestor or descendant among those kept; ``labels`` from reach_labels."""
    item = F.struct((-F.col("final")).alias("k"), "term_id", "namespace", "label")
    lists = rows.join(_label(labels), "term_id", "left").groupBy("doc_id", "namespace").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kept = _without_kin(F.col("all"), lists.schema["all"].dataType.simpleString())
    keys = lists.select("doc_id", "namespace", F.explode(kept).alias("x")).select("doc_id", "namespace", "x.term_id")
    return rows.join(keys, ["doc_id", "namespace", "term_id"], "left_semi")


def drop_cluster_conflicts(rows: DataFrame) -> DataFrame:
    """The best of each (doc_id, namespace, cluster); rows without a cluster pass."""
    key = F.coalesce("cluster", F.concat(F.lit("\x00"), F.col("term_id").cast("string")))
    order = Window.partitionBy("doc_id", "namespace", key).orderBy(F.desc("final"), "term_id")
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def limit_per_namespace(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """The best terms of each namespace, as many as it may have."""
    order = Window.partitionBy("doc_id", "namespace").orderBy(F.desc("final"), "term_id")
    most = F.lit(None).cast("int")
    for namespace, n in limits.items():
        most = F.when(F.col("namespace") == namespace, n).otherwise(most)
    return rows.withColumn("k", F.row_number().over(order)).where(most.isNull() | (F.col("k") <= most)).drop("k")


def merge_terms(docs: DataFrame, candidates: DataFrame, labels: DataFrame, depths: DataFrame, *, limits: dict[str, int] = LIMITS, clusters: dict[str, tuple[str, ...]] = CLUSTERS) -> DataFrame:
    """(doc_id, kept, dropped): the terms that stay, by namespace and score, and those that go.

    Labels and depths meet the candidates by term, then all else is by document: a
    document's terms are scored once and become one list, from which kin, clusters and
    surplus terms are taken away as drop_hierarchy_conflicts, drop_cluster_conflicts and
    limit_per_namespace do.
    """
    scored = _best(cluster_of(merge_score(candidates.join(_label(labels), "term_id", "left"), docs, depths), clusters))
    item = F.struct("namespace", (-F.col("final")).alias("k"), "term_id", "cluster", "label")
    lists = scored.where("term_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = lists.schema["all"].dataType.simpleString()
    lists = lists.withColumn("free", _without_kin(F.filter("all", lambda x: x["namespace"].isNotNull()), kind))
    lists = lists.select("doc_id", F.transform("all", lambda x: x["term_id"]).alias("all"), F.transform("free", lambda x: x.dropFields("label")).alias("free"))
    key = lambda x: F.when(x["cluster"].isNotNull(), F.struct(x["namespace"], x["cluster"]))
    lists = lists.withColumn("keys", F.transform("free", key))
    lists = lists.withColumn("free", F.filter("free", lambda x, i: x["cluster"].isNull() | (F.array_position(F.col("keys"), key(x)) == i + 1)))
    # Terms stand by namespace, so a term's place in it is its distance from the namespace's first.
    lists = lists.withColumn("spaces", F.transform("free", lambda x: x["namespace"]))
    most = lambda x: F.coalesce(*[F.when(x["namespace"] == name, n) for name, n in limits.items()], F.lit(2**31 - 1))
    kept = F.filter("free", lambda x, i: i + 1 - F.array_position(F.col("spaces"), x["namespace"]) < most(x))
    lists = lists.select("doc_id", F.array_sort(F.array_distinct("all")).alias("all"), F.transform(kept, lambda x: x["term_id"]).alias("kept"))
    lists = lists.withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")))
    return lists.select("doc_id", "kept", F.array_except("all", "kept").alias("dropped"))


def merge_ids(docs: DataFrame, ids: DataFrame, terms: DataFrame, labels: DataFrame, depths: DataFrame, *, score: float = 1.0, **options) -> DataFrame:
    """``merge_terms`` of plain ``ids(doc_id, term_id)``: known terms stand for themselves by name, all with one score."""
    known = ids.distinct().join(terms.select("term_id", "name", "namespace"), "term_id")
    return merge_terms(docs, known.withColumn("span", F.col("name")).withColumn("score", F.lit(score)), labels, depths, **options)
