"""Reading ontologies and cases, writing indexes, subsets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK
from ..plans.shared import small_enough

#: Rows of a report table that are written as one file.
SMALL_REPORT = 10_000


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(ord, lines) of each term stanza, in file order."""
    raw = spark.read.option("lineSep", "\n[Term]").text(path).withColumn("ord", F.monotonically_increasing_id())
    body = F.regexp_replace("value", "\r", "")
    # The head of the file is no stanza unless it starts with one.
    head = (F.col("ord") == 0) & ~body.startswith("[Term]")
    body = F.regexp_replace(body, r"^\[Term\]", "")
    body = F.regexp_replace(body, r"(?s)\n\[.*$", "")
    return raw.where(~head).select("ord", F.transform(F.split(body, "\n"), lambda x: F.rtrim(x)).alias("lines"))


def _values(key: str) -> Column:
    prefix = f"{key}: "
    return F.transform(F.filter("lines", lambda x: x.startswith(prefix)), lambda x: F.substring(x, len(prefix) + 1, 1 << 30))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """terms(term_id, name, namespace, definition, synonyms, alt_ids, parents, ord); a later id overwrites."""
    last = lambda key: F.try_element_at(_values(key), F.lit(-1))
    quoted = lambda x: F.regexp_extract(x, r'^"(.+?)"', 1)
    raw = last("def")
    terms = _stanzas(spark, path).select(
        last("id").alias("term_id"),
        last("name").alias("name"),
        F.coalesce(last("namespace"), F.lit("")).alias("namespace"),
        F.coalesce(F.nullif(quoted(raw), F.lit("")), raw, F.lit("")).alias("definition"),
        F.filter(F.transform(_values("synonym"), quoted), lambda x: x != "").alias("synonyms"),
        _values("alt_id").alias("alt_ids"),
        F.transform(_values("is_a"), lambda x: F.trim(F.substring_index(x, "!", 1))).alias("parents"),
        F.array_contains(_values("is_obsolete"), "true").alias("obsolete"),
        "ord",
    )
    live = terms.where("not obsolete and term_id is not null and name is not null").drop("obsolete")
    latest = Window.partitionBy("term_id").orderBy(F.desc("ord"))
    return live.withColumn("k", F.row_number().over(latest)).where("k = 1").drop("k")


def term_alias(terms: DataFrame) -> DataFrame:
    """(any_id, term_id): primary ids, then alternative ids, the last one written wins."""
    primary = terms.select(F.col("term_id").alias("any_id"), "term_id", "ord")
    other = terms.select(F.explode("alt_ids").alias("any_id"), "term_id", "ord")
    return primary.unionByName(other).groupBy("any_id").agg(F.max_by("term_id", "ord").alias("term_id"))


def read_edges(terms: DataFrame) -> DataFrame:
    """edges(child, parent) between live terms, distinct."""
    edges = terms.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent"))
    live = terms.select(F.col("term_id").alias("parent"))
    return edges.join(live, "parent", "left_semi").select("child", "parent").distinct()


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """cases(case_id, text, gold, lang, difficulty) from a JSON list or an object that holds one."""
    case = "struct<id: bigint, text: string, gold: array<string>, lang: string, difficulty: string>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{case}>")).otherwise(F.from_json("value", f"struct<cases: array<{case}>>")["cases"])
    return clean_cases(raw.select(F.explode(listed).alias("c")).select(F.col("c.id").alias("case_id"), "c.text", "c.gold", "c.lang", "c.difficulty"))


def clean_cases(cases: DataFrame) -> DataFrame:
    """Stripped texts, none empty; gold ids upper-cased, those of the ontology only."""
    gold = F.filter(F.transform(F.coalesce("gold", F.array().cast("array<string>")), lambda g: F.upper(F.trim(g, F.lit(BLANK)))), lambda g: g.startswith("GO:"))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    out = cases.select("case_id", F.trim("text", F.lit(BLANK)).alias("text"), gold.alias("gold"), unknown(F.col("lang")).alias("lang"), unknown(F.col("difficulty")).alias("difficulty"))
    return out.where("text <> ''")


def write_case_subset(cases: DataFrame, langs: list[str], path: str) -> DataFrame:
    """Write the cases of some languages; returns their counts by difficulty."""
    kept = cases.where(F.col("lang").isin(langs))
    kept.write.json(path)
    return kept.groupBy("difficulty").agg(F.count("*").alias("n"))


#: Node columns, by table.
NODE_COLUMNS = ("node_type", "node_id", "name", "namespace", "synonyms", "description", "comment", "entrez_id", "journal", "year")


def read_graph_nodes(terms: DataFrame, genes: DataFrame, papers: DataFrame, traits: DataFrame) -> DataFrame:
    """The union of four node tables; ids prefixed once, empty strings null, rows without an id dropped."""
    some = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    prefixed = lambda p, c: F.when(some(c).startswith(p), some(c)).otherwise(F.concat(F.lit(p), some(c)))
    tables = [
        terms.select(F.lit("GO_Term").alias("node_type"), some("go_id").alias("node_id"), F.coalesce(some("name"), some("go_id")).alias("name"), some("namespace").alias("namespace"), some("synonyms").alias("synonyms"), some("description").alias("description"), some("comment").alias("comment")),
        genes.select(F.lit("Gene").alias("node_type"), prefixed("Gene:", "gene_id").alias("node_id"), F.coalesce(some("name"), some("gene_id")).alias("name"), some("entrez_id").alias("entrez_id")),
        papers.select(F.lit("PMID").alias("node_type"), prefixed("PMID:", "pmid").alias("node_id"), some("title").alias("name"), some("journal").alias("journal"), some("year").alias("year")),
        traits.select(F.lit("RTO_Term").alias("node_type"), prefixed("RTO:", "rto_id").alias("node_id"), F.coalesce(some("name"), some("rto_id")).alias("name"), some("description").alias("description")),
    ]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    for c in NODE_COLUMNS:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*NODE_COLUMNS).where("node_id is not null")


META = "struct<dim: int, items: map<string, struct<node_type: string, go_id: string, name: string, namespace: string, synonyms: string, description: string, comment: string>>>"


def nodes_from_metadata(raw: DataFrame, column: str = "value") -> DataFrame:
    """Node rows of a JSON metadata map; packed descriptions of genes and papers are taken apart."""
    m = raw.select(F.from_json(column, META).alias("m")).select(F.explode("m.items").alias("idx", "x")).select(F.col("idx").cast("long").alias("idx"), "x.*")
    part = lambda label: F.nullif(F.trim(F.regexp_extract(F.coalesce("description", F.lit("")), rf"{label}:\s*([^,]*)", 1)), F.lit(""))
    kind = F.coalesce("node_type", F.lit("GO_Term"))
    return m.select("idx", kind.alias("node_type"), F.col("go_id").alias("node_id"), "name", "namespace", "synonyms", "description", "comment", F.when(kind == "Gene", part("EntrezID")).alias("entrez_id"), F.when(kind == "PMID", part("Journal")).alias("journal"), F.when(kind == "PMID", part("Year")).alias("year"))


#: The measures by which an index may be searched.
METRICS = ("l2", "cosine")


def write_node_index(nodes: DataFrame, path: str, dim: int, *, metric: str = "l2", encoder: str = "hash") -> None:
    """Write nodes with vectors, by type; a vector of another length stops the job.

    Length, metric and the encoder's name are stored with the vectors' column, in the files themselves.
    """
    if metric not in METRICS:
        raise ValueError(f"an index's metric is one of {', '.join(METRICS)}, not {metric}")
    right = F.assert_true(F.size("embedding") == dim, F.lit(f"embedding length is not {dim}"))
    kind = {"dim": dim, "metric": metric, "encoder": encoder}
    checked = nodes.withColumn("__ok", right).where("__ok is null").drop("__ok")
    checked.withColumn("embedding", F.col("embedding").alias("embedding", metadata=kind)).write.partitionBy("node_type").parquet(path)


def read_node_index(spark: SparkSession, path: str, *, metric: str = "l2", encoder: str = "hash", dim: int | None = None) -> DataFrame:
    """The index at ``path``; one of another metric, encoder or length, or of none, is refused."""
    index = spark.read.parquet(path)
    found = index.schema["embedding"].metadata
    wanted = {"metric": metric, "encoder": encoder} | ({} if dim is None else {"dim": dim})
    wrong = [f"{k} is {found.get(k)}, not {v}" for k, v in wanted.items() if found.get(k) != v]
    if wrong:
        raise ValueError(f"the index at {path} does not fit: {'; '.join(wrong)}")
    return index


def write_report(path: str, **tables: DataFrame) -> None:
    """Write each named result as JSON below ``path``, small ones as one file."""
    for name, table in tables.items():
        (table.coalesce(1) if small_enough(table, SMALL_REPORT) else table).write.json(f"{path}/{name}")


def delta_markdown(deltas: DataFrame) -> str:
    """A table of ``deltas(metric, base, other, delta)``, one row a metric."""
    rows = [f"| {r['metric']} | {r['base']:.4f} | {r['other']:.4f} | {r['delta']:+.4f} |" for r in deltas.orderBy("metric").collect()]
    return "\n".join(["| metric | base | other | delta |", "|---|---|---|---|", *rows])
