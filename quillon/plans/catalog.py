"""Every registered query with its SQL counterpart.

Roles of the tables: terms come from ``benchmark`` (name: words 1-3, synonym: words
4-5), the ontology from ``part``, annotations from ``lineitem``, scored candidates
from ``lineitem`` by order, cases from ``orders``, the graph from orders and parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectorised import hash_embed
from ..operators import ensemble, fusion, graph, ic, match, merge, metrics, ontology, prompts, vectors
from ..sources import ontology as sources
from .shared import BROADCAST_BYTES, BROADCAST_KEYS, broadcast_if, write_shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_BLANK = f"'{T.BLANK}'"
WORD = r"[\p{L}\p{M}\p{N}_/-]+"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---------------------------------------------------------------- bindings


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to annotate; a table of fewer splits than cores is dealt over the cores, as matching is work for the processor."""
    docs, cores = _t(spark, sf, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    return docs if docs.rdd.getNumPartitions() >= cores else docs.repartition(cores, "doc_id")


def _terms(spark, sf) -> DataFrame:
    b = _t(spark, sf, "benchmark").select("item_id", T.tokenize(F.col("text")).alias("w"))
    phrase = lambda i, n: F.array_join(T.trim_stopwords(F.slice("w", i, n), T.DICT_STOPWORDS), " ")
    syn = phrase(4, 2)
    return b.select(F.col("item_id").alias("term_id"), phrase(1, 3).alias("name"), F.when(F.col("item_id") % 3 == 0, "molecular_function").when(F.col("item_id") % 3 == 1, "cellular_component").otherwise("biological_process").alias("namespace"), F.lit("").alias("definition"), F.when(syn != "", F.array(syn)).otherwise(F.array().cast("array<string>")).alias("synonyms"), F.array().cast("array<string>").alias("alt_ids"), F.col("item_id").alias("ord")).where("name <> ''")


_STOP = "['" + "','".join(T.DICT_STOPWORDS) + "']"
_TRIM = f"list_slice(w, coalesce(list_min([i for i in range(1, len(w) + 1) if NOT list_contains({_STOP}, w[i])]), 1), coalesce(list_max([i for i in range(1, len(w) + 1) if NOT list_contains({_STOP}, w[i])]), 0))"
SQL_TERMS = f"""
tw AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS a FROM benchmark),
tn AS (SELECT item_id, 0 AS pos, a[1:3] AS w FROM tw UNION ALL SELECT item_id, 1, a[4:5] FROM tw),
ta AS (SELECT item_id AS term_id, pos, array_to_string({_TRIM}, ' ') AS name FROM tn),
terms AS (SELECT * FROM ta WHERE name <> '' AND term_id IN (SELECT term_id FROM ta WHERE pos = 0 AND name <> ''))"""


def _nodes(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").select(F.col("p_partkey").alias("term_id"), F.col("p_type").alias("namespace"), F.col("p_name").alias("name"))


def _edges(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    p = _t(spark, sf, "part").where("p_partkey >= 3").select(k.alias("child"), F.array(F.expr("(p_partkey - 3) div 3"), F.when(k % 4 == 0, F.expr("(p_partkey - 3) div 4"))).alias("ps"))
    p = p.select("child", F.explode(F.array_distinct(F.filter("ps", lambda x: x.isNotNull()))).alias("parent"))
    return ontology.edges_inside(p, _nodes(spark, sf), "parent").select("child", "parent")


SQL_DAG = """
nodes AS (SELECT p_partkey AS term_id, p_type AS namespace FROM part),
edges AS (SELECT DISTINCT child, parent FROM (SELECT p_partkey AS child, (p_partkey - 3) // 3 AS parent FROM part WHERE p_partkey >= 3
          UNION ALL SELECT p_partkey, (p_partkey - 3) // 4 FROM part WHERE p_partkey >= 3 AND p_partkey % 4 = 0) WHERE parent IN (SELECT term_id FROM nodes)),
walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS dist FROM edges
         UNION SELECT w.ancestor, e.child, w.dist + 1 FROM walk w JOIN edges e ON e.parent = w.descendant),
clo AS (SELECT ancestor, descendant, min(dist)::INT AS dist FROM walk GROUP BY ALL),
dep AS (SELECT n.term_id, coalesce(min(CASE WHEN c.ancestor IN (0, 1, 2) THEN c.dist END), 0)::INT AS depth FROM nodes n LEFT JOIN clo c ON c.descendant = n.term_id AND n.term_id > 2 GROUP BY n.term_id)"""


def _closure(spark, sf) -> DataFrame:
    return write_shared(ontology.closure(_edges(spark, sf)), "closure")


def _labels(spark, sf) -> DataFrame:
    return write_shared(ontology.reach_labels(_nodes(spark, sf), _edges(spark, sf)), "labels")


def _depths(spark, sf) -> DataFrame:
    return ontology.node_depths(_nodes(spark, sf), _edges(spark, sf), [0, 1, 2])


def _annotations(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("gene"), F.col("l_partkey").alias("term_id"))


def _candidates(spark, sf) -> DataFrame:
    """(doc_id, pos, term_id, score, source, match_type, span, start, end)"""
    m = F.col("l_linenumber") % 3
    start = F.when(m == 0, F.col("l_linenumber") * 10).otherwise(-1)
    return _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 40).alias("term_id"), F.round(1 - F.col("l_discount") * 5, 4).alias("score"),
        F.when(m == 0, "dict").when(m == 1, "vector").otherwise("llm").alias("source"), F.when(F.col("l_returnflag") == "A", "exact").otherwise("fuzzy").alias("match_type"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("span"), start.alias("start"), (start + 5).alias("end"),
    )


SQL_CAND = """cand AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, l_partkey % 40 AS term_id, round(1 - l_discount * 5, 4) AS score,
  CASE l_linenumber % 3 WHEN 0 THEN 'dict' WHEN 1 THEN 'vector' ELSE 'llm' END AS source, CASE WHEN l_returnflag = 'A' THEN 'exact' ELSE 'fuzzy' END AS match_type FROM lineitem)"""


def _cases(spark, sf) -> DataFrame:
    return _t(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("lang"), F.col("o_orderpriority").alias("difficulty"))


def _gold(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("term_id"))


def _predictions(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    a = li.where("l_linenumber % 2 = 1").select(F.lit("odd").alias("method"), F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("term_id"))
    b = li.where("l_discount < 0.05").select(F.lit("cheap").alias("method"), F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("term_id"))
    return a.unionByName(b)


def _scored(spark, sf) -> DataFrame:
    methods = spark.createDataFrame([("odd",), ("cheap",)], "method string")
    return metrics.score_cases(_predictions(spark, sf), _gold(spark, sf), _cases(spark, sf), methods)


SQL_SCORED = """
cases AS (SELECT o_orderkey AS case_id, o_orderstatus AS lang, o_orderpriority AS difficulty FROM orders),
gold AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS term_id FROM lineitem WHERE l_quantity > 30),
pred AS (SELECT DISTINCT 'odd' AS method, l_orderkey AS case_id, l_partkey AS term_id FROM lineitem WHERE l_linenumber % 2 = 1
         UNION SELECT DISTINCT 'cheap', l_orderkey, l_partkey FROM lineitem WHERE l_discount < 0.05),
grid AS (SELECT m.method, c.* FROM cases c, (VALUES ('odd'), ('cheap')) m(method)),
np AS (SELECT method, case_id, count(*) AS n FROM pred GROUP BY ALL), ng AS (SELECT case_id, count(*) AS n FROM gold GROUP BY ALL),
nt AS (SELECT method, case_id, count(*) AS n FROM pred JOIN gold USING (case_id, term_id) GROUP BY ALL),
scored AS (SELECT g.method, g.case_id, lang, difficulty, coalesce(nt.n, 0) AS tp, coalesce(np.n, 0) - coalesce(nt.n, 0) AS fp, coalesce(ng.n, 0) - coalesce(nt.n, 0) AS fn
  FROM grid g LEFT JOIN np USING (method, case_id) LEFT JOIN nt USING (method, case_id) LEFT JOIN ng USING (case_id))"""
_P, _R = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
_F = f"CASE WHEN ({_P}) + ({_R}) > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0.0 END"
SQL_PRF = f"round({_P}, 4) AS precision, round({_R}, 4) AS recall, round({_F}, 4) AS f1"


def _graph_edges(spark, sf, distinct: bool = True) -> DataFrame:
    o, li = _t(spark, sf, "orders"), _t(spark, sf, "lineitem")
    e = lambda df, a, at, b, bt, r: df.select(F.col(a).cast("string").alias("src"), F.lit(at).alias("src_type"), F.col(b).cast("string").alias("dst"), F.lit(bt).alias("dst_type"), F.lit(r).alias("relationship"))
    terms = _edges(spark, sf).select(F.col("child").alias("c"), F.col("parent").alias("p"))
    rows = e(li, "l_suppkey", "Gene", "l_partkey", "GO_Term", "mention").unionByName(e(li, "l_partkey", "GO_Term", "l_orderkey", "PMID", "literature")).unionByName(e(o, "o_custkey", "RTO_Term", "o_orderkey", "GO_Term", "trait")).unionByName(e(terms, "c", "GO_Term", "p", "GO_Term", "is_a"))
    return rows.distinct() if distinct else rows


SQL_EDGES = """ge AS (SELECT DISTINCT * FROM (
  SELECT l_suppkey::VARCHAR AS src, 'Gene' AS src_type, l_partkey::VARCHAR AS dst, 'GO_Term' AS dst_type, 'mention' AS relationship FROM lineitem
  UNION ALL SELECT l_partkey::VARCHAR, 'GO_Term', l_orderkey::VARCHAR, 'PMID', 'literature' FROM lineitem
  UNION ALL SELECT o_custkey::VARCHAR, 'RTO_Term', o_orderkey::VARCHAR, 'GO_Term', 'trait' FROM orders
  UNION ALL SELECT child::VARCHAR, 'GO_Term', parent::VARCHAR, 'GO_Term', 'is_a' FROM edges))"""


def _seeds(spark, sf) -> DataFrame:
    return _t(spark, sf, "part").where("p_size <= 10").select((F.col("p_partkey") % 7).alias("query_id"), F.col("p_partkey").cast("string").alias("term_id"))


SQL_SEEDS = "seeds AS (SELECT DISTINCT p_partkey % 7 AS query_id, p_partkey::VARCHAR AS term_id FROM part WHERE p_size <= 10)"

# ---------------------------------------------------------------- text


@query("SELECT doc_id, CASE WHEN length(text) - length(regexp_replace(text, '[\\x{4e00}-\\x{9fff}]', '', 'g')) > 0.1 * length(text) THEN 'zh' ELSE 'en' END AS detected FROM documents")
def text_detect_lang(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", T.detect_lang(F.col("text")).alias("detected"))


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '{WORD}'))::INT AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{WORD}')))::INT AS n_distinct FROM documents")
def text_tokens(spark, sf):
    w = T.tokenize(F.col("text"))
    return _t(spark, sf, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.size(F.array_distinct(w)).alias("n_distinct"))


_PARTS = rf"""parts AS (SELECT doc_id, i, parts[i] AS x, coalesce(list_sum([length(p) + 1 for p in parts[1:i-1]]), 0)::BIGINT AS b FROM (
 SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[.;\n]') AS parts FROM documents))),
sents AS (SELECT doc_id, trim(x, {_BLANK}) AS sentence, b + length(x) - length(ltrim(x, {_BLANK})) AS st, b + length(x) - length(ltrim(x, {_BLANK})) + length(trim(x, {_BLANK})) AS en FROM parts WHERE length(trim(x, {_BLANK})) >= 6)"""


@query(f"WITH {_PARTS} SELECT DISTINCT doc_id, sentence FROM sents")
def text_sentences(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("sentence"))


@query(f'WITH {_PARTS} SELECT doc_id, sentence, st::INT AS start, en::INT AS "end" FROM sents')
def text_sentence_spans(spark, sf):
    return match.sentence_table(_t(spark, sf, "documents"))


@query(r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace('GO ID ' || coalesce(text, '') || ' go:0006281.', '(?i)\bGO\s*ID\b', '', 'g'), '(?i)\bGO:\d{7}\b', '', 'g')) AS clean_md5 FROM conversations")
def text_sanitize(spark, sf):
    dirty = F.concat(F.lit("GO ID "), F.coalesce("text", F.lit("")), F.lit(" go:0006281."))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.md5(T.sanitize_answer(dirty)).alias("clean_md5"))


@query("SELECT conv_id, turn, ['GO:' || lpad((conv_id % 40)::VARCHAR, 7, '0'), 'GO:0000007'] AS ids FROM conversations")
def text_extract_ids(spark, sf):
    dirty = F.concat(F.lit("go:"), F.lpad((F.col("conv_id") % 40).cast("string"), 7, "0"), F.lit(" and GO:0000007, not GO:12 or xGO:1234567 "))
    return _t(spark, sf, "conversations").select("conv_id", "turn", T.extract_ids(dirty).alias("ids"))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, 'GO:' || l_partkey AS go_id, round(l_discount, 2) AS confidence FROM lineitem WHERE l_linenumber % 4 <> 3")
def text_parse_answers(spark, sf):
    li = _t(spark, sf, "lineitem")
    body = F.to_json(F.array(F.struct(F.concat(F.lit("GO:"), F.col("l_partkey").cast("string")).alias("go_id"), F.lit("x").alias("span"), F.round("l_discount", 2).alias("confidence"))))
    content = F.when(F.col("l_linenumber") % 4 == 3, "none").otherwise(F.concat(F.lit("<think>[a]</think> Here: "), body))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), F.explode(T.parse_choices(content)).alias("c")).select("doc_id", "line", "c.go_id", "c.confidence")


@query("SELECT p_partkey, concat_ws(chr(10), 'Name: ' || p_name, 'GO ID: ' || p_partkey, 'Namespace: ' || p_type) AS node_text, concat_ws('. ', trim(p_name), 'Synonyms: ' || trim(p_brand), trim(p_type)) AS term_text FROM part")
def text_node_and_term(spark, sf):
    p = _t(spark, sf, "part")
    return p.select("p_partkey", T.node_text(("Name", F.col("p_name")), ("GO ID", F.col("p_partkey").cast("string")), ("Namespace", F.col("p_type")), ("Synonyms", F.lit(""))).alias("node_text"), T.term_text(F.col("p_name"), F.array("p_brand", F.lit(" ")), F.col("p_type")).alias("term_text"))


_NGRAM_STOP, _GENERAL = ("['" + "','".join(x) + "']" for x in (T.NGRAM_STOPWORDS, T.GENERIC_WORDS))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD.replace("/", "")}') AS w FROM documents),
s AS (SELECT doc_id, w, [NOT list_contains({_NGRAM_STOP}, y) for y in w] AS ok FROM t),
x AS ({" UNION ALL ".join(f"SELECT doc_id, {m} AS n, unnest([array_to_string(w[i:i + {m - 1}], ' ') for i in range(1, len(w) - {m - 2}) if ok[i] AND ok[i + {m - 1}]]) AS phrase FROM s" for m in range(1, 6))}),
d AS (SELECT DISTINCT doc_id, n, phrase FROM x WHERE length(phrase) >= 3 AND NOT list_contains({_GENERAL}, phrase)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, phrase)::INT AS rank FROM d)
SELECT doc_id, rank, phrase FROM r WHERE rank <= 80""")
def text_candidate_phrases(spark, sf):
    return match.candidate_phrases(_docs(spark, sf))


# ---------------------------------------------------------------- matching


@query(f"WITH {SQL_TERMS} SELECT name AS name_lc, arg_min(term_id, term_id * 10 + pos) AS term_id, arg_min(pos = 0, term_id * 10 + pos) OR bool_or(pos = 0 AND term_id = (SELECT min(x.term_id) FROM terms x WHERE x.name = terms.name)) AS is_primary FROM terms GROUP BY name")
def name_index(spark, sf):
    return match.name_index(_terms(spark, sf)).select("name_lc", "term_id", "is_primary")


@query(f"WITH {SQL_TERMS} SELECT name AS name_lc, max(CASE WHEN pos = 0 THEN term_id END) AS name_id, max(CASE WHEN pos = 1 THEN term_id END) AS synonym_id FROM terms GROUP BY name")
def name_lookup_last_wins(spark, sf):
    return match.name_lookup_last_wins(_terms(spark, sf))


_SQL_DOCS_OF_NAMES = f"""WITH {SQL_TERMS}, n AS (SELECT name, min(term_id) AS term_id FROM terms GROUP BY name),
d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') || ' ' AS t FROM documents),
h AS (SELECT DISTINCT doc_id, name, term_id FROM d JOIN n ON contains(t, ' ' || name || ' '))"""


@query(_SQL_DOCS_OF_NAMES + " SELECT doc_id, name AS name_lc, term_id FROM h")
def match_exact_names(spark, sf):
    docs, names = _docs(spark, sf), match.name_index(_terms(spark, sf))
    return match.docs_of_names(docs, names, 8, T.DICT_STOPWORDS)


@query(_SQL_DOCS_OF_NAMES + " SELECT term_id, count(DISTINCT doc_id) AS n_docs FROM h GROUP BY term_id")
def annotate_doc_counts(spark, sf):
    return match_exact_names(spark, sf).groupBy("term_id").agg(F.countDistinct("doc_id").alias("n_docs"))


@query()
def annotate_ngram(spark, sf):
    return match.annotate_ngram(_docs(spark, sf), _terms(spark, sf))


@query()
def annotate_dictionary(spark, sf):
    return match.annotate_dictionary(_docs(spark, sf), _terms(spark, sf))


@query()
def annotate_ensemble(spark, sf):
    terms, docs = _terms(spark, sf), _docs(spark, sf)
    items = hash_embed(terms.select(F.col("term_id").alias("node_id"), "name"), "node_id", "name")
    told = docs.select("doc_id", (F.col("doc_id") % 40).alias("term_id"), F.array_join(F.slice(T.tokenize(F.col("text")), 1, 2), " ").alias("span"), (0.3 + F.col("doc_id") % 7 / 10).alias("confidence"))
    return ensemble.annotate_ensemble(docs, terms, items, lambda df, k, t: hash_embed(df, k, t), told, fusion.PRESETS["recall"]).select("doc_id", "term_id", "span", "start", "end", "match_type", "source", "score")


@query()
def normalize_terms(spark, sf):
    terms = _terms(spark, sf)
    turns = _t(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    mentions = match.phrase_windows(turns, 3, T.DICT_STOPWORDS).select(F.array_join("words", " ").alias("mention")).distinct().unionByName(terms.select(F.concat("name", F.lit("s")).alias("mention")))
    named = terms.select("term_id", "name")
    alias = sources.term_alias(terms).withColumn("any_id", F.col("any_id").cast("string"))
    return match.score_normalized(match.normalize_terms(mentions, terms, alias=alias).join(named, "term_id", "left")).select("mention", "term_id", "how", "match_type", F.round("confidence", 4).alias("confidence"))


@query(f"""WITH {_PARTS}, h AS (SELECT doc_id, 0 AS s, length(text) // 3 AS e FROM documents)
SELECT doc_id, count(*) AS n, sum(st)::BIGINT AS starts FROM sents JOIN h USING (doc_id) WHERE greatest(0, least(en, e) - greatest(st, s)) <= 0.6 * (en - st) GROUP BY doc_id""")
def uncovered_sentences(spark, sf):
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    hits = docs.select("doc_id", F.lit(0).alias("start"), F.expr("length(text) div 3").alias("end"))
    return match.uncovered_sentences(docs, hits).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("starts"))


@query(f"""WITH {SQL_CAND}, c AS (SELECT doc_id, term_id, max(score) AS score FROM cand WHERE source = 'dict' GROUP BY ALL),
m AS (SELECT doc_id, term_id, arg_min(score, pos * 1000 - score) AS confidence FROM cand WHERE source = 'llm' GROUP BY ALL)
SELECT doc_id, term_id, greatest(0.0, least(1.0, confidence)) AS confidence FROM m JOIN c USING (doc_id, term_id)""")
def gate_to_candidates(spark, sf):
    c = _candidates(spark, sf)
    offered = c.where("source = 'dict'").groupBy("doc_id", "term_id").agg(F.max("score").alias("score"))
    return match.gate_to_candidates(c.where("source = 'llm'").select("doc_id", "term_id", "pos", F.col("score").alias("confidence")), offered)


# ---------------------------------------------------------------- ontology


@query(f"WITH RECURSIVE {SQL_DAG} SELECT * FROM clo")
def dag_closure(spark, sf):
    return ontology.closure(_edges(spark, sf))


@query(f"WITH RECURSIVE {SQL_DAG} SELECT * FROM dep")
def dag_depths(spark, sf):
    return _depths(spark, sf)


@query(f"WITH RECURSIVE {SQL_DAG} SELECT term_id, count(c.ancestor) AS n_descendants FROM nodes LEFT JOIN clo c ON ancestor = term_id GROUP BY term_id")
def dag_descendant_counts(spark, sf):
    return ontology.descendant_counts(_nodes(spark, sf), ontology.closure(_edges(spark, sf)))


@query(f"WITH RECURSIVE {SQL_DAG} SELECT term_id FROM nodes WHERE term_id NOT IN (SELECT parent FROM edges)")
def dag_leaves(spark, sf):
    return ontology.leaves(_nodes(spark, sf), _edges(spark, sf))


@query(f"WITH RECURSIVE {SQL_DAG} SELECT descendant AS term_id, ancestor, depth, row_number() OVER (PARTITION BY descendant ORDER BY depth, ancestor)::INT AS rank FROM clo JOIN dep ON dep.term_id = ancestor")
def dag_ancestors(spark, sf):
    return ontology.ancestors(_nodes(spark, sf).select("term_id"), _closure(spark, sf), _depths(spark, sf))


@query(f"WITH RECURSIVE {SQL_DAG} SELECT l_orderkey % 500 AS a, l_partkey AS b FROM lineitem SEMI JOIN clo ON ancestor = l_orderkey % 500 AND descendant = l_partkey")
def dag_ancestor_pairs(spark, sf):
    rows = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), F.col("l_partkey").alias("b"))
    return ontology.ancestor_pairs(rows, _closure(spark, sf))


@query(f"WITH RECURSIVE {SQL_DAG} SELECT l_orderkey % 500 AS a, l_partkey AS b FROM lineitem SEMI JOIN clo ON ancestor = l_orderkey % 500 AND descendant = l_partkey")
def dag_label_pairs(spark, sf):
    rows = _t(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("a"), F.col("l_partkey").alias("b"))
    return ontology.label_pairs(rows, _labels(spark, sf))


@query(f"WITH RECURSIVE {SQL_DAG}, up AS (SELECT descendant, arg_min(ancestor, dist * 1000000 + ancestor) AS near FROM clo JOIN dep ON dep.term_id = ancestor WHERE depth <= 3 GROUP BY descendant) SELECT dep.term_id, CASE WHEN depth <= 3 THEN dep.term_id ELSE coalesce(near, dep.term_id) END AS best FROM dep LEFT JOIN up ON descendant = dep.term_id")
def dag_best_ancestor(spark, sf):
    return ontology.best_ancestor(_nodes(spark, sf).select("term_id"), _closure(spark, sf), _depths(spark, sf), max_depth=3)


@query(f"WITH RECURSIVE {SQL_DAG} SELECT 'namespace' AS kind, namespace AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'depth', depth::VARCHAR, count(*) FROM dep GROUP BY 2")
def dag_stats(spark, sf):
    return ontology.dag_stats(_nodes(spark, sf), _depths(spark, sf))


_IC_S = "ics AS (SELECT n.term_id, round(-log2((count(c.ancestor) + 1) / (2 * (SELECT count(*) FROM nodes))), 6) AS ic FROM nodes n LEFT JOIN clo c ON c.ancestor = n.term_id GROUP BY n.term_id)"
_IC_A = """own AS (SELECT DISTINCT l_partkey AS term_id, l_suppkey AS gene FROM lineitem WHERE l_partkey IN (SELECT term_id FROM nodes)),
prop AS (SELECT term_id, gene FROM own UNION SELECT ancestor, gene FROM own JOIN clo ON descendant = own.term_id),
cnt AS (SELECT n.term_id, count(gene) AS n_genes FROM nodes n LEFT JOIN prop USING (term_id) GROUP BY n.term_id),
ica AS (SELECT term_id, round(-log2((n_genes + 1) / ((SELECT count(DISTINCT gene) FROM own) + (SELECT count(*) FROM nodes))), 6) AS ic FROM cnt)"""


@query(f"WITH RECURSIVE {SQL_DAG}, {_IC_S} SELECT * FROM ics")
def ic_structural(spark, sf):
    return ic.ic_structural(_nodes(spark, sf), ontology.closure(_edges(spark, sf))).withColumn("ic", F.round("ic", 6))


@query(f"WITH RECURSIVE {SQL_DAG}, {_IC_A} SELECT * FROM ica")
def ic_annotation(spark, sf):
    return ic.ic_annotation(_nodes(spark, sf), _closure(spark, sf), _annotations(spark, sf)).withColumn("ic", F.round("ic", 6))


@query(f"WITH RECURSIVE {SQL_DAG}, {_IC_S}, {_IC_A} SELECT term_id, ics.ic AS ic_structural, ica.ic AS ic_annotation, n_genes FROM ics JOIN ica USING (term_id) JOIN cnt USING (term_id)")
def ic_compare(spark, sf):
    n, c, a = _nodes(spark, sf), _closure(spark, sf), _annotations(spark, sf)
    r = lambda df: df.withColumn("ic", F.round("ic", 6))
    counts = write_shared(ic.annotation_counts(n, c, a), "gene-counts")
    return ic.compare_ic(r(ic.ic_structural(n, c)), r(ic.ic_annotation(n, c, a, counts=counts)), counts)


@query(f"WITH RECURSIVE {SQL_DAG}, {_IC_A} SELECT term_id, count(*) AS n_genes FROM prop GROUP BY term_id")
def propagate_annotations(spark, sf):
    known = _annotations(spark, sf).join(_nodes(spark, sf).select("term_id"), "term_id", "left_semi")
    return ic.propagated_counts(known, _closure(spark, sf))


def _selected(spark, sf, closure: DataFrame | None = None) -> DataFrame:
    n, e = _nodes(spark, sf), _edges(spark, sf)
    c = _closure(spark, sf) if closure is None else closure
    return write_shared(ic.select_by_ic(n, e, c, ontology.depths_below(n, c, [0, 1, 2]), ic.ic_structural(n, c), min_depth=1, min_descendants=2, ic_max=20.0), "selected")


@query()
def select_by_ic(spark, sf):
    return _selected(spark, sf)


@query()
def select_static(spark, sf):
    n, c = _nodes(spark, sf), _closure(spark, sf)
    return ic.select_static(n, _edges(spark, sf), c, ontology.depths_below(n, c, [0, 1, 2]), min_depth=1, min_descendants=2)


@query()
def compressed_terms(spark, sf):
    return ic.compressed_terms(_nodes(spark, sf), _selected(spark, sf))


@query()
def top_by_ic(spark, sf):
    n, c = _nodes(spark, sf), _closure(spark, sf)
    return ic.top_by_ic(_selected(spark, sf, c), ic.ic_structural(n, c))


@query()
def rep_members(spark, sf):
    c = _closure(spark, sf)
    return ic.rep_members(c, _selected(spark, sf, c))


# ---------------------------------------------------------------- fusion and merge


@query(f"WITH {SQL_CAND} SELECT doc_id, term_id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, term_id ORDER BY score DESC, pos) AS k FROM cand) WHERE k = 1")
def best_per_term(spark, sf):
    return fusion.best_per_term(_candidates(spark, sf)).select("doc_id", "term_id", "score", "pos")


_FUSED = """f AS (SELECT doc_id, term_id, max(CASE WHEN source = 'dict' THEN score END) AS d, max(CASE WHEN source = 'vector' THEN score END) AS v, max(CASE WHEN source = 'llm' THEN score END) AS l, bool_or(match_type = 'exact') AS ex FROM cand GROUP BY ALL),
g AS (SELECT *, least(1.0, (coalesce(d * 0.6::DOUBLE, 0) + coalesce(v * 0.25::DOUBLE, 0) + coalesce(l * 0.15::DOUBLE, 0)) / greatest(CASE WHEN d IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN v IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN l IS NULL THEN 0 ELSE 0.15::DOUBLE END, 1e-8)
  + greatest((d IS NOT NULL)::INT + (v IS NOT NULL)::INT + (l IS NOT NULL)::INT - 1, 0) * 0.05::DOUBLE) AS fused FROM f)"""


@query(f"WITH {SQL_CAND}, {_FUSED} SELECT doc_id, term_id, round(fused, 3) AS score, concat_ws('+', CASE WHEN d IS NOT NULL THEN 'dict' END, CASE WHEN l IS NOT NULL THEN 'llm' END, CASE WHEN v IS NOT NULL THEN 'vector' END) AS source FROM g WHERE (ex AND coalesce(d, 0) >= 0.95) OR fused >= 0.7")
def fuse_and_accept(spark, sf):
    p = fusion.PRESETS["balanced"]
    return fusion.accept_fused(fusion.fuse_sources(_candidates(spark, sf), p), p).select("doc_id", "term_id", "score", "source")


@query(f"""WITH {SQL_CAND}, a AS (SELECT doc_id, term_id, max(score) AS a FROM cand WHERE source = 'dict' GROUP BY ALL),
b AS (SELECT doc_id, term_id, max(score) AS b FROM cand WHERE source = 'llm' AND score >= 0.55 GROUP BY ALL)
SELECT doc_id, term_id, greatest(a, b) AS score, concat_ws('+', CASE WHEN a IS NOT NULL THEN 'nltk' END, CASE WHEN b IS NOT NULL THEN 'llm' END) AS source FROM a FULL JOIN b USING (doc_id, term_id)""")
def merge_two_sources(spark, sf):
    c = _candidates(spark, sf)
    return fusion.merge_two_sources(c.where("source = 'dict'"), c.where("source = 'llm'").withColumnRenamed("score", "confidence"))


@query(f"""WITH {SQL_CAND}, u AS (SELECT doc_id, term_id, score, source FROM cand WHERE source = 'dict' OR (source = 'vector' AND score >= 0.7)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term_id ORDER BY score DESC, source) AS k FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term_id)::INT AS rank FROM b WHERE k = 1)
SELECT doc_id, term_id, score, source, rank FROM r WHERE rank <= 12""")
def retrieve_candidates(spark, sf):
    c = _candidates(spark, sf)
    return fusion.retrieve_candidates(c.where("source = 'dict'"), c.where("source = 'vector'"))


def _sql_preset(name: str, p: fusion.Preset) -> str:
    w = (("d", p.weight_dict), ("v", p.weight_vector), ("l", p.weight_llm))
    top = " + ".join(f"coalesce({c} * {x}::DOUBLE, 0)" for c, x in w)
    low = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {x}::DOUBLE END" for c, x in w)
    n = " + ".join(f"({c} IS NOT NULL)::INT" for c, _ in w)
    return f"""SELECT '{name}' AS preset, count(*) AS n FROM (SELECT d, ex, {n} AS k, least(1.0, ({top}) / greatest({low}, 1e-8) + greatest({n} - 1, 0) * {p.consensus_bonus}::DOUBLE) AS fused FROM (
 SELECT doc_id, term_id, max(CASE WHEN source = 'dict' THEN score END) AS d, max(CASE WHEN source = 'vector' THEN score END) AS v, max(CASE WHEN source = 'llm' THEN score END) AS l, bool_or(match_type = 'exact') AS ex FROM cand
 WHERE source = 'dict' OR (source = 'vector' AND score >= {p.vector_threshold}) OR (source = 'llm' AND score >= {p.llm_threshold}) GROUP BY ALL)) WHERE (ex AND coalesce(d, 0) >= 0.95) OR (fused >= {p.final_threshold} AND k >= {p.min_consensus})"""


@query(f"WITH {SQL_CAND} " + " UNION ALL ".join(_sql_preset(k, v) for k, v in fusion.PRESETS.items()))
def preset_sweep(spark, sf):
    return fusion.preset_sweep(_candidates(spark, sf)).groupBy("preset").agg(F.count("*").alias("n"))


def _merge_input(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(documents, candidates); terms meet the candidates by broadcast only if they are few."""
    docs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat_ws(" ", "o_orderpriority", F.lit("dna repair and translation")).alias("text"))
    k = F.col("term_id")
    n = _nodes(spark, sf).withColumn("namespace", F.when(k % 3 == 0, "molecular_function").when(k % 3 == 1, "cellular_component").otherwise("biological_process"))
    c = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term_id"), F.col("l_linenumber").alias("pos"), F.round(1 - F.col("l_discount") * 5, 4).alias("score"), F.lit("").alias("span")).join(broadcast_if(n, BROADCAST_KEYS, BROADCAST_BYTES), "term_id")
    return docs, c


def _merge_ontology(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(labels, depths) of one closure."""
    nodes, edges = _nodes(spark, sf), write_shared(_edges(spark, sf), "edges")
    reach = ontology.closure(edges)
    return write_shared(ontology.reach_labels(nodes, edges, reach), "labels"), ontology.depths_below(nodes, reach, [0, 1, 2])


@query()
def merge_terms(spark, sf):
    docs, c = _merge_input(spark, sf)
    return merge.merge_terms(docs, c, *_merge_ontology(spark, sf))


@query()
def merge_ids(spark, sf):
    docs, c = _merge_input(spark, sf)
    return merge.merge_ids(docs, c.select("doc_id", "term_id"), c.select("term_id", "name", "namespace").distinct(), *_merge_ontology(spark, sf))


@query(f"WITH {SQL_CAND}, b AS (SELECT doc_id, term_id, CASE term_id % 2 WHEN 0 THEN 'biological_process' ELSE 'molecular_function' END AS namespace, max(score) AS final FROM cand GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, namespace ORDER BY final DESC, term_id) AS k FROM b) SELECT doc_id, namespace, term_id, final FROM r WHERE k <= CASE namespace WHEN 'biological_process' THEN 2 ELSE 1 END")
def limit_per_namespace(spark, sf):
    b = _candidates(spark, sf).withColumn("namespace", F.when(F.col("term_id") % 2 == 0, "biological_process").otherwise("molecular_function")).groupBy("doc_id", "term_id", "namespace").agg(F.max("score").alias("final"))
    return merge.limit_per_namespace(b)


# ---------------------------------------------------------------- vectors


def _items(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")


def _questions(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


_PAIRS = "v AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS e FROM embeddings)"


@query(f"WITH {_PAIRS}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS node_id, list_dot_product(q.e, i.e) AS s FROM v q, v i WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(-s, 6), node_id)::INT AS rank FROM s) SELECT query_id, node_id, round(s, 4) AS similarity, rank FROM r WHERE rank <= 5")
def topk_cosine(spark, sf):
    return vectors.topk_cosine(_questions(spark, sf), _items(spark, sf), 5)


@query(f"WITH {_PAIRS}, s AS (SELECT q.vec_id AS query_id, i.vec_id AS node_id, list_distance(q.e, i.e) ^ 2 AS s FROM v q, v i WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6), node_id)::INT AS rank FROM s) SELECT query_id, node_id, round(1 / (1 + s), 4) AS score, rank FROM r WHERE rank <= 5")
def topk_l2(spark, sf):
    return vectors.topk_l2(_questions(spark, sf), _items(spark, sf), 5)


def _reps(spark, sf) -> tuple[DataFrame, DataFrame]:
    v = _t(spark, sf, "embeddings")
    reps = v.groupBy("label").agg(F.min("vec_id").alias("rep_id"))
    return reps.select("rep_id"), v.join(reps, "label").where("vec_id <> rep_id").select("rep_id", F.col("vec_id").alias("member_id"))


@query(f"""WITH {_PAIRS}, reps AS (SELECT min(vec_id) AS rep_id, label FROM embeddings GROUP BY label),
c AS (SELECT q.vec_id AS query_id, rep_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, i.e) ^ 2, 6), rep_id) AS k FROM v q, reps JOIN v i ON i.vec_id = rep_id WHERE q.vec_id % 20 = 0),
pool AS (SELECT DISTINCT query_id, m.vec_id AS node_id FROM c JOIN reps r USING (rep_id) JOIN embeddings m ON m.label = r.label WHERE k <= 15),
s AS (SELECT query_id, node_id, list_distance(q.e, i.e) ^ 2 AS s FROM pool JOIN v q ON q.vec_id = query_id JOIN v i ON i.vec_id = node_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6), node_id)::INT AS rank FROM s) SELECT query_id, node_id, round(1 / (1 + s), 4) AS score, rank FROM r WHERE rank <= 5""")
def topk_two_stage(spark, sf):
    reps, members = _reps(spark, sf)
    return vectors.topk_two_stage(_questions(spark, sf), _items(spark, sf), reps, members, 5)


@query("WITH t AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(replace(lower(text), chr(10), ' '), ' ')) AS t FROM conversations), b AS (SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS b FROM t WHERE t <> ''), s AS (SELECT id, b % 256 AS slot, sum(CASE WHEN (b >> 1) & 1 = 0 THEN 1 ELSE -1 END) AS v FROM b GROUP BY ALL) SELECT id, count(*) AS n_slots, round(max(abs(v)) / sqrt(sum(v * v)), 4) AS top FROM s WHERE v <> 0 GROUP BY id")
def hash_embedding(spark, sf):
    c = _t(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    e = hash_embed(c, "id", "text")
    return e.select("id", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_slots"), F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x))).cast("double"), 4).alias("top")).where("n_slots > 0")


@query()
def annotate_vector(spark, sf):
    enc = lambda df, k, t: hash_embed(df, k, t)
    terms = _terms(spark, sf).select(F.col("term_id").alias("node_id"), "name")
    items = hash_embed(terms, "node_id", "name")
    docs = _t(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    return vectors.annotate_vector(docs, items, enc, threshold=0.3)


@query()
def annotate_hybrid(spark, sf):
    terms = _terms(spark, sf)
    docs = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    phrases = match.hybrid_phrases(docs)
    q = phrases.select("phrase").distinct().withColumn("query_id", F.xxhash64("phrase"))
    items = hash_embed(terms.select(F.col("term_id").alias("node_id"), "name"), "node_id", "name")
    hits = vectors.topk_cosine(hash_embed(q, "query_id", "phrase"), items, 5).join(q, "query_id").select("phrase", F.col("node_id").alias("term_id"), "similarity", "rank")
    return vectors.annotate_hybrid(phrases, match.name_lookup_last_wins(terms), terms, hits)


# ---------------------------------------------------------------- graph, prompts


@query(f"""WITH RECURSIVE {SQL_DAG}, {SQL_EDGES}, {SQL_SEEDS},
s AS (SELECT query_id, ge.* FROM ge JOIN seeds ON src = term_id), d AS (SELECT query_id, ge.* FROM ge JOIN seeds ON dst = term_id),
u AS (SELECT DISTINCT *, 80 AS lim, 1 AS p FROM (SELECT * FROM s UNION ALL SELECT * FROM d) WHERE src_type = 'GO_Term' AND dst_type = 'GO_Term'
  UNION ALL SELECT DISTINCT *, 30, 2 FROM d WHERE src_type = 'Gene' UNION ALL SELECT DISTINCT *, 20, 3 FROM s WHERE dst_type = 'PMID' UNION ALL SELECT DISTINCT *, 20, 4 FROM d WHERE src_type = 'RTO_Term'),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY src, dst, relationship) AS k FROM u)
SELECT query_id, src, src_type, dst, dst_type, relationship FROM r WHERE k <= lim""")
def graph_neighbourhood(spark, sf):
    return graph.graph_neighbourhood(_seeds(spark, sf), _graph_edges(spark, sf))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS query_id, o_orderkey::VARCHAR AS k FROM orders WHERE o_orderpriority LIKE '1%'),
f AS (SELECT DISTINCT query_id, l_partkey::VARCHAR AS term_id FROM p JOIN lineitem ON l_orderkey::VARCHAR = k),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term_id) AS n FROM f) SELECT query_id, term_id FROM r WHERE n <= 20""")
def seeds_from_papers(spark, sf):
    papers = _t(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("PMID:"), F.col("o_orderkey").cast("string")).alias("pmid"))
    return graph.seeds_from_papers(papers, _graph_edges(spark, sf))


@query(f"""WITH RECURSIVE {SQL_DAG}, {SQL_EDGES}, {SQL_SEEDS}, e AS (SELECT src, dst, relationship FROM ge WHERE src_type = 'GO_Term' AND dst_type = 'GO_Term' AND src <> dst),
b AS (SELECT *, src AS a, dst AS m FROM e UNION ALL SELECT *, dst, src FROM e), near AS (SELECT query_id, b.* FROM b JOIN seeds ON a = term_id),
direct AS (SELECT near.* FROM near JOIN seeds s ON s.query_id = near.query_id AND s.term_id = m), mids AS (SELECT query_id, m FROM near GROUP BY ALL HAVING count(DISTINCT a) > 1),
f AS (SELECT DISTINCT query_id, src, dst, relationship FROM (SELECT query_id, src, dst, relationship FROM direct UNION ALL SELECT query_id, src, dst, relationship FROM near JOIN mids USING (query_id, m) WHERE query_id NOT IN (SELECT query_id FROM direct))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, relationship) AS k FROM f) SELECT query_id, src, dst, relationship FROM r WHERE k <= 120""")
def two_hop_edges(spark, sf):
    return graph.two_hop_edges(_seeds(spark, sf), _graph_edges(spark, sf))


@query(f"""WITH RECURSIVE {SQL_DAG}, n AS (SELECT lpad(term_id::VARCHAR, 9, '0') AS node_id FROM nodes ORDER BY 1 LIMIT 200),
i AS (SELECT lpad(child::VARCHAR, 9, '0') AS src, lpad(parent::VARCHAR, 9, '0') AS dst FROM edges)
SELECT src, 'GO_Term' AS src_type, dst, 'GO_Term' AS dst_type, 'is_a' AS relationship FROM i WHERE src IN (SELECT node_id FROM n) AND dst IN (SELECT node_id FROM n) ORDER BY src, dst LIMIT 400""")
def limit_graph(spark, sf):
    padded = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    nodes = _nodes(spark, sf).select(padded("term_id").alias("node_id"))
    edges = _graph_edges(spark, sf).where("relationship = 'is_a'").withColumn("src", padded("src")).withColumn("dst", padded("dst"))
    return graph.limit_graph(nodes, edges)[1]


@query(f"""WITH RECURSIVE {SQL_DAG}, {SQL_EDGES},
papers AS (SELECT DISTINCT o_custkey AS query_id, o_orderkey::VARCHAR AS k FROM orders WHERE o_orderpriority LIKE '1%'),
mentions AS (SELECT DISTINCT query_id, l_partkey::VARCHAR AS term_id FROM papers JOIN lineitem ON l_orderkey::VARCHAR = k),
seeds AS (SELECT query_id, term_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term_id) AS k FROM mentions) WHERE k <= 20),
e AS (SELECT src, dst, relationship FROM ge WHERE src_type = 'GO_Term' AND dst_type = 'GO_Term' AND src <> dst),
b AS (SELECT *, src AS a, dst AS m FROM e UNION ALL SELECT *, dst, src FROM e), near AS (SELECT query_id, b.* FROM b JOIN seeds ON a = term_id),
direct AS (SELECT near.* FROM near JOIN seeds s ON s.query_id = near.query_id AND s.term_id = m), mids AS (SELECT query_id, m FROM near GROUP BY ALL HAVING count(DISTINCT a) > 1),
f AS (SELECT DISTINCT query_id, src, dst, relationship FROM (SELECT query_id, src, dst, relationship FROM direct UNION ALL SELECT query_id, src, dst, relationship FROM near JOIN mids USING (query_id, m) WHERE query_id NOT IN (SELECT query_id FROM direct))),
ways AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, dst, relationship) AS k FROM f),
s AS (SELECT query_id, ge.* FROM ge JOIN seeds ON src = term_id), d AS (SELECT query_id, ge.* FROM ge JOIN seeds ON dst = term_id),
u AS (SELECT DISTINCT *, 80 AS lim, 1 AS p FROM (SELECT * FROM s UNION ALL SELECT * FROM d) WHERE src_type = 'GO_Term' AND dst_type = 'GO_Term'
  UNION ALL SELECT DISTINCT *, 30, 2 FROM d WHERE src_type = 'Gene' UNION ALL SELECT DISTINCT *, 20, 3 FROM s WHERE dst_type = 'PMID' UNION ALL SELECT DISTINCT *, 20, 4 FROM d WHERE src_type = 'RTO_Term'),
around AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY src, dst, relationship) AS k FROM u)
SELECT query_id, src, 'GO_Term' AS src_type, dst, 'GO_Term' AS dst_type, relationship FROM ways WHERE k <= 120
UNION SELECT query_id, src, src_type, dst, dst_type, relationship FROM around WHERE k <= lim""")
def question_graph(spark, sf):
    papers = _t(spark, sf, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("pmid"))
    return graph.question_graph(papers, _graph_edges(spark, sf, distinct=False))


@query("""WITH h AS (SELECT o_orderkey AS query_id, string_agg(t, ' ; ' ORDER BY r) AS hints FROM (SELECT o_orderkey, l_partkey || ' ' || p_name AS t, row_number() OVER (PARTITION BY o_orderkey ORDER BY min(l_linenumber), l_partkey || ' ' || p_name) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE r <= 6 GROUP BY o_orderkey)
SELECT o_orderkey AS query_id, CASE WHEN hints IS NULL THEN o_orderpriority ELSE o_orderpriority || chr(10) || 'GO_HINTS: ' || hints END AS expanded FROM orders LEFT JOIN h ON query_id = o_orderkey""")
def expand_query(spark, sf):
    q = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("text"))
    h = _t(spark, sf, "lineitem").join(_t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("p_partkey").alias("term_id"), F.col("p_name").alias("name"))
    return prompts.expand_query(q, h)


def _ranked_nodes(spark, sf) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 4 == 0, "GO_Term").when(F.col("l_linenumber") % 4 == 1, "Gene").when(F.col("l_linenumber") % 4 == 2, "PMID").otherwise("Other")
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), kind.alias("node_type"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("description"), F.lit("ns").alias("namespace"))


@query(f"""WITH e AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '- [GO Term] Namespace: ns' || chr(10) || '  Description: ' || l_linestatus
 WHEN 1 THEN '- [Gene] Name: ' || l_returnflag || chr(10) || '  ' || l_linestatus WHEN 2 THEN '- [Literature] Title: ' || l_returnflag || chr(10) || '  ' || l_linestatus ELSE '- [Other] Name: ' || l_returnflag || chr(10) || '  Description: ' || l_linestatus END || chr(10) AS t FROM lineitem)
SELECT l_orderkey AS query_id, '{prompts.CONTEXT_HEAD.strip()}' || chr(10) || chr(10) || string_agg(t, chr(10) ORDER BY l_linenumber, t) AS context FROM e GROUP BY l_orderkey""")
def build_context(spark, sf):
    return prompts.build_context(_ranked_nodes(spark, sf))


_CHOOSE = {k: "'" + v.replace("\n", "' || chr(10) || '").replace("{text}", "' || text || '").replace("{list}", "' || block || '") + "'" for k, v in prompts.CHOOSE.items()}


@query(f"""WITH {SQL_CAND}, u AS (SELECT doc_id, term_id, score, source FROM cand WHERE source = 'dict' OR (source = 'vector' AND score >= 0.7)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, term_id ORDER BY score DESC, source) AS k FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term_id)::INT AS rank FROM b WHERE k = 1),
l AS (SELECT doc_id, string_agg(rank || '. ' || term_id || ' | ' || p_name || ' | ' || p_type || ' | source=' || source || ' | score=' || printf('%.3f', score) || ' | def=' || CASE WHEN length(trim(repeat(p_name || ' ', 20))) > 160 THEN trim(repeat(p_name || ' ', 20))[1:160] || '...' ELSE trim(repeat(p_name || ' ', 20)) END, chr(10) ORDER BY rank) AS block FROM r JOIN part ON p_partkey = term_id WHERE rank <= 12 GROUP BY doc_id)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_CHOOSE['zh']} ELSE {_CHOOSE['en']} END AS prompt FROM l JOIN (SELECT o_orderkey AS doc_id, o_orderpriority AS text FROM orders) USING (doc_id)""")
def build_prompts(spark, sf):
    docs = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("text"), F.when(F.col("o_orderkey") % 2 == 0, "zh").otherwise("en").alias("lang"))
    c = fusion.retrieve_candidates(_candidates(spark, sf).where("source = 'dict'"), _candidates(spark, sf).where("source = 'vector'"))
    n = _nodes(spark, sf).join(_candidates(spark, sf).select("term_id").distinct(), "term_id", "left_semi")
    n = n.withColumn("definition", F.repeat(F.concat("name", F.lit(" ")), 20))
    # Many candidates share few terms, which would meet in as few tasks.
    return prompts.build_prompts(docs, c.join(broadcast_if(n, 1 << 20, BROADCAST_BYTES), "term_id"))


@query("""SELECT 'GO_Term' AS node_type, p_partkey::VARCHAR AS node_id, concat_ws(chr(10), 'Name: ' || p_name, 'GO ID: ' || p_partkey, 'Namespace: ' || p_type, 'Description: ' || p_brand) AS text, 256 AS dim FROM part
UNION ALL SELECT 'Gene', 'Gene:' || s_suppkey, concat_ws(chr(10), 'Gene Name: ' || s_name, 'EntrezID: ' || s_suppkey), 256 FROM supplier
UNION ALL SELECT 'PMID', 'PMID:' || o_orderkey, concat_ws(chr(10), 'Title: ' || o_orderpriority, 'Journal: ' || o_orderstatus, 'Year: 1998'), 256 FROM orders
UNION ALL SELECT 'RTO_Term', 'RTO:' || c_custkey, concat_ws(chr(10), 'RTO Term: ' || c_name, 'RTO ID: RTO:' || c_custkey, 'Description: ' || c_mktsegment), 256 FROM customer""")
def build_node_index(spark, sf):
    p = _t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("go_id"), F.col("p_name").alias("name"), F.col("p_type").alias("namespace"), F.lit("").alias("synonyms"), F.col("p_brand").alias("description"), F.lit(None).cast("string").alias("comment"))
    s = _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("gene_id"), F.col("s_name").alias("name"), F.col("s_suppkey").cast("string").alias("entrez_id"))
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("pmid"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("journal"), F.lit("1998").alias("year"))
    c = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("rto_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"))
    index = vectors.build_node_index(sources.read_graph_nodes(p, s, o, c), lambda df, k, t: hash_embed(df, k, t))
    return index.select("node_type", "node_id", "text", F.size("embedding").alias("dim"))


# ---------------------------------------------------------------- metrics


@query(f"WITH {SQL_SCORED} SELECT * FROM scored")
def score_cases(spark, sf):
    return _scored(spark, sf)


@query(f"WITH {SQL_SCORED}, s AS (SELECT method, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM scored GROUP BY method) SELECT method, tp, fp, fn, {SQL_PRF} FROM s")
def micro_prf(spark, sf):
    return metrics.micro_prf(_scored(spark, sf))


@query(f"WITH {SQL_SCORED} SELECT method, round(avg({_P}), 4) AS precision, round(avg({_R}), 4) AS recall, round(avg({_F}), 4) AS f1 FROM scored GROUP BY method")
def macro_prf(spark, sf):
    return metrics.macro_prf(_scored(spark, sf))


@query(f"""WITH {SQL_SCORED}, s AS (SELECT method, lang, difficulty, grouping(lang) AS gl, grouping(difficulty) AS gd, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM scored GROUP BY GROUPING SETS ((method), (method, lang), (method, difficulty)))
SELECT method, CASE WHEN gl = 1 AND gd = 1 THEN 'all' WHEN gl = 0 THEN 'lang' ELSE 'difficulty' END AS "grouping", CASE WHEN gl = 0 THEN lang WHEN gd = 0 THEN difficulty END AS value, {SQL_PRF} FROM s""")
def prf_by_group(spark, sf):
    return metrics.prf_by_group(_scored(spark, sf))


#: The tables' order states and priorities, which stand for languages and difficulties.
_LANGS, _LEVELS = ("F", "O", "P"), ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"""WITH {SQL_SCORED}, s AS (SELECT method, lang, difficulty, grouping(lang) AS gl, grouping(difficulty) AS gd, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM scored GROUP BY GROUPING SETS ((method), (method, lang), (method, difficulty))),
x AS (SELECT method, CASE WHEN gl = 1 AND gd = 1 THEN 'all' WHEN gl = 0 THEN 'lang_' || lang ELSE 'difficulty_' || difficulty END AS c, {SQL_PRF} FROM s)
SELECT method, {', '.join(f"max(CASE WHEN c = '{c}' THEN f1 END) AS " + chr(34) + c + chr(34) for c in ('all', *('lang_' + x for x in _LANGS), *('difficulty_' + x for x in _LEVELS)))} FROM x GROUP BY method""")
def prf_wide(spark, sf):
    return metrics.prf_wide(_scored(spark, sf), _LANGS, _LEVELS)


@query(f"WITH {SQL_SCORED} SELECT method, count(*) AS n, round(100 * avg((fp > 0)::INT), 2) AS negative_fp FROM scored WHERE tp + fn = 0 GROUP BY method")
def negative_fp_rate(spark, sf):
    return metrics.negative_fp_rate(_scored(spark, sf))


@query(f"WITH {SQL_SCORED} SELECT method, round(avg((fp = 0 AND fn = 0)::INT), 4) AS exact, round(avg((tp + fp = 0)::INT), 4) AS empty FROM scored GROUP BY method")
def exact_empty_rates(spark, sf):
    return metrics.exact_empty_rates(_scored(spark, sf))


def _ranked(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("term_id"), F.col("l_linenumber").alias("rank")).where("rank > 0")


_SQL_RANK = """WITH gold AS (SELECT DISTINCT l_orderkey AS case_id, l_partkey AS term_id FROM lineitem WHERE l_quantity > 30),
top AS (SELECT l_orderkey AS case_id, l_partkey AS term_id, l_linenumber AS rank FROM lineitem WHERE l_linenumber <= 3),
n AS (SELECT case_id, count(*) AS n FROM top GROUP BY 1), g AS (SELECT case_id, count(*) AS g FROM gold GROUP BY 1),
h AS (SELECT case_id, count(*) AS h, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM top SEMI JOIN gold USING (case_id, term_id) GROUP BY 1),
c AS (SELECT o_orderkey AS case_id, coalesce(g, 0) AS g, coalesce(n, 0) AS n, coalesce(h, 0) AS h, first, coalesce(dcg, 0) AS dcg FROM orders LEFT JOIN g ON g.case_id = o_orderkey LEFT JOIN n ON n.case_id = o_orderkey LEFT JOIN h ON h.case_id = o_orderkey)
SELECT round(avg((h > 0)::INT) FILTER (g > 0), 4) AS hit, round(avg(h / g) FILTER (g > 0), 4) AS recall, round(avg(h / greatest(1, least(3, n))) FILTER (g > 0), 4) AS precision,
 round(avg(coalesce(1.0 / first, 0)) FILTER (g > 0), 4) AS mrr, round(avg(dcg / list_sum([1 / log2(i + 1) for i in range(1, greatest(1, least(g, 3)) + 1)])) FILTER (g > 0), 4) AS ndcg, round(avg((n = 0)::INT) FILTER (g = 0), 4) AS negative_rejected FROM c"""


@query(_SQL_RANK)
def retrieval_metrics(spark, sf):
    return metrics.retrieval_metrics(_ranked(spark, sf), _gold(spark, sf), _cases(spark, sf), 3)


@query("SELECT l_returnflag AS method, round(avg(l_quantity * 1000), 3) AS mean_ms, round(quantile_cont(l_quantity * 1000, 0.5), 3) AS median_ms FROM lineitem GROUP BY 1")
def latency_stats(spark, sf):
    return metrics.latency_stats(_t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_quantity").alias("elapsed_s")))


_SQL_BOTH = f"a AS ({_SQL_RANK}), b AS ({_SQL_RANK.replace('l_linenumber <= 3', 'l_linenumber <= 3 AND l_linenumber % 2 = 1')})"


@query(f"WITH {_SQL_BOTH} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, a.{m}::DOUBLE AS base, b.{m}::DOUBLE AS other, round(b.{m} - a.{m}, 4)::DOUBLE AS delta FROM a, b" for m in ("hit", "recall", "precision", "mrr", "ndcg")))
def ablation_delta(spark, sf):
    gold, cases = _gold(spark, sf), _cases(spark, sf)
    a = metrics.retrieval_metrics(_ranked(spark, sf), gold, cases, 3)
    b = metrics.retrieval_metrics(_ranked(spark, sf).where("rank % 2 = 1"), gold, cases, 3)
    return metrics.ablation_delta(a, b, ["hit", "recall", "precision", "mrr", "ndcg"])


@query("SELECT o_orderstatus AS lang, o_orderpriority AS difficulty, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 2) AS percent, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id FROM orders GROUP BY ALL")
def case_distribution(spark, sf):
    return metrics.case_distribution(_cases(spark, sf))


@query(f"""WITH {SQL_SCORED.strip()}, k AS (SELECT method, case_id, term_id, max(p) AS p, max(g) AS g FROM (SELECT method, case_id, term_id, 1 AS p, 0 AS g FROM pred
 UNION ALL SELECT method, case_id, term_id, 0, 1 FROM gold, (VALUES ('odd'), ('cheap')) m(method)) GROUP BY ALL)
SELECT method, case_id, coalesce(list_sort(list(term_id) FILTER (p = 1 AND g = 1)), []) AS tp_ids, coalesce(list_sort(list(term_id) FILTER (p = 1 AND g = 0)), []) AS fp_ids, coalesce(list_sort(list(term_id) FILTER (p = 0)), []) AS fn_ids FROM k GROUP BY ALL""")
def score_case_ids(spark, sf):
    return metrics.case_ids(_predictions(spark, sf), _gold(spark, sf))


@query("""WITH s AS (SELECT l_returnflag AS m, round(avg(l_quantity * 1000), 3) AS ms FROM lineitem GROUP BY 1), x AS (SELECT max(ms) FILTER (m = 'A') AS base_ms, max(ms) FILTER (m = 'R') AS other_ms FROM s)
SELECT base_ms, other_ms, round(other_ms - base_ms, 3) AS delta_ms, round((other_ms - base_ms) / base_ms, 4) AS relative FROM x""")
def latency_delta(spark, sf):
    return metrics.latency_delta(latency_stats(spark, sf), "A", "R")
