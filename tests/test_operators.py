"""Hand-worked values of the ontology, matching, fusion and metric operators."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vectorised import hash_embed
from quillon.operators import fusion, ic, match, metrics, ontology
from quillon.sources import ontology as sources

OBO = """format-version: 1.2

[Term]
id: GO:0000001
name: dna repair
namespace: biological_process
def: "Mending of DNA." [x]
synonym: "genome mending" EXACT []
alt_id: GO:0000009

[Term]
id: GO:0000002
name: repair pathway
is_a: GO:0000001 ! dna repair

[Term]
id: GO:0000003
name: gone
is_obsolete: true

[Typedef]
id: part_of
name: part of
"""


@pytest.fixture(scope="module")
def dag(spark):
    nodes = spark.createDataFrame([(x, "ns") for x in "RABCDEX"], "term_id string, namespace string")
    edges = spark.createDataFrame([("A", "R"), ("B", "R"), ("C", "A"), ("C", "B"), ("D", "C"), ("E", "B")], "child string, parent string")
    return nodes, edges, ontology.closure(edges)


def test_dag(dag):
    nodes, edges, pairs = dag
    assert {tuple(r) for r in ontology.node_depths(nodes, edges, ["R"]).collect()} == {("R", 0), ("A", 1), ("B", 1), ("C", 2), ("D", 3), ("E", 2), ("X", 0)}
    assert {r[0]: r[1] for r in ontology.descendant_counts(nodes, pairs).collect()} == {"R": 5, "A": 2, "B": 3, "C": 1, "D": 0, "E": 0, "X": 0}
    assert {r[0] for r in ontology.leaves(nodes, edges).collect()} == {"D", "E", "X"}
    assert [r["dist"] for r in pairs.where("ancestor = 'R' and descendant = 'D'").collect()] == [3]


def test_information_content(spark, dag):
    nodes, _, pairs = dag
    s = {r[0]: r[1] for r in ic.ic_structural(nodes, pairs).collect()}
    assert math.isclose(s["R"], 1.2224, abs_tol=1e-4) and math.isclose(s["D"], 3.8074, abs_tol=1e-4)
    genes = spark.createDataFrame([("g1", "D"), ("g2", "E"), ("g1", "E")], "gene string, term_id string")
    assert {r[0]: r[1] for r in ic.annotation_counts(nodes, pairs, genes).collect()} == {"D": 1, "E": 2, "B": 2, "A": 1, "C": 1, "R": 2, "X": 0}
    assert math.isclose({r[0]: r[1] for r in ic.ic_annotation(nodes, pairs, genes).collect()}["R"], 1.5850, abs_tol=1e-4)


def test_obo_and_dictionary(spark, tmp_path):
    (tmp_path / "t.obo").write_text(OBO)
    terms = sources.read_obo(spark, str(tmp_path / "t.obo"))
    assert {r["term_id"] for r in terms.collect()} == {"GO:0000001", "GO:0000002"}
    assert [tuple(r) for r in sources.read_edges(terms).collect()] == [("GO:0000002", "GO:0000001")]
    assert {tuple(r) for r in sources.term_alias(terms).collect()} >= {("GO:0000009", "GO:0000001")}
    docs = spark.createDataFrame([(1, "DNA repair pathway"), (2, "The DNA repair"), (3, "see go:0000009 here")], "doc_id long, text string")
    hits = {(r["doc_id"], r["start"], r["end"], r["term_id"]) for r in match.annotate_dictionary(docs, terms, alias=sources.term_alias(terms), use_fuzzy=False).collect()}
    assert hits == {(1, 0, 10, "GO:0000001"), (2, 4, 14, "GO:0000001"), (3, 4, 14, "GO:0000001")}


def test_text(spark):
    one = spark.createDataFrame([("DNA修复基因", "<think>[x]</think> [\"a\",\"\"]", "GO ID GO:0006281 acts")], "a string, b string, c string")
    r = one.select(T.detect_lang(F.col("a")), T.parse_phrases(F.col("b")), T.sanitize_answer(F.col("c"))).first()
    assert tuple(r) == ("zh", ["a"], "  acts")
    e = hash_embed(spark.createDataFrame([(1, ""), (2, "a a")], "k long, t string"), "k", "t").orderBy("k").collect()
    assert sum(map(abs, e[0][1])) == 0 and sorted(map(abs, e[1][1]))[-2:] == [0, 1]


def test_fusion_and_metrics(spark):
    hits = spark.createDataFrame([(1, "t", s, v, "exact", "x", 0, 1) for s, v in (("dict", 1.0), ("vector", 0.6))] + [(2, "t", "vector", 0.65, "vector", "x", -1, -1)], "doc_id long, term_id string, source string, score double, match_type string, span string, start int, end int")
    p = fusion.PRESETS["balanced"]
    got = {r["doc_id"]: r["fused"] for r in fusion.fuse_sources(hits, p).collect()}
    assert math.isclose(got[1], 0.9324, abs_tol=1e-4)
    assert [r["doc_id"] for r in fusion.accept_fused(fusion.fuse_sources(hits, p), p).collect()] == [1]
    cases = spark.createDataFrame([(1, "en", "easy"), (2, "en", "hard")], "case_id long, lang string, difficulty string")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "case_id long, term_id string")
    ranked = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (1, "b", 3)], "case_id long, term_id string, rank int")
    m = metrics.retrieval_metrics(ranked, gold, cases, 3).first()
    assert (m["mrr"], m["precision"], m["recall"]) == (0.5, 0.6667, 1.0) and math.isclose(m["ndcg"], 0.6934, abs_tol=1e-4)
