"""Files in and out, streams, and the vector stages, by hand-worked values and brute force."""

import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillon.functions.vectorised import hash_embed, l2_normalize
from quillon.operators import match, vectors
from quillon.sources import ontology as sources
from quillon.streaming.annotate import annotate_stream

CASES = [
    {"id": 1, "text": " \tDNA repair\n", "gold": [" go:0006281 ", "MESH:1"], "lang": "en", "difficulty": "easy"},
    {"id": 2, "text": " \n", "gold": [], "lang": "en", "difficulty": "easy"},
    {"id": 3, "text": "cell", "gold": None, "lang": None, "difficulty": None},
]


@pytest.mark.parametrize("wrapped", [False, True])
def test_cases(spark, tmp_path, wrapped):
    path = tmp_path / "cases.json"
    path.write_text(json.dumps({"cases": CASES} if wrapped else CASES, indent=1))
    cases = sources.read_cases(spark, str(path))
    assert {(r["case_id"], r["text"], tuple(r["gold"]), r["lang"], r["difficulty"]) for r in cases.collect()} == {(1, "DNA repair", ("GO:0006281",), "en", "easy"), (3, "cell", (), "unknown", "unknown")}
    counts = sources.write_case_subset(cases, ["en"], str(tmp_path / "subset"))
    assert [tuple(r) for r in counts.collect()] == [("easy", 1)]
    assert [r["text"] for r in spark.read.json(str(tmp_path / "subset")).collect()] == ["DNA repair"]


def test_metadata_and_node_index(spark, tmp_path):
    meta = {"dim": 2, "items": {"0": {"node_type": "Gene", "go_id": "Gene:1", "name": "g", "description": "EntrezID: 77, Other: x"}, "1": {"go_id": "GO:1", "name": "t", "description": "d"}, "2": {"node_type": "PMID", "go_id": "PMID:5", "name": "p", "description": "Journal: J of X, Year: 1999"}}}
    nodes = sources.nodes_from_metadata(spark.createDataFrame([(json.dumps(meta),)], "value string"))
    got = {r["idx"]: (r["node_type"], r["node_id"], r["entrez_id"], r["journal"], r["year"]) for r in nodes.collect()}
    assert got == {0: ("Gene", "Gene:1", "77", None, None), 1: ("GO_Term", "GO:1", None, None, None), 2: ("PMID", "PMID:5", None, "J of X", "1999")}
    vecs = nodes.select("node_id", "node_type", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    sources.write_node_index(vecs, str(tmp_path / "index"), 2)
    assert {(r["node_id"], r["node_type"]) for r in spark.read.parquet(str(tmp_path / "index")).collect()} == {(x[1], x[0]) for x in got.values()}
    with pytest.raises(PySparkException):
        sources.write_node_index(vecs, str(tmp_path / "wrong"), 3)


def test_reports(spark, tmp_path):
    table = spark.createDataFrame([("f1", 0.5, 0.625, 0.125)], "metric string, base double, other double, delta double")
    sources.write_report(str(tmp_path), deltas=table)
    assert spark.read.json(str(tmp_path / "deltas")).first()["delta"] == 0.125
    assert sources.delta_markdown(table).splitlines()[-1] == "| f1 | 0.5000 | 0.6250 | +0.1250 |"


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} on dna repair and cell growth") for i in range(40)] + [(99, None)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    terms = spark.createDataFrame([(1, "dna repair", [], 1), (2, "cell growth", [], 2)], "term_id long, name string, synonyms array<string>, ord long")
    run = lambda d: match.annotate_ngram(d, terms).select("doc_id", "term_id", "span")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    annotate_stream(stream, run, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() > 1
    assert sorted(tuple(r) for r in got.drop("batch").collect()) == sorted(tuple(r) for r in run(docs).collect())
    assert got.count() == 80


@pytest.mark.parametrize("blocks", [64, 1])
def test_top_k_in_both_layouts(spark, monkeypatch, blocks):
    monkeypatch.setattr(vectors, "BROADCAST_BLOCKS", blocks)
    monkeypatch.setattr(vectors, "ITEM_GROUP", 16)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    rng = np.random.RandomState(4)
    x = rng.randint(-3, 4, (60, 4)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    items = spark.createDataFrame([*rows, (100, None)], "node_id long, embedding array<float>")
    queries = spark.createDataFrame([*rows[:7], (200, None)], "query_id long, embedding array<float>")
    near = {"topk_cosine": lambda q: -(x @ q), "topk_l2": lambda q: ((x - q) ** 2).sum(1)}
    for name, distance in near.items():
        want = {(i, n, int(j)) for i in range(7) for n, j in enumerate(np.argsort(distance(x[i]), kind="stable")[:5], 1)}
        assert {(r["query_id"], r["rank"], r["node_id"]) for r in getattr(vectors, name)(queries, items, 5).collect()} == want


def test_sentences_near_terms(spark):
    names = [(1, "repair of broken dna"), (2, "growth of the cell wall"), (3, "sugar transport")]
    terms = spark.createDataFrame(names, "node_id long, name string")
    docs = spark.createDataFrame([(1, "growth of the cell wall. Nothing else here"), (2, None), (3, "broken dna repair")], "doc_id long, text string")
    embed = lambda df, k, t: hash_embed(df, k, t)
    items = embed(terms, "node_id", "name")
    got = {(r["doc_id"], r["node_id"]): r["similarity"] for r in vectors.annotate_vector(docs, items, embed, threshold=0.8).collect()}
    assert set(got) == {(1, 2), (3, 1)} and got[1, 2] == pytest.approx(1.0, abs=1e-4)
    index = items.join(terms, "node_id").withColumn("text", F.col("name"))
    first = vectors.retrieve_sources(spark.createDataFrame([(9, "sugar transport")], "query_id long, text string"), index, embed, 2).orderBy("rank").first()
    assert (first["query_id"], first["name"], first["score"]) == (9, "sugar transport", 1.0)


def test_unit_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(l2_normalize(F.col("v")).alias("u")).collect()
    assert [r["u"] for r in v] == [[0.6, 0.8], [0.0, 0.0]]
