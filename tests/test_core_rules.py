"""Rules of matching, fusion, merging and graphs, by hand-worked values and brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.functions.vectorised import hash_embed
from quillon.operators import ensemble, fusion, graph, match, merge, ontology, vectors

HIT = "doc_id long, term_id string, source string, score double, match_type string, span string, start int, end int"


@pytest.mark.parametrize("probed", [1 << 22, 0])
def test_fuzzy_names_equal_all_pairs(spark, monkeypatch, probed):
    """Both by probing a broadcast index and by joining it."""
    monkeypatch.setattr(match, "PROBED_PARTS", probed)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeinst") for _ in range(rng.randint(1, 7)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)]

    def edited(s):
        s = list(s)
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "e ", "s"])
        return "".join(s)

    phrases = sorted({edited(rng.choice(names)) for _ in range(600)} - {""})
    table = spark.createDataFrame([(x, i, i) for i, x in enumerate(names)], "name_lc string, term_id long, ord long")
    for least, band in ((0.85, 10), (0.7, None)):
        got = {r["phrase"]: r["term_id"] for r in match.best_fuzzy(spark.createDataFrame([(x,) for x in phrases], "phrase string"), table, threshold=least, band=band).collect()}
        want = {}
        for x in phrases:
            scored = [(-SequenceMatcher(None, x, y).ratio(), i) for i, y in enumerate(names) if band is None or abs(len(x) - len(y)) <= band]
            if scored and -min(scored)[0] >= least:
                want[x] = min(scored)[1]
        assert got == want
        few = match.name_parts(table.select("name_lc"), threshold=least, band=band, most=max(map(len, names)))
        assert few.where("length(part) = 0").count() == 0 or least < 0.85


def test_windows_carry_their_places(spark):
    texts = [(1, "The  DNA-repair of THE cell,\tin vivo"), (2, ""), (3, None), (4, "word " * 3000 + "dna-repair")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for r in match.token_rows(docs, 3).collect():
        text = dict(texts)[r["doc_id"]]
        assert text[r["start"] : r["start"] + len(r["t"])] == r["t"]
        assert text[r["start"] + len(r["t"]) :].startswith(r["ahead"]) and text[: r["start"]].endswith(r["behind"][::-1])
    names = spark.createDataFrame([("dna-repair", "t", True, 1), ("cell", "c", True, 1)], "name_lc string, term_id string, is_primary boolean, n_tokens int")
    hits = match.match_exact(docs, names, max_ngram=3, stopwords=T.DICT_STOPWORDS, pad=True).collect()
    got = {(r["doc_id"], r["win_start"], r["win_end"], r["span"]) for r in hits if r["n"] == 3}
    assert got == {(1, 0, 18, "The  DNA-repair of"), (1, 5, 22, "DNA-repair of THE"), (1, 16, 27, "of THE cell"), (1, 19, 31, "THE cell,\tin")}
    assert all(dict(texts)[r["doc_id"]][r["start"] : r["end"]] == r["span"] for r in hits)


def test_overlaps_block_by_their_ends(spark):
    rows = [(1, 2, 0, 0, 0, 10, 0, 10), (1, 2, 1, 0, 4, 18, 4, 18), (1, 1, 0, 0, 0, 3, 0, 3), (1, 1, 3, 0, 20, 25, 20, 25)]
    hits = spark.createDataFrame([(*r, "t", "s", "exact", 1.0) for r in rows], "doc_id long, n int, i int, rank int, win_start int, win_end int, start int, end int, term_id string, span string, match_type string, score double")
    assert {(r["start"], r["end"]) for r in match.resolve_overlaps(hits).collect()} == {(0, 10), (20, 25)}


def test_sentences_lose_all_white_space(spark):
    docs = spark.createDataFrame([(1, "First one here.\tSecond sentence\r\n third sentence　; no")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in match.sentence_table(docs).orderBy("start").collect()] == [("First one here", 0, 14), ("Second sentence", 16, 31), ("third sentence", 34, 48)]


def test_fused_type_is_that_of_the_first_hit(spark):
    rows = [(1, "t", "dict", 1.0, "synonym", "a", 0, 1), (1, "t", "dict", 0.9, "fuzzy", "b", 5, 6), (2, "t", "vector", 0.9, "vector", "c", 3, 4), (2, "t", "dict", 0.9, "fuzzy", "d", -1, -1)]
    p = fusion.PRESETS["balanced"]
    got = {r["doc_id"]: r for r in fusion.fuse_sources(spark.createDataFrame(rows, HIT), p).collect()}
    assert (got[1]["match_type"], got[2]["match_type"], got[2]["span"]) == ("synonym", "fuzzy", "c")


def test_choices_at_one_place(spark):
    chosen = spark.createDataFrame([(1, "t", 1, 0.2), (1, "t", 1, 0.9), (1, "u", 2, None)], "doc_id long, term_id string, pos int, confidence double")
    offered = spark.createDataFrame([(1, "t", 0.5), (1, "u", 0.4)], "doc_id long, term_id string, score double")
    assert {tuple(r) for r in match.gate_to_candidates(chosen, offered).collect()} == {(1, "t", 0.9), (1, "u", 0.4)}


def test_two_stages_without_representatives_search_everything(spark):
    items = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "node_id long, embedding array<float>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    reps = spark.createDataFrame([(77,)], "rep_id long")
    members = spark.createDataFrame([(77, 1)], "rep_id long, member_id long")
    assert [r["node_id"] for r in vectors.topk_two_stage(queries, items, reps, members, 2).orderBy("rank").collect()] == [1, 0]


def test_merge(spark):
    edges = spark.createDataFrame([("A", "R"), ("C", "A"), ("D", "C")], "child string, parent string")
    nodes = spark.createDataFrame([(x, "ns") for x in "RACD"], "term_id string, namespace string")
    labels, depths = ontology.reach_labels(nodes, edges), ontology.node_depths(nodes, edges, ["R"])
    docs = spark.createDataFrame([(1, "about gamma things")], "doc_id long, text string")
    rows = [(1, "C", "gamma", "biological_process", "", 0.5, 1), (1, "C", "gamma", "biological_process", "gamma", 0.4, 2), (1, "A", "alpha", "biological_process", "", 0.9, 3)]
    c = spark.createDataFrame(rows, "doc_id long, term_id string, name string, namespace string, span string, score double, pos int")
    assert merge._best(c.withColumn("final", F.lit(0.0))).where("term_id = 'C'").first()["score"] == 0.5
    assert [tuple(r) for r in merge.merge_terms(docs, c, labels, depths).collect()] == [(1, ["C"], ["A"])]
    terms = spark.createDataFrame([("C", "gamma", "biological_process"), ("A", "alpha", "biological_process")], "term_id string, name string, namespace string")
    ids = spark.createDataFrame([(1, "A"), (1, "C"), (1, "unknown")], "doc_id long, term_id string")
    assert [tuple(r) for r in merge.merge_ids(docs, ids, terms, labels, depths).collect()] == [(1, ["C"], ["A"])]


def test_two_steps_only_without_a_direct_edge(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "m"), ("b", "m"), ("c", "n"), ("d", "n")], "src string, dst string").select("src", F.lit("GO_Term").alias("src_type"), "dst", F.lit("GO_Term").alias("dst_type"), F.lit("is_a").alias("relationship"))
    seeds = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d")], "query_id long, term_id string")
    assert {(r["query_id"], r["src"], r["dst"]) for r in graph.two_hop_edges(seeds, e).collect()} == {(1, "a", "b"), (2, "c", "n"), (2, "d", "n")}


def test_ensemble(spark):
    terms = spark.createDataFrame([(1, "dna repair", "biological_process", "", [], [], 1), (2, "cell growth", "biological_process", "", [], [], 2)], "term_id long, name string, namespace string, definition string, synonyms array<string>, alt_ids array<string>, ord long")
    docs = spark.createDataFrame([(1, "DNA repair matters. growth of cell growth"), (2, "nothing of the kind; cell growths")], "doc_id long, text string")
    items = hash_embed(terms.select(F.col("term_id").alias("node_id"), "name"), "node_id", "name")
    told = spark.createDataFrame([(2, 1, "KIND", 0.9), (2, 1, "x", 0.1), (2, None, "y", 0.9)], "doc_id long, term_id long, span string, confidence double")
    got = {(r["doc_id"], r["term_id"]): (r["source"], r["start"], r["end"]) for r in ensemble.annotate_ensemble(docs, terms, items, hash_embed, told, fusion.PRESETS["recall"]).collect()}
    assert got[1, 1] == ("dict+vector", 0, 10) and got[1, 2][0].startswith("dict")
    assert got[2, 1] == ("llm", 15, 19) and got[2, 2] == ("dict", 21, 33)
