"""Labels, bitmaps, bins, cuts and one-pass forms against the plain rules they stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.vectorised import PartIndex, common_letters, hash_embed, letters
from quillon.operators import fusion, graph, ic, match, merge, ontology, vectors
from quillon.sources import ontology as sources


def reached(edges):
    """{(ancestor, descendant): least distance}."""
    below = {}
    for child, parent in edges:
        below.setdefault(parent, set()).add(child)
    out = {}
    for a in {p for _, p in edges}:
        level, dist = {a}, 0
        while level:
            dist += 1
            level = {c for x in level for c in below.get(x, ()) if (a, c) not in out}
            out |= {(a, c): dist for c in level}
    return {k: v for k, v in out.items() if k[0] != k[1]}


def dag(rng, n, parents):
    return sorted({(i, rng.randrange(i)) for i in range(1, n) for _ in range(rng.randint(0, parents))})


def test_closure_of_deep_wide_and_cyclic_graphs(spark):
    rng = random.Random(3)
    for edges in ([(i + 1, i) for i in range(70)], dag(rng, 60, 3), [(1, 2), (2, 3), (3, 1), (4, 1), (4, 4)]):
        got = ontology.closure(spark.createDataFrame(edges, "child long, parent long")).collect()
        assert len(got) == len({r[:2] for r in got}) and {(r["ancestor"], r["descendant"]): r["dist"] for r in got} == reached(edges)


def test_depths_of_a_long_way(spark, monkeypatch):
    monkeypatch.setattr(ontology, "JOINED_ROUNDS", 3)
    edges = spark.createDataFrame([(i + 1, i) for i in range(8)] + [(8, 2)], "child long, parent long")
    nodes = spark.createDataFrame([(i, "ns") for i in range(10)], "term_id long, namespace string")
    assert {r[0]: r[1] for r in ontology.node_depths(nodes, edges, [0]).collect()} == {**{i: i for i in range(8)}, 8: 3, 9: 0}


@pytest.mark.parametrize("parents", [1, 3])
def test_labels_tell_what_the_closure_tells(spark, monkeypatch, parents):
    monkeypatch.setattr(ontology, "SIBLINGS", 7)
    rng = random.Random(parents)
    edges = dag(rng, 45, parents) + [(3, 99), (99, 99)]
    nodes = spark.createDataFrame([(i, "ns") for i in range(50)], "term_id long, namespace string")
    labels = ontology.reach_labels(nodes, spark.createDataFrame(edges, "child long, parent long"))
    rows = labels.collect()
    assert sorted(r["pre"] for r in rows) == list(range(1, 51))
    all_pairs = spark.createDataFrame([(a, b) for a in range(50) for b in range(50)], "a long, b long")
    assert {tuple(r) for r in ontology.label_pairs(all_pairs, labels).collect()} == set(reached([e for e in edges if 99 not in e]))
    for r in rows:  # no subtree of the list lies in another or in the term's own
        spans = [(r["pre"], r["last"])] + [tuple(x) for x in r["more"]]
        assert all(not (a <= c and d <= b) for i, (a, b) in enumerate(spans) for j, (c, d) in enumerate(spans) if i != j)


def test_labels_refuse_a_cycle(spark):
    with pytest.raises(ValueError):
        ontology.reach_labels(spark.createDataFrame([(1,), (2,)], "term_id long"), spark.createDataFrame([(1, 2), (2, 1)], "child long, parent long"))


def test_merging_by_labels_equals_the_greedy_rule(spark):
    rng = random.Random(11)
    edges = dag(rng, 30, 2)
    above = set(reached(edges))
    nodes = spark.createDataFrame([(i, "ns") for i in range(30)], "term_id long, namespace string")
    labels = ontology.reach_labels(nodes, spark.createDataFrame(edges, "child long, parent long"))
    rows = [(d, t, rng.choice(["a", "b"]), rng.randrange(6) / 10) for d in range(40) for t in rng.sample(range(34), 9)]
    got = {tuple(r) for r in merge.drop_hierarchy_conflicts(spark.createDataFrame(rows, "doc_id long, term_id long, namespace string, final double"), labels).select("doc_id", "term_id", "namespace", "final").collect()}
    want = set()
    for d, ns in {(r[0], r[2]) for r in rows}:
        kept = []
        for r in sorted((r for r in rows if (r[0], r[2]) == (d, ns)), key=lambda r: (-r[3], r[1])):
            if not any((r[1], k[1]) in above or (k[1], r[1]) in above for k in kept):
                kept.append(r)
        want |= set(kept)
    assert got == want


def test_clusters_and_limits(spark):
    rows = [(1, i, n, ns, f) for i, (n, ns, f) in enumerate([(" DNA Repair", "biological_process", 0.5), ("genome maintenance", "biological_process", 0.7), ("genome maintenance", "molecular_function", 0.1), ("growth", "biological_process", 0.4), ("decay", "biological_process", 0.3), ("rest", "other", 0.2)])]
    r = merge.cluster_of(spark.createDataFrame(rows, "doc_id long, term_id long, name string, namespace string, final double"))
    assert [x["cluster"] for x in r.orderBy("term_id").collect()] == ["dna_repair"] * 3 + [None] * 3
    left = merge.drop_cluster_conflicts(r)
    assert {x["term_id"] for x in left.collect()} == {1, 2, 3, 4, 5}
    assert {x["term_id"] for x in merge.limit_per_namespace(left).collect()} == {1, 2, 3, 5}


def test_gene_bitmaps_count_as_rows_do(spark, monkeypatch):
    monkeypatch.setattr(ic, "BITMAP_GENES", 4)
    rng = random.Random(8)
    edges = dag(rng, 25, 2)
    nodes = spark.createDataFrame([(i, "ns") for i in range(27)], "term_id long, namespace string")
    pairs = ontology.closure(spark.createDataFrame(edges, "child long, parent long"))
    own = [(f"g{rng.randrange(40)}", rng.randrange(30)) for _ in range(120)] + [(None, 3)]
    genes = spark.createDataFrame(own, "gene string, term_id long")
    above = reached(edges)
    want = {t: len({g for g, x in own if g and (x == t or (t, x) in above)}) for t in range(27)}
    for bitmaps in (True, False, None):
        assert {r[0]: r[1] for r in ic.annotation_counts(nodes, pairs, genes, bitmaps=bitmaps).collect()} == want
    numbers = ic.gene_numbers(genes).collect()
    assert len(numbers) == len({(r["bucket"], r["bit"]) for r in numbers}) == len({g for g, _ in own if g}) and len({r["bucket"] for r in numbers}) > 1


@pytest.mark.parametrize("width", [1, 8, 1000])
def test_overlaps_by_bins(spark, width):
    rng = random.Random(width)
    spans = [(d, a, a + rng.randint(0, 30)) for d in range(6) for a in range(0, 200, 25)]
    hits = [(rng.randrange(7), a := rng.randrange(-3, 210), a + rng.choice([0, 1, 5, 90])) for _ in range(150)]
    hits = [(d, max(a, 0), b) for d, a, b in hits] * 2
    h = spark.createDataFrame(hits, "doc_id long, start int, end int").withColumn("term_id", F.lit(1))
    got = match.overlaps(spark.createDataFrame(spans, "doc_id long, start int, end int"), h, width).collect()
    assert {tuple(r) for r in got} == {(d, a, b, sum(max(0, min(b, e) - max(a, s)) for x, s, e in hits if x == d)) for d, a, b in spans}


def test_presets_in_one_pass(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(60), rng.randrange(4), rng.choice(["dict", "vector", "llm"]), rng.choice([0.3, 0.45, 0.6, 0.7, 0.8, 0.96, 1.0]), rng.choice(["exact", "synonym", "fuzzy", "go_id", "vector"]), "s", rng.randrange(-1, 3), 9) for _ in range(700)]
    hits = spark.createDataFrame(rows, "doc_id long, term_id long, source string, score double, match_type string, span string, start int, end int")
    want = set()
    for name, p in fusion.PRESETS.items():
        near = hits.where(F.when(F.col("source") == "vector", F.col("score") >= p.vector_threshold).when(F.col("source") == "llm", F.col("score") >= p.llm_threshold).otherwise(True))
        want |= {(name, r["doc_id"], r["term_id"]) for r in fusion.accept_fused(fusion.fuse_sources(near, p), p).collect()}
    swept = fusion.preset_sweep(hits)
    assert {tuple(r) for r in swept.collect()} == want and swept.count() == len(want)
    assert swept._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_a_hubs_edges_are_cut_before_they_meet_queries(spark):
    rng = random.Random(6)
    edges = [("hub", "GO_Term", f"t{i:05}", "GO_Term", "is_a") for i in range(3000)] + [(f"t{rng.randrange(99):05}", "GO_Term", f"t{rng.randrange(99):05}", "GO_Term", "r") for _ in range(300)]
    edges += [(f"g{i}", "Gene", "hub", "GO_Term", "x") for i in range(400)] * 2 + [("t00001", "GO_Term", f"p{i}", "PMID", "x") for i in range(50)]
    e = spark.createDataFrame(edges, "src string, src_type string, dst string, dst_type string, relationship string")
    seeds = [(q, t) for q in range(30) for t in ("hub", f"t{q:05}")] + [(99, None)]
    want = set()
    for q in {q for q, t in seeds if t}:
        own = {t for x, t in seeds if x == q}
        for n, keep in ((80, lambda x: x[1] == x[3] == "GO_Term" and (x[0] in own or x[2] in own)), (30, lambda x: x[1] == "Gene" and x[2] in own), (20, lambda x: x[3] == "PMID" and x[0] in own)):
            want |= {(q, *x) for x in sorted({x for x in edges if keep(x)}, key=lambda x: (x[0], x[2], x[4]))[:n]}
    s = spark.createDataFrame(seeds, "query_id long, term_id string")
    assert {tuple(r) for r in graph.graph_neighbourhood(s, e).collect()} == want
    assert graph._first_edges(e.where("src_type = dst_type"), s.where("term_id = 'hub'"), "src", 80).count() == 30 * 80


def test_an_index_knows_its_metric_and_encoder(spark, tmp_path):
    rows = spark.createDataFrame([("GO_Term", "a", [1.0, 0.0]), ("Gene", "b", [0.0, 1.0])], "node_type string, node_id string, embedding array<float>")
    path = f"file://{tmp_path}/index"
    sources.write_node_index(rows, path, 2, metric="cosine", encoder="hash-2")
    assert sources.read_node_index(spark, path, metric="cosine", encoder="hash-2", dim=2).count() == 2
    for wrong in ({"metric": "l2", "encoder": "hash-2"}, {"metric": "cosine", "encoder": "other"}, {"metric": "cosine", "encoder": "hash-2", "dim": 3}):
        with pytest.raises(ValueError, match="does not fit"):
            sources.read_node_index(spark, path, **wrong)
    rows.write.parquet(f"file://{tmp_path}/plain")
    with pytest.raises(ValueError, match="None"):
        sources.read_node_index(spark, f"file://{tmp_path}/plain")
    with pytest.raises(ValueError):
        sources.write_node_index(rows, f"file://{tmp_path}/no", 2, metric="dot")


def test_embedding_is_one_pass_over_rows(spark):
    rows = spark.createDataFrame([(1, "A b\na"), (1, "b"), (2, None), (3, " \n "), (None, "x")], "k long, t string")
    e = hash_embed(rows, "k", "t", 16)
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    got = [(r["k"], r["embedding"]) for r in e.collect()]
    assert sorted(map(str, (k for k, _ in got))) == ["1", "1", "2", "3", "None"] and all(len(v) == 16 for _, v in got)
    assert all(not any(v) for k, v in got if k in (2, 3))
    assert sorted(round(max(map(abs, v)), 4) for k, v in got if k == 1) in ([0.8944, 1.0], [1.0, 1.0])


def test_common_letters_and_parts():
    a, b = letters(["abcd", "xyzw"], 4), letters(["acbd", "yw"], 4)
    b[1, 2:] = 0xFFFFFFFF
    assert common_letters(a, b).tolist() == [3, 2]
    import pandas as pd

    index = PartIndex(pd.DataFrame({"lp": [4, 4], "i": [0, 1], "at": [0, 2], "part": ["ab", "cd"], "name_lc": ["abcd", "zzcd"]}), 0.7)
    assert index.near(["abxx", "qqcd", "abcd"], 4) == (["abcd"], ["abcd"])
    assert index.near(["abc"], 3) == ([], [])


TERMS = [("GO:0000001", "dna repair", "biological_process", ["genome mending"], ["GO:0000009"], 1), ("GO:0000002", "cell wall", "cellular_component", ["walls"], [], 2), ("GO:0000003", "wall", "cellular_component", [], [], 3), ("GO:0000004", "regulation of cell wall growth", "biological_process", [], [], 4)]


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(a, b, c, "", d, e, f) for a, b, c, d, e, f in TERMS], "term_id string, name string, namespace string, definition string, synonyms array<string>, alt_ids array<string>, ord long")


def test_normalized_mentions_and_their_scores(spark, terms):
    m = [" DNA Repair ", "genome mending", "go:0000009 something", "GO:7777777 x", "dna repairs", "cell walls growth", "nothing like it", "process"]
    got = match.normalize_terms(spark.createDataFrame([(x,) for x in m], "mention string"), terms, alias=sources.term_alias(terms))
    assert {r["mention"]: (r["term_id"], r["how"]) for r in got.collect()} == {
        " DNA Repair ": ("GO:0000001", "name"), "genome mending": ("GO:0000001", "name"), "go:0000009 something": ("GO:0000001", "id"), "GO:7777777 x": (None, "none"),
        "dna repairs": ("GO:0000001", "fuzzy"), "cell walls growth": (None, "none"), "nothing like it": (None, "none"), "process": (None, "none"),
    }
    named = spark.createDataFrame([("DNA repair", "dna repair"), ("dna repair of x", "dna repair"), ("repair", "dna repair"), ("far", "dna repair"), ("pathway", "pathway"), ("gone", None)], "mention string, name string")
    score = lambda df: {r["mention"]: (r["match_type"], round(r["confidence"], 4)) for r in df.collect()}
    assert score(match.score_normalized(named)) == {"DNA repair": ("dict_exact", 1.0), "dna repair of x": ("dict_fuzzy", 0.9), "repair": ("dict_fuzzy", 0.75), "far": ("none", 0.0), "pathway": ("none", 0.0), "gone": ("none", 0.0)}
    assert score(match.score_phrases(named, threshold=0.7)) == {"DNA repair": ("dict_exact", 0.9), "pathway": ("dict_exact", 0.9), "gone": ("none", 0.0)}


def test_hybrid_takes_names_then_synonyms_then_vectors(spark, terms):
    phrases = spark.createDataFrame([(1, "dna repair"), (1, "wall"), (2, "genome mending"), (2, "walls"), (3, "cell wall growth"), (3, "one")], "doc_id long, phrase string")
    hits = spark.createDataFrame([("dna repair", "GO:0000001", 1.0, 1), ("dna repair", "GO:0000004", 0.9, 2), ("cell wall growth", "GO:0000004", 0.95, 1), ("cell wall growth", "GO:0000002", 0.9, 2), ("one", "GO:0000002", 1.0, 1), ("genome mending", "GO:0000002", 0.5, 1)], "phrase string, term_id string, similarity double, rank int")
    got = vectors.annotate_hybrid(phrases, match.name_lookup_last_wins(terms), terms, hits)
    # A single word counts only as a component's name, a synonym only from two words on, a phrase brings its first new hit.
    assert {tuple(r) for r in got.collect()} == {(1, "GO:0000001", "name"), (1, "GO:0000003", "name"), (1, "GO:0000004", "vector"), (2, "GO:0000001", "synonym"), (3, "GO:0000004", "vector")}


def test_general_words_are_no_candidates(spark):
    hits = spark.createDataFrame([(1, 5, 1.0, "Pathway "), (1, 6, 0.9, "dna repair")], "doc_id long, term_id long, score double, span string")
    got = fusion.retrieve_candidates(hits, hits.where("false").drop("span"))
    assert [r["term_id"] for r in got.collect()] == [6]


def test_wide_scores(spark):
    from quillon.operators import metrics

    scored = spark.createDataFrame([("m", 1, "en", "easy", 1, 1, 0), ("m", 2, "zh", "hard", 0, 0, 2), ("n", 1, "en", "easy", 3, 0, 0)], "method string, case_id long, lang string, difficulty string, tp long, fp long, fn long")
    wide = metrics.prf_wide(scored, ("en", "zh"), ("easy", "hard"), "precision").orderBy("method").collect()
    assert [tuple(r) for r in wide] == [("m", 0.5, 0.5, 0.0, 0.5, 0.0), ("n", 1.0, 1.0, None, 1.0, None)]
    assert np.isclose(metrics.prf_wide(scored, (), ()).where("method = 'm'").first()["all"], 0.4)


@pytest.mark.parametrize("measure", ["cosine", "l2"])
def test_pruned_search_skips_groups_and_loses_none(measure):
    rng = np.random.RandomState(12)
    centres = rng.normal(size=(8, 16)) * 9
    x = np.concatenate([c + rng.normal(size=(50, 16)) / 9 for c in centres]).round(2)
    x = np.concatenate((x, x[::7]))  # ties
    ids, q = np.arange(len(x))[::-1].copy(), np.concatenate((x[:40:5], rng.normal(size=(3, 16))))
    pivots = x[rng.choice(len(x), 24, replace=False)]
    s = vectors.PrunedSearch(list(range(len(q))), q, pivots, 5, measure)
    for a in range(0, len(x), 180):
        s.show(vectors.gathered(ids[a : a + 180], x[a : a + 180], pivots))
    near = vectors._rounded(vectors._distances(q, x, measure))
    want = {(i, int(ids[j])) for i in range(len(q)) for j in np.lexsort((ids, near[i]))[:5]}
    assert {(r.query_id, r.node_id) for r in s.rows().itertuples()} == want
    assert s.met + s.skipped == len(q) * len(x) and s.skipped > s.met
