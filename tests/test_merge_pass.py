"""Merging in one list a document gives what its steps give one after another, and scores a candidate once."""

import random

from pyspark.sql import functions as F

from quillon.operators import merge, ontology


def test_one_pass_equals_the_steps(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame([(k, p) for k in range(3, 60) for p in {(k - 3) // 3, (k - 3) // 4}], "child long, parent long")
    nodes = spark.createDataFrame([(k,) for k in range(60)], "term_id long")
    labels, depths = ontology.reach_labels(nodes, edges), ontology.node_depths(nodes, edges, [0, 1, 2])
    names, spaces = ("DNA repair", "genome maintenance", "translation", "b c", " "), (*merge.LIMITS, "other")
    rows = [(d, rng.randrange(60), pos, rng.choice(("", "dna repair", "c")), rng.randrange(20) / 20) for d in range(40) for pos in range(d % 14)]
    rows = [(*r, names[r[1] % 5], spaces[r[1] % 4]) for r in rows]
    c = spark.createDataFrame(rows, "doc_id long, term_id long, pos int, span string, score double, name string, namespace string")
    docs = spark.createDataFrame([(d, "b/c of DNA repair" if d % 2 else "") for d in range(40)], "doc_id long, text string")
    out = merge.merge_terms(docs, c, labels, depths)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("row_number() windowspecdefinition") == 1
    scored = merge._best(merge.merge_score(c, docs, depths))
    kept = merge.limit_per_namespace(merge.drop_cluster_conflicts(merge.cluster_of(merge.drop_hierarchy_conflicts(scored, labels))))
    want = {}
    for r in scored.select("doc_id", "term_id").collect():
        want.setdefault(r["doc_id"], (set(), []))[0].add(r["term_id"])
    for r in kept.orderBy("doc_id", "namespace", F.desc("final"), "term_id").collect():
        want[r["doc_id"]][1].append(r["term_id"])
    assert {r["doc_id"]: (r["kept"], r["dropped"]) for r in out.collect()} == {d: (k, sorted(a - set(k))) for d, (a, k) in want.items()}
    assert any(len(k) > 3 for _, k in want.values())
