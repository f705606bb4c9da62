import numpy as np

from quillon.llm import decontaminate, ngram_join, topk_search


def brute_links(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = {d: set() for d in sets}
    ids = [d for d in sets if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    return links


def test_ngram_join_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    links = brute_links([tuple(r) for r in docs.collect()])
    group = {}
    for d in sorted(links):
        todo = [] if d in group else [d]
        while todo:
            x = todo.pop()
            if x not in group:
                group[x] = d
                todo += links[x]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_groups(docs).collect()}
    assert got == {d: (group[d], len(links[d])) for d in links}
    assert {r[0] for r in ngram_join.keep_one(docs).select("doc_id").collect()} == set(group.values())


def test_odd_rows(odd, none, spark):
    assert ngram_join.jaccard_groups(odd).count() == odd.count()
    assert ngram_join.keep_one(odd).columns == odd.columns
    assert ngram_join.jaccard_groups(none).count() == 0
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, "a b")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated_pairs(odd, items).collect()} == {(1, 1)}
    assert decontaminate.contaminated_pairs(none, items).count() == 0 and decontaminate.contaminated_pairs(odd, items.where("false")).count() == 0


def test_decontamination_slots(spark):
    item = "A train leaves at 9 and travels 60 km to the town where Anna waits for 3 hours before she goes home again."
    docs = spark.createDataFrame([(1, "Before. " + item + " After."), (2, "So " + item.replace("60", "85").replace("Anna", "Maria")), (3, "Nothing of the kind is written here at all, not even a train.")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in decontaminate.contaminated_pairs(docs, bench).collect()}
    assert got == {1: "exact", 2: "reparameterised"}


def test_top_k_odd_vectors(spark):
    rng = np.random.RandomState(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)] + [(200 + i, [0.5] * 8) for i in range(30)]
    rows += [(300, None), (350, [None] * 8), (400, [float("nan")] * 8), (None, [1.0] * 8), (450, [])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows[:150]}
    want = set()
    for q in (x for x in ints if x % 50 == 0):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in ints if i != q)[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in topk_search.top_k(docs).collect()} == want
