import re

from quillon.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while True:
        level = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if level[s] > cap[s]}
        if not over:
            return out | level
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        free -= over


def test_targets_and_budgets(small):
    rows = mixing.mix_plan(small).collect()
    sizes, taken = {}, {}
    for r in small.select("source", "text").collect():
        sizes[r[0]] = sizes.get(r[0], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    goal = brute_targets(sizes)
    got = {r["source"]: r["target"] for r in rows}
    assert all(abs(got[s] - goal[s]) < 1e-6 * max(1, goal[s]) for s in sizes)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in sizes)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_plan(small.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in rows}


def test_mix_repeats_rows_by_plan(small):
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(small).collect()}
    words = {}
    for r in mixing.mix(small).select("doc_id", "text").collect():
        words[r[0]] = words.get(r[0], 0) + len(r[1].split())
    assert words == {k: v for k, v in plan.items() if v}
    assert mixing.mix(small).columns == small.columns


def test_odd_rows(odd, none):
    rows = mixing.mix_plan(odd).collect()
    assert len(rows) == odd.count()
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
