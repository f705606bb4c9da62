import uuid
from collections import Counter

import corpus_pipeline
from test_joins import brute_links
from test_token_files import brute

from quillon.llm import decontaminate, mixing, toxicity
from quillon.plans.shared import shared_dir

DIR = "/root/testdata/sf0.001"


def test_every_stage_works_on_what_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels, items = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    columns, rows = docs.columns, lambda d: [(r["doc_id"], r["text"]) for r in d.select("doc_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{shared_dir(spark)}/test-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, DIR).write.parquet(path)
        before, after = docs, spark.read.parquet(path)
        had, left = dict(rows(before)), [r["doc_id"] for r in after.select("doc_id").collect()]
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(before, labels).where("rejected").collect()}
            assert bad and sorted(left) == sorted(set(had) - bad)
        elif name == "ngram_jaccard":
            links, group = brute_links(had.items()), {}
            for d in sorted(links):
                todo = [] if d in group else [d]
                while todo:
                    if (x := todo.pop()) not in group:
                        group[x] = d
                        todo += links[x]
            assert sorted(left) == sorted(set(group.values())) and len(left) < len(had)
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.contaminated_pairs(before, items).collect()}
            passages = [r["text"] for r in items.collect()]
            assert {d for d, t in had.items() if any(p in (t or "") for p in passages)} <= bad
            assert sorted(left) == sorted(set(had) - bad)
        elif name == "mixing":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix_plan(before).collect()}
            words = Counter()
            for d, t in rows(after):
                words[d] += len((t or "").encode().split())
            assert all(words[d] == n for d, n in taken.items()) and max(Counter(left).values()) <= 2
        else:
            got = sorted((tuple(r) for r in after.collect()), key=lambda r: r[1])
            assert got == brute(rows(before))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.columns == columns
        docs = after
