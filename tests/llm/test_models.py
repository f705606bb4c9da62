import math
import re
import zlib
from collections import Counter

from quillon.llm import lm_scoring, toxicity

DIR = "/root/testdata/sf0.01"


def test_language_model(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    rows = {r[0]: r[1] or "" for r in docs.collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    words = {d: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for d, t in rows.items()}
    counts = Counter(w for d, own in words.items() if not held(d) for w in own)
    n, v = sum(counts.values()), len(counts)
    model, base = 0.0, 0.0
    for r in lm_scoring.lm_scores(docs).collect():
        own = words[r["doc_id"]]
        want = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(own), sum(w in counts for w in own), n)
        assert math.isclose(r["base_score"], want, rel_tol=1e-9) and r["score"] < 0
        if r["held_out"]:
            model, base = model + r["score"], base + r["base_score"]
    assert model > base


def test_toxicity_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.toxicity(docs, labels.where("doc_id % 4 <> 0")).join(labels.where("doc_id % 4 = 0"), "doc_id")
    got = Counter((r["toxic"], r["rejected"]) for r in out.select("toxic", "rejected").collect())
    assert got[1, True] / (got[1, True] + got[1, False]) > 0.85
    assert got[0, True] / (got[0, True] + got[0, False]) < 0.02


def test_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(odd, labels).count() == odd.count()
    assert toxicity.toxicity(odd, labels.where("false")).where("rejected").count() == 0
    assert lm_scoring.lm_scores(odd).count() == odd.count()
    assert toxicity.toxicity(none, labels).count() == 0 and lm_scoring.lm_scores(none).count() == 0
