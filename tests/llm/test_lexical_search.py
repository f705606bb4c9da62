import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import lexical_search as ls


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    counted = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, i, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    own = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text")
    odd = [(None, "seven words"), (7001, None), (7001, ""), (7002, "one two"), (7002, "One, two; three"), (7003, "nowhere_at-all?"), (7004, "é" * 5000), (7005, "word")]
    return own.unionByName(spark.createDataFrame(odd, "item_id long, text string")).withColumn("rank", F.lit("x"))


def test_equals_brute_force_in_one_block_and_in_many(spark, small, odd, items):
    asked = [tuple(r) for r in items.select("item_id", "text").collect()]
    docs = small.unionByName(odd.select(*small.columns)).withColumn("terms", F.lit(1)).withColumn("score", F.lit("s"))
    want = brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], asked)
    assert len({w[0] for w in want}) > 40
    assert rows(ls.search(docs, items)) == want
    assert rows(ls.search(docs.repartition(13), items, max_postings=90)) == want
    assert rows(ls.search(docs, items, k=2)) == brute([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], asked, 2)


def test_empty_tables(spark, small, none, items):
    assert ls.search(none, items).count() == 0
    assert ls.search(small, items.limit(0)).count() == 0
    assert ls.search(small.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def test_additions_in_small_pieces_do_not_change_scores(monkeypatch):
    import numpy as np

    index = ls.ItemIndex([(5, [b"a", b"b"]), (9, [b"b", b"c"])])
    scores = np.zeros((2, 2), np.int64)
    index.add(scores, np.array([0, 0, 1]), np.array([index.number[t] for t in (b"a", b"b", b"c")]), np.array([1, 10, 100]))
    assert scores.tolist() == [[11, 10], [0, 100]]
    heaps = ls.Heaps(2, 1)
    heaps.offer(scores, [4, 3])
    heaps.offer(np.array([[11, 100]]), [2])
    heaps.offer(np.array([[11, 100]]), [None])
    assert sorted(heaps.rows()) == [(0, 2, 11), (1, 2, 100)]
