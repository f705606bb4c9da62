"""Tables that already have columns of a result's names: these are replaced, all others pass through."""

from pyspark.sql import functions as F

from quillon.llm import line_dedup, toxicity, url_filter
from quillon.plans import shared

RUN = "\n".join(f"line {i} of a passage that is long enough to count as one" for i in range(8))


def test_line_dedup(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"start {k}\n{RUN}\nend {k}", 7, "x", 1) for k in range(6)], "doc_id long, text string, deleted_runs int, w string, n int")
    want = sorted((r["doc_id"], r["text"], r["w"]) for r in line_dedup.dedup_lines(docs).collect())
    assert [t for d, t, _ in want if d] == [f"start {k}\nend {k}" for k in range(1, 6)]
    monkeypatch.setattr(shared, "HOT_ROWS", 1)  # every place is hot
    assert sorted((r["doc_id"], r["text"], r["w"]) for r in line_dedup.dedup_lines(docs).collect()) == want


def test_url_filter(spark):
    rows = [(1, "http://a.net/es/1", "h", "p", 5, "l"), (1, "http://a.net/es/1", "h", "p", 5, "l"), (2, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, hit int, label string")
    out = url_filter.filter_urls(pages)
    assert out.columns == ["page_id", "url", "hit", "label", "host", "path", "rule", "template", "purity", "verdict"]
    got = sorted(map(tuple, out.select("page_id", "host", "path", "hit", "verdict").collect()))
    assert got == [(1, "a.net", "/es/1", 5, "block")] * 2 + [(2, "", "", None, "allow")]


def test_toxicity(spark):
    texts = [(i, "bad words here" if i % 2 else "good words there") for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select("*", F.lit("x").alias("p_toxic"), F.lit(3).alias("rejected"), F.lit(1).alias("words"))
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels)
    assert out.columns == ["doc_id", "text", "words", "p_low_quality", "p_toxic", "rejected"]
    assert {r["doc_id"] for r in out.where("rejected").collect()} == set(range(1, 20, 2))


def test_toxicity_counts_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "HOLD", 1)  # counts are passed on after each batch
    rows = [("One, two two", 1, 0), ("two three!", 0, 1), (None, 1, 1), ("", 0, 0), ("threefold threefolds", 1, 1)]
    got = {r["feature"]: (r["n"], r["a"], r["b"]) for r in toxicity.feature_counts(spark.createDataFrame(rows * 3, "text string, a int, b int"), ["a", "b"]).collect()}
    want = {"": (15, 9, 9)}
    for text, a, b in rows * 3:
        for f in {f for w in (text or "").lower().split() for f in toxicity.word_features(w)}:
            n, x, y = want.get(f, (0, 0, 0))
            want[f] = (n + 1, x + a, y + b)
    assert got == want
