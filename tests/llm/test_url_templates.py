from pyspark.sql import functions as F

from quillon.llm import url_filter


def test_unlabelled_branches_are_judged_by_parent_and_host(spark):
    rows = [(i, f"http://bad.net/es/{i}") for i in range(20)] + [(100 + i, f"http://bad.net/en/{i}") for i in range(5)]
    rows += [(200 + i, f"http://mix.org/spam/a/{i}") for i in range(20)] + [(300 + i, f"http://mix.org/good/a/{i}") for i in range(30)]
    rows += [(400, "http://mix.org/spam/b/1"), (401, "http://mix.org/good/b/1"), (402, "http://mix.org/x/1"), (403, "http://none.org/x/1"), (404, "http://one.org/a/b/c/d/e/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    p = F.col("page_id")
    label = F.when((p < 20) | p.between(200, 219) | (p == 404), "block").when(p.between(300, 329), "allow")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, labels=label).collect() if r["page_id"] >= 100}
    assert {i for i, v in got.items() if v == "block"} == {*range(100, 105), *range(200, 220), 400}
