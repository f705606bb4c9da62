import re

from pyspark.sql import functions as F

from quillon.llm import url_filter


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_rules_equal_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "no scheme/en/"), (-4, "HTTP://WWW.Example.COM/en/x?a://b"), (-5, "x://net"), (-6, "x://a.net/es/" + "s/" * 500), (None, "x://b.org/q#f")], "page_id long, url string")
    both = pages.unionByName(odd).withColumn("n", F.lit(1))
    got = url_filter.filter_urls(both).collect()
    assert len(got) == both.count()
    for r in got:
        host, path, rule, verdict = brute(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_templates_reject_by_purity(spark):
    rows = [(i, f"http://h.org/spam/{i}") for i in range(40)] + [(100 + i, f"http://h.org/good/{i}") for i in range(40)]
    rows += [(200 + i, f"http://h.org/u/name{i}x") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    label = F.when(F.col("page_id") < 20, "block").when((F.col("page_id") >= 100) & (F.col("page_id") < 120), "allow")
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels=label).collect()}
    assert all(out[i]["verdict"] == "block" for i in range(40)) and all(out[i]["verdict"] == "allow" for i in range(100, 240) if i in out)
    assert len({out[i]["template"] for i in range(200, 240)}) == 1


def test_empty(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
