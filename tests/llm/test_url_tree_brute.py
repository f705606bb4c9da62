"""Tree, purity and verdicts of the URL filter against a plain version."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillon.llm import url_filter

DEPTH, WIDTH, Z, PURITY, PRIOR, LEAST = 6, 12, 1.96, 0.8, 4.0, 3


def shape_of(path):
    parts = (path[1:] if path.startswith("/") else path).split("/")[:DEPTH]
    return tuple("*" if re.search(url_filter.VARIABLE, p) else p for p in parts)


def brute(rows):
    """{(host, shape): (template, purity, verdict)} of (host, path, label) rows."""
    count = defaultdict(lambda: [0, 0, 0])
    for host, path, label in rows:
        for i, hit in enumerate((True, label is not None, label == "block")):
            count[host, shape_of(path)][i] += hit
    prefix = dict.fromkeys(count, ())
    for i in range(DEPTH):
        kids = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
        for (host, shape), c in count.items():
            if len(shape) > i:
                for j in range(3):
                    kids[host, prefix[host, shape]][shape[i]][j] += c[j]
        grown = dict(prefix)
        for host, shape in count:
            if len(shape) <= i:
                continue
            below = kids[host, prefix[host, shape]]
            n, l, b = (sum(c[j] for c in below.values()) for j in range(3))
            wide = len(below) > WIDTH and max(c[0] for c in below.values()) / n < 0.5
            _, cl, cb = below[shape[i]]
            name = shape[i]
            if wide or name == "*":
                name = "*"
            elif cl and abs(cb / cl - b / l) <= Z * math.sqrt(b / l * (1 - b / l) / cl):
                name = "*alike"
            grown[host, shape] = (*prefix[host, shape], name)
        prefix = grown
    rate = (sum(c[2] for c in count.values()) + 1) / (sum(c[1] for c in count.values()) + 2)
    every = sum(c[1] for c in count.values())
    out = {}
    for (host, shape), template in prefix.items():
        steps = []
        for i in range(len(template) + 1):
            mine = {s for (h, s), t in prefix.items() if h == host and t[:i] == template[:i]}
            raws = {s[:i] for s in mine}
            own = [sum(count[host, s][j] for s in mine) for j in (1, 2)]
            other = [sum(c[j] for (h, s), c in count.items() if h != host and len(s) >= i and s[:i] in raws) if i else 0 for j in (1, 2)]
            steps.append((own, other))
        p = rate
        for (own, other), below in zip(steps, [*steps[1:], (None, None)]):
            l, b = own if own != below[0] else (0, 0)
            ol, ob = other if other != below[1] else (0, 0)
            p = (b + PRIOR * ((ob + PRIOR * p) / (ol + PRIOR))) / (l + PRIOR)
        enough = max(a[0] + o[0] for a, o in steps) >= LEAST or (every >= LEAST and rate >= PURITY)
        out[host, shape] = ("/" + "/".join(template), p, "block" if enough and p >= PURITY else "allow")
    return out


def random_pages(seed):
    rng = random.Random(seed)
    rows = []
    for host in [f"h{i}.org" for i in range(8)]:
        for _ in range(rng.choice((1, 5, 60))):
            lang = rng.choice(("en", "de", "spam", "x"))
            tail = rng.choice(("", f"/{rng.randrange(99)}", f"/slug{rng.randrange(40)}", "/a/b", "/a/c/d/e/f/g/h/", "//"))
            bad = rng.random() < {"en": 0.5, "de": 0.05, "spam": 0.97, "x": 0.3}[lang]
            rows.append((host, f"/{lang}{tail}", rng.choice((None, "block" if bad else "allow")) if host != "h7.org" else None))
    return rows + [("", "", None), ("h0.org", "", "allow")]


@pytest.mark.parametrize("hot", [4096, 2])
def test_equals_plain_version(spark, monkeypatch, hot):
    monkeypatch.setattr("quillon.plans.shared.HOT_ROWS", hot)
    rows = [x for seed in range(3) for x in [(f"{seed}-{h}" if h else "", p, lb) for h, p, lb in random_pages(seed)]]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", lb) for i, (h, p, lb) in enumerate(rows)], "page_id long, url string, lb string")
    got = url_filter.filter_urls(pages, rules=(), labels=F.col("lb")).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        template, purity, verdict = want[r["host"], shape_of(r["path"])]
        assert (r["template"], r["verdict"]) == (template, verdict), r
        assert abs(r["purity"] - purity) < 1e-9


def test_a_path_without_labels_is_judged_by_other_hosts(spark):
    rows = [(i, f"http://a{i % 3}.net/es/{i}", "block") for i in range(30)] + [(100 + i, f"http://b{i % 3}.com/de/{i}", "allow") for i in range(30)]
    rows += [(200, "http://a0.net/de/1", None), (201, "http://new.org/es/1", None), (202, "http://new.org/de/1", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, lb string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, labels=F.col("lb")).collect()}
    assert (got[200], got[201], got[202]) == ("allow", "block", "allow")
