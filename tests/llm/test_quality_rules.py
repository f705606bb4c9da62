import re
from collections import Counter

from quillon.llm import quality_rules as qr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    inside = {i + j for i, x in enumerate(windows) if counts[x] > 1 for j in range(3)}
    n, chars, symbols, dup, rep = len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)
    failed = n < 50 or 100 * rep > 50 * n
    caps = sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in w)
    wordless = sum(not re.search(r"[A-Za-z\x80-\U0010FFFF]", x) for x in w)
    top = max(Counter(w).values(), default=0)
    bad = failed or 10 * symbols > n or chars < 3 * n or chars > 12 * n or 10 * dup > 3 * len(lines) or 2 * caps > n or 10 * text.count("!") > n or 4 * top > n or 5 * wordless > n
    return n, chars, symbols, dup, rep, failed, not bad


def test_equals_brute_force_in_any_order(small, odd, none):
    for docs in (small, odd):
        texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = sorted(str((d, *brute(t))) for d, t in texts)
        for order in (None, [r.name for r in reversed(qr.RULES)]):
            got = qr.digest(qr.cascade(docs, order=order))
            assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert qr.cascade(none).count() == 0


def test_order_is_by_rejections_per_unpaid_second():
    rules = (qr.Rule("dear", ("n_repeat_words",), bool), qr.Rule("cheap", ("n_symbols",), bool), qr.Rule("same", ("n_symbols", "n_words"), bool), qr.Rule("never", ("n_lines",), bool))
    seconds = {"words": 1.0, "n_words": 0.1, "n_repeat_words": 4.0, "n_symbols": 0.5, "lines": 0.1, "n_lines": 0.1}
    # dear alone rejects 60 of 100, cheap 30 (5 of them with dear), same nothing that cheap does not.
    groups = {0b001: 55, 0b111: 5, 0b110: 25, 0: 15}
    assert qr.choose_order(rules, seconds, groups) == ["cheap", "dear", "same", "never"]
    # With the words' windows paid for, dear costs nothing.
    assert qr.choose_order(rules, seconds, groups, ("n_repeat_words",))[0] == "dear"
    assert qr.choose_order(rules, {}, {}) == [r.name for r in rules]


def test_cascade_stops_at_the_first_rejection(small):
    done = qr.cascade(small, report=(), order=[r.name for r in qr.RULES])
    assert done.columns == ["doc_id", "n_tried", "rejected_by", "kept"]
    by = {r["rejected_by"]: r["n_tried"] for r in done.collect()}
    assert by["too_few_words"] == 1 and by["repeated_words"] == 2 and by[None] == len(qr.RULES)
    own = qr.Measured(b"too short")
    assert own.rejected(qr.RULES[0]) and set(own.known) == {"text", "words", "n_words"}


def test_labels(spark):
    d = "/root/testdata/sf0.01"
    judged = qr.cascade(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    long = judged.where("n_words >= 50")
    assert long.where("quality = 1").selectExpr("avg(if(kept, 1, 0))").first()[0] > 0.98
    assert judged.where("quality = 0 and kept").count() == 0
