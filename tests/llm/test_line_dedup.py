import re

from pyspark.sql import functions as F

from quillon.llm import line_dedup


def brute(rows, least):
    """Lines in a run of at least ``least`` words that stands earlier, over all pairs of places."""
    lines = []
    for doc, text in rows:
        own = [(i, s.strip(" \t\n\x0b\x0c\r")) for i, s in enumerate((text or "").split("\n"))]
        lines += [(doc, i, s, len(re.findall(r"[^\x20\x09-\x0D]+", s))) for i, s in own if re.search(r"[^\x20\x09-\x0D]", s)]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            run, words = 0, 0
            while b + run < len(lines) and lines[a + run][2] == lines[b + run][2] and lines[a + run][0] == lines[a][0] and lines[b + run][0] == lines[b][0]:
                words += lines[b + run][3]
                run += 1
                if words >= least:
                    gone |= {(lines[b][0], lines[b + k][1]) for k in range(run)}
    return gone


def deleted(out):
    return {(r["doc_id"], i) for r in out.where("deleted_runs is not null").collect() for x in r["deleted_runs"] for i in range(x["a"], x["b"] + 1)}


def test_equals_all_pairs_of_places(spark, small):
    rows = [(r[0], r[1]) for r in small.orderBy("doc_id").limit(60).select("doc_id", "text").collect()]
    shared = "\n".join(f"line {i} of a passage that is long enough to count as one" for i in range(8))
    rows += [(1000 + k, f"own start {k}\n{shared}\nown end {k}\n{shared}") for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (20, 50):
        assert deleted(line_dedup.dedup_lines(docs, min_words=least)) == brute(rows, least)


def test_lines_of_one_hash_are_told_by_their_text(spark):
    """With a hash of three values every line meets others of its hash; only equal texts are deleted."""
    words = [f"line {i} of a passage that counts" for i in range(9)]
    other = [f"line {i} of a passage that counted" for i in range(9)]
    texts = ["\n".join(words), "\n".join(other), "\n".join(words[1:]), "\n".join(other[:8] + words[:1]), "\n".join(words[:4] + other[4:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weak = lambda c: F.length(c).cast("long") % 3
    for least in (20, 50):
        assert deleted(line_dedup.dedup_lines(docs, min_words=least, line_hash=weak)) == brute(list(enumerate(texts)), least)


def test_odd_rows(odd, none, spark):
    out = line_dedup.dedup_lines(odd).collect()
    assert len(out) == odd.count()
    assert all(r["deleted_runs"] is None for r in out)
    assert [r["text"] for r in out if r["doc_id"] == 3] == [None]
    assert line_dedup.dedup_lines(none).count() == 0
    twice = spark.createDataFrame([(7, "w " * 60), (7, "w " * 60), (8, "w " * 60)], "doc_id long, text string")
    assert sorted((r[0], r[1]) for r in line_dedup.dedup_lines(twice).select("doc_id", "text").collect()) == [(7, "w " * 60), (7, "w " * 60), (8, "")]
