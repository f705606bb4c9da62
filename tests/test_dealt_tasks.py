"""Tasks whose share does not grow with the input."""

import quillon.plans.shared as shared
from quillon.operators import fusion, metrics


def test_cases_are_dealt_by_rows_and_null_ids_match_none(spark, monkeypatch):
    monkeypatch.setattr(shared, "DEALT_ROWS", 2)
    pred = spark.createDataFrame([("m", c, t) for c in range(30) for t in (c, None)] + [("other", 1, 1)], "method string, case_id int, term_id int")
    gold = spark.createDataFrame([(c, t) for c in range(30) for t in (c, c, None, c + 1)], "case_id int, term_id int")
    cases = spark.createDataFrame([(c, "en", "d") for c in range(31)], "case_id int, lang string, difficulty string")
    out = metrics.score_cases(pred, gold, cases, spark.createDataFrame([("m",), ("m",)], "method string"))
    assert out.rdd.getNumPartitions() > 80  # 181 rows
    rows = sorted(map(tuple, out.collect()))
    assert rows == [("m", c, "en", "d", 1, 1, 2) for c in range(30)] + [("m", 30, "en", "d", 0, 0, 0)]


def test_candidates_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "DEALT_ROWS", 2)
    hits = spark.createDataFrame([(d, d % 4, 0.9, f"s{d}") for d in range(100)], "doc_id int, term_id int, score double, span string")
    near = spark.createDataFrame([(d, d % 4, 0.95, "x") for d in range(50)], "doc_id int, term_id int, score double, span string")
    out = fusion.retrieve_candidates(hits, near)
    assert out.rdd.getNumPartitions() > 70  # 150 rows
    assert sorted(map(tuple, out.collect())) == [(d, d % 4, *((0.95, "vector") if d < 50 else (0.9, "dict")), 1) for d in range(100)]


def test_cases_go_to_few_enough_partitions_that_none_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(shared, "DEALT_ROWS", 2)
    pred = spark.createDataFrame([("m", c, t) for c in range(200) for t in (c, c + 1)], "method string, case_id int, term_id int")
    gold = spark.createDataFrame([(c, c) for c in range(200)], "case_id int, term_id int")
    cases = spark.createDataFrame([(c, "en", "d") for c in range(200)], "case_id int, lang string, difficulty string")
    out = metrics.score_cases(pred, gold, cases, spark.createDataFrame([("m",)], "method string"))
    assert out.rdd.getNumPartitions() == 200  # 600 rows, 301 parts by rows alone
    assert sorted(map(tuple, out.collect())) == [("m", c, "en", "d", 1, 1, 0) for c in range(200)]
    assert [shared.parts_unsorted(n) for n in (0, 5, 3200, 32000)] == [1, 3, 201, 2001]
