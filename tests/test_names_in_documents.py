"""Documents of a name, found by words alone."""

from quillon.functions import text as T
from quillon.operators import match

TEXTS = [(1, "Of the DNA/repair  in cell-wall; The Cell and\nthe wall of"), (2, ""), (3, None), (4, "cell " * 40 + "and wall"), (5, "..é cell, и Wall!")]


def test_documents_of_names_equal_their_windows(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    names = spark.createDataFrame([("cell", "c", True, 1), ("the wall", "s", True, 2), ("cell and the wall", "w", True, 4), ("cell cell", "cc", True, 2), ("и wall", "u", True, 2)], "name_lc string, term_id string, is_primary boolean, n_tokens int")
    want = match._windows_of_names(docs, names, 8, T.DICT_STOPWORDS).select("doc_id", "name_lc", "term_id").distinct().collect()
    monkeypatch.setattr(match, "token_rows", None)  # no text around tokens is made
    got = match.docs_of_names(docs, names, 8, T.DICT_STOPWORDS).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 6
