"""Text around tokens is made from pieces, and only for the tokens that start a name."""

import pytest

from quillon.operators import match


def texts():
    odd = ["", None, "  ", "one", " one", "one. ", "..a b\n\nc", "ÉTÉ ǅ İx_y-z/w 東京 éa \U0001d54f‍ q", "x" * 300 + " y"]
    return odd + [" ,"[n % 2] + " - ".join(f"w{i}" for i in range(n)) for n in (7, 8, 9, 15, 16, 17, 24, 40, 300)]


@pytest.mark.parametrize("reach", [0, 4, 7, 12])
def test_tokens_of_pieces_are_those_of_the_text(spark, reach):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(3)
    want = {(r["doc_id"], r["j"]): (r["start"], r["t"], r["t"] + r["ahead"], r["behind"][::-1]) for r in match.token_rows(docs, reach).collect()}
    rows = match.around(match.token_pieces(docs, reach), reach).collect()
    assert len(rows) == len(want) > 400
    for r in rows:
        start, t, near, behind = want[r["doc_id"], r["j"]]
        assert (r["start"], r["t"], r["near"]) == (start, t, near) and r["upto"].endswith(behind)


def test_names_are_found_without_the_text_around_every_token(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The cell  Cycle of a cell wall, the cell. " * 40)], "doc_id long, text string")
    names = spark.createDataFrame([("cell", 1), ("cell cycle", 2), ("wall cell cell cell cell cell", 3), ("the wall", 4)], "name_lc string, term_id int")
    monkeypatch.setattr(match, "token_rows", None)
    rows = match._windows_of_names(docs, names, 5, ("the", "of", "a")).collect()
    text = docs.first()["text"]
    assert all(text[r["win_start"] : r["win_start"] + len(r["window"])] == r["window"] for r in rows)
    found = {(r["term_id"], r["window"]) for r in rows}
    assert found == {(1, w) for w in ("cell", "The cell", "the cell", "a cell", "of a cell", "cell. The", "the cell. The")} | {(2, w) for w in ("cell  Cycle", "The cell  Cycle", "cell  Cycle of", "The cell  Cycle of", "cell  Cycle of a", "The cell  Cycle of a")}
    assert sum(r["term_id"] == 2 and r["window"] == "cell  Cycle" for r in rows) == 40
