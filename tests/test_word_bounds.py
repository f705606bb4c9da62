"""Windows judged by what each word has in common with each name: none that is close is lost, and few are spelt out."""

import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest

from quillon.functions import vectorised as V
from quillon.operators import match

STOP = ("the", "of")


def _made(rng: random.Random, chars: str) -> tuple[list[str], list[list[str]]]:
    word = lambda: "".join(rng.choices(chars, k=rng.randint(1, 9)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(30)] + ["x" * 40 + " " + "yz" * 20]
    docs = []
    for _ in range(40):
        words = [rng.choice((word(), rng.choice(STOP))) for _ in range(rng.randint(0, 30))]
        for name in rng.choices(names, k=4):
            near = list(name)
            near[rng.randrange(len(near))] = rng.choice(chars)
            words[rng.randint(0, len(words)) : 0] = "".join(near).split()
        docs.append(words)
    return names, [*docs, []]


@pytest.mark.parametrize(("chars", "band", "known"), [("abc", 10, 1 << 26), ("abcdefghijkñü", 10, 0), ("abcdefghijk-", None, 1 << 26)])
def test_no_close_window_is_lost(monkeypatch, chars, band, known):
    monkeypatch.setattr(V, "KNOWN_BYTES", known)
    monkeypatch.setattr(V, "GROWN", 16)
    judged, real = [], V.WordBounds.common
    monkeypatch.setattr(V.WordBounds, "common", lambda self, a, name: (judged.append(len(a)), real(self, a, name))[1])
    names, docs = _made(random.Random(11), chars)
    bounds, got = V.WordBounds(names, 0.85, band, 5, STOP), set()
    for part in (docs[:20], docs[20:], []):
        flat = pa.array([w for d in part for w in d], pa.string())
        got |= set(zip(*bounds.near(flat, np.array([len(d) for d in part], int)), strict=True))
    phrases = {" ".join(d[i : i + m]) for d in docs for m in range(2, 6) for i in range(len(d) - m + 1) if d[i] not in STOP and d[i + m - 1] not in STOP}
    met = [(p, n) for p in phrases for n in names if band is None or abs(len(p) - len(n)) <= band]
    want = {(p, n) for p, n in met if SequenceMatcher(None, p, n).ratio() >= 0.85}
    assert len(want) > 20 and want <= got
    if len(chars) > 3:
        assert sum(judged) < len(met) / 20


def test_near_names_of_few_names_are_those_of_the_index(spark, monkeypatch):
    rng = random.Random(12)
    names, docs = _made(rng, "abcdef")
    terms = spark.createDataFrame([(i, n, [], i) for i, n in enumerate(names)], "term_id long, name string, synonyms array<string>, ord long")
    texts = spark.createDataFrame([*((i, ", ".join(d)) for i, d in enumerate(docs)), (99, None)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(match, "best_fuzzy", None)
    few = sorted(map(tuple, match._near_names(texts, terms, 5, STOP, 0.85).collect()))
    monkeypatch.undo()
    monkeypatch.setattr(match, "WORD_NAMES", 0)
    assert few and few == sorted(map(tuple, match._near_names(texts, terms, 5, STOP, 0.85).collect()))
    none = terms.where("false")
    monkeypatch.undo()
    assert match._near_names(texts, none, 5, STOP, 0.85).isEmpty()
