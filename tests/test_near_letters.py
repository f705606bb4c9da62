"""Letters in common, by which pairs of a phrase and a name are judged before they are scored."""

import random

import numpy as np
import pandas as pd

from quillon.functions import vectorised as V


def _texts(rng: random.Random, n: int, low: int, high: int) -> list[str]:
    return ["".join(rng.choices("abcdeñ é", k=rng.randint(low, high))) for _ in range(n)]


def test_kinds_never_lose_a_common_letter():
    rng = random.Random(3)
    for high in (9, 64, 300):
        a, b = _texts(rng, 60, high, high), _texts(rng, 60, 1, min(high, 64))
        size = np.array([len(x) for x in b])
        x, y = V.letters(a, high), V.letters(b, int(size.max()))
        own = np.arange(y.shape[1]) < size[:, None]
        filled = np.where(own, y, 0xFFFFFFFF).astype(np.uint32)
        exact = V.common_letters(x, filled)
        assert (V.common_kinds(x, V.letter_masks(filled, own)) == exact).all()  # the letters are of kinds of their own
        shared = np.minimum(V.letter_counts(x, np.ones(x.shape, bool)), V.letter_counts(filled, own)).sum(1, dtype=np.int64)
        assert (shared >= exact).all()


def test_few_pairs_reach_the_subsequence_and_long_names_stay(monkeypatch):
    seen = []
    real = V.PartIndex.common
    monkeypatch.setattr(V.PartIndex, "common", lambda self, a, name: (seen.append(len(a)), real(self, a, name))[1])
    other, long = [f"xy{i:02d}wwww" for i in range(50)], "abcdefghij" * 7
    rows = [(8, 0, 0, "xy", n) for n in [*other, "xy99abcd"]] + [(70, 0, 0, "abcde", long)]
    index = V.PartIndex(pd.DataFrame(rows, columns=["lp", "i", "at", "part", "name_lc"]), 0.85)
    assert index.near(["xy99abce"], 8) == (["xy99abce"], ["xy99abcd"])
    assert sum(seen) == 1  # the other 50 share the part, but too few letters
    assert index.near([long[:-1] + "x"], 70) == ([long[:-1] + "x"], [long])
