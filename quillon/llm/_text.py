"""Vectorised word and shingle hashes over batches of UTF-8 text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows in an Arrow batch sent to Python; with long texts, small batches bound memory.
BATCH_ROWS = 256
#: Bytes of text that are hashed at once (a longer document is taken alone).
SLICE_BYTES = 1 << 21

_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_SPACE] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_ORDER = _rng.randint(1, 2**63 - 1, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_powers = np.cumprod(np.full(1024, _STEP, np.uint64), dtype=np.uint64)


def small_batches(spark) -> None:
    """Arrow batches of at most BATCH_ROWS rows for this session's Python stages."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _C1
    h = (h ^ (h >> np.uint64(29))) * _C2
    return h ^ (h >> np.uint64(32))


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about SLICE_BYTES of text."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))
    a = 0
    while a < len(ends):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE_BYTES, side="right"))
        b = max(a + 1, b)
        yield a, b
        a = b


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text); A-Z count as a-z, ASCII white space parts words."""
    global _powers
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    n = len(texts)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    solid = ~_SPACE[buf]
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & ~before)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    per_text = np.diff(np.concatenate((np.searchsorted(starts, begins), [len(starts)])))
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    reach = np.diff(np.append(starts, len(buf)))
    if (longest := int(reach.max())) > len(_powers):
        _powers = np.cumprod(np.full(2 * longest, _STEP, np.uint64), dtype=np.uint64)
    at = np.arange(starts[0], len(buf)) - np.repeat(starts, reach)
    h = np.add.reduceat(_BYTE[buf[starts[0] :]] * _powers[at], starts - starts[0])
    return mix(h), per_text


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-word shingle, shingles of each text).

    A text of fewer than k words, but not none, has one shingle of all its words.
    """
    if k > len(_ORDER):
        raise ValueError(f"shingles of at most {len(_ORDER)} words")
    number = np.where(per_text >= k, per_text - k + 1, np.minimum(per_text, 1))
    first = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    total = int(number.sum())
    if not total:
        return np.zeros(0, np.uint64), number
    offset = np.concatenate(([0], np.cumsum(number)[:-1]))
    start = np.arange(total) + np.repeat(first - offset, number)
    left = np.repeat(per_text, number)
    inside = np.minimum(left, k)
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    h = np.zeros(total, np.uint64)
    short = bool((inside < k).any())
    for t in range(k):
        part = padded[start + t] * _ORDER[t]
        h += np.where(inside > t, part, np.uint64(0)) if short else part
    return mix(h + inside.astype(np.uint64)), number


def spare_names(df: DataFrame, *names: str) -> list[str]:
    """``names`` with a lead that no column of ``df`` has, whatever its case."""
    lead = "__"
    while any(c.lower().startswith(lead) for c in df.columns):
        lead += "_"
    return [lead + n for n in names]
