"""Ranked lexical search, reversed: the items' terms are the index, the documents stream by.

There are few items and many documents, so the inverted index is built over the items'
terms and broadcast, and no index of the documents exists:

1. every document is cut into terms once; its number of terms and the counts of those
   that some item holds are written as a table;
2. corpus figures (documents, terms, documents per term) are aggregated from it;
3. every task streams its documents' counts through the index, adds up the scores of a
   few documents by item, and keeps a heap of the k best documents of each item;
4. the tasks' heaps, k rows an item and task at most, are merged by rank.

The broadcast is bounded: items are counted in postings (item, term) and, beyond
MAX_POSTINGS, dealt by a hash to blocks of about that many, each of which takes its own
pass over the documents. An item is never cut, so a block may be larger by its last one.

Scores are integers, so neither partitions nor the order of addition matter.

Defined cases: null and empty texts have no terms, count in no figure and are never
found; items without terms get no rows; items of equal or null id are ranked each on its
own; rows of equal doc_id are documents each on its own, and equal scores go to the
smaller doc_id, null last; very long texts are read whole; an empty table on either side
gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import write_shared
from ._text import small_batches

MAX_POSTINGS = 1 << 19
#: Scores added up at once.
CELLS = 1 << 21
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; all other ASCII characters but letters and digits part terms."""
    return text.translate(_TERMS).split() if text else []


class ItemIndex:
    """Postings of the items' terms, by number; ``weights`` are added once the corpus is counted."""

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        self.items = np.array([i for i, _ in items], np.int64)
        postings: dict[bytes, list[int]] = {}
        for at, (_, terms) in enumerate(items):
            for term in terms:
                postings.setdefault(term, []).append(at)
        self.number = {term: i for i, term in enumerate(postings)}
        self.sizes = np.fromiter(map(len, postings.values()), np.int64, len(postings))
        self.begins = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.postings = np.fromiter((x for own in postings.values() for x in own), np.int64, int(self.sizes.sum()))

    def add(self, scores: np.ndarray, row: np.ndarray, term: np.ndarray, gain: np.ndarray) -> None:
        """Add each (row, term)'s gain to the row's score for all items that hold the term."""
        sizes = self.sizes[term]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(first - self.begins[term], sizes)
        np.add.at(scores.reshape(-1), np.repeat(row * scores.shape[1], sizes) + self.postings[at], np.repeat(gain, sizes))


class Heaps:
    """The k best (score, doc_id) of each item; equal scores go to the smaller id, null last."""

    def __init__(self, n: int, k: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(n)], np.ones(n, np.int64)

    def offer(self, scores: np.ndarray, ids: list) -> None:
        for at, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.floor)), strict=True):
            heap, doc = self.heaps[item], ids[at]
            entry = int(scores[at, item]), -(1 << 63) if doc is None else -doc
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [(item, None if at == -(1 << 63) else -at, score) for item, heap in enumerate(self.heaps) for score, at in heap]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_no, item_id, terms): the distinct terms of each item that has any, written once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(x))) for x in batch["text"].cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])

    found = items.select("item_id", "text").mapInArrow(cut, f"item_id {kind}, terms array<binary>")
    return write_shared(found.where("size(terms) > 0").withColumn("item_no", F.monotonically_increasing_id()), "search-items")


def count_terms(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): all terms of each document that has any, and its counts of the index's terms."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = known.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                found = terms_of(text)
                own = {index[t]: c for t, c in Counter(found).items() if t in index}
                n.append(len(found))
                terms.append(list(own))
                tfs.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")
    return write_shared(rows.where("n > 0"), "search-counts")


def _best(counts: DataFrame, index: ItemIndex, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item_no, doc_id, score): each task's k best documents of each item."""
    shared = counts.sparkSession.sparkContext.broadcast((index, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weights = shared.value
        n_items = len(index.items)
        heaps = Heaps(n_items, k)
        for batch in batches:
            size = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            term, tf = (batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "tfs"))
            row, ids = np.repeat(np.arange(batch.num_rows), size), batch["doc_id"].to_pylist()
            m = np.array([10 + 90 * n * n_docs // n_terms for n in batch["n"].to_pylist()], np.int64)
            gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
            # As many documents at once as keep both the scores and the additions below CELLS, one at least.
            cost = np.cumsum(np.bincount(row, index.sizes[term], batch.num_rows) + n_items)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CELLS, side="right")))
                x, y = np.searchsorted(row, (a, b))
                scores = np.zeros((b - a, n_items), np.int64)
                index.add(scores, row[x:y] - a, term[x:y], gain[x:y])
                heaps.offer(scores, ids[a:b])
                a = b
        rows = heaps.rows()
        yield pa.RecordBatch.from_arrays([pa.array(index.items[[r[0] for r in rows]] if rows else [], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item_no", "doc_id", "score"])

    return counts.mapInArrow(search, "item_no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, max_postings: int = MAX_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best of ``docs(doc_id, text)`` for ``items(item_id, text)``."""
    small_batches(docs.sparkSession)
    asked = item_terms(items)
    n_blocks = math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / max_postings) or 1
    found = None
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("item_no"), F.lit(n_blocks)) == block).select("item_no", "terms").collect()  # about max_postings terms
        index = ItemIndex([(r["item_no"], [bytes(t) for t in r["terms"]]) for r in own])
        counts = count_terms(docs, index.number)
        n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(index.number), np.int64)
        for term, n in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        best = _best(counts, index, weights, n_docs, n_terms or 1, k)
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(ws))::BIGINT AS big_l FROM d WHERE len(ws) > 0),
tf AS (SELECT doc_id, len(ws)::BIGINT AS n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, ws, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY doc_id, ws, term),
w AS (SELECT term, floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN c GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
      FROM i JOIN tf USING (term) JOIN w USING (term) CROSS JOIN c GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
