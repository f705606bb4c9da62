"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are packed into blocks. A block's index has, for each dimension, postings
grouped into LEVELS segments of near-equal value. With a query weight q, each
segment's impact is the most that its postings can add to a score, counted from the
least that the dimension adds. Segments of all dimensions are processed by
descending impact; scores grow in accumulators. After each round the sum of the
highest unprocessed impacts bounds what any vector can still gain: processing stops
only when this proves that no vector outside the possible members can enter the top
k, and the possible members are then scored exactly in integers. Equal vectors of a
block are one entry that keeps the k + 1 smallest ids.

Query blocks meet vector blocks one pair at a time; each pair gives at most k rows a
query, and the final rank is a window over these.

Defined cases: vectors that are null, empty or hold null or non-finite components
take no part, nor do rows without an id; ties go to the smaller id; a query meets
only vectors of its own length; rows of equal id are queries and candidates each on
its own, so only the query's own row is left out of its answers and each query row
has its own list; a table without rows gives none; extra columns, of whatever name,
are not read. Scores are exact; where length * largest query component * largest
component could reach 2**63 the search fails instead of wrapping.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import write_shared

LEVELS, ROUND = 16, 64
BLOCK_ROWS, QUERY_ROWS = 16384, 2048


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite


def _pack(rows: DataFrame, per_block: int, block: str) -> DataFrame:
    """(dim, block, ids, vecs): rows of (vec_id, v) packed by a hash of their id; blocks of about ``per_block`` rows."""
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / per_block).cast("int").alias("n_blocks"))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["vec_id"].to_numpy(np.int64)
        vecs = np.array(frame["v"].tolist(), np.int64).reshape(len(ids), -1)
        return pd.DataFrame({"dim": [key[0]], block: [key[1]], "ids": [ids.tobytes()], "vecs": [vecs.astype(np.int64).tobytes()]})

    placed = rows.withColumn("dim", F.size("v")).join(F.broadcast(sizes), "dim")  # a row for each vector length
    placed = placed.withColumn(block, F.pmod(F.xxhash64("vec_id", "v"), F.col("n_blocks")).cast("int"))
    return placed.select("dim", block, "vec_id", "v").groupBy("dim", block).applyInPandas(pack, f"dim int, {block} int, ids binary, vecs binary")


class ImpactIndex:
    """Postings of one block of integer vectors in segments of near-equal value."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vecs = ids[order], vecs[order]
        self.vecs, first = np.unique(vecs, axis=0, return_inverse=True)
        first = first.reshape(-1)
        by = np.argsort(first, kind="stable")
        cuts = np.concatenate((np.flatnonzero(np.diff(first[by], prepend=-1)), [len(by)]))
        # Of an entry's ids only the k + 1 smallest can be answers, one of which may be the query's own.
        self.ids = [np.sort(ids[by[a:b]])[: k + 1] for a, b in zip(cuts, cuts[1:], strict=False)]
        n, d = self.vecs.shape
        self.low, self.high = self.vecs.min(0), self.vecs.max(0)
        self.most = float(np.abs(self.vecs.astype(np.float64)).max())
        step = np.maximum(1, -(-(self.high - self.low + 1) // LEVELS))
        level = (self.vecs - self.low) // step
        self.postings, self.values, seg_dim, seg_min, seg_max = [], [], [], [], []
        for j in range(d):
            rank = np.argsort(level[:, j], kind="stable")
            ends = np.searchsorted(level[rank, j], np.arange(LEVELS + 1))
            for a, b in zip(ends, ends[1:], strict=False):
                if a < b:
                    own = rank[a:b]
                    self.postings.append(own)
                    self.values.append(self.vecs[own, j].astype(np.float64))
                    seg_dim.append(j)
                    seg_min.append(self.values[-1].min())
                    seg_max.append(self.values[-1].max())
        self.seg_dim, self.seg_min, self.seg_max = np.array(seg_dim), np.array(seg_min), np.array(seg_max)

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(vec_id, score) of the block's k best, best first, without one row of ``own``'s id and the query's vector."""
        q = query.astype(np.float64)
        reach = len(q) * float(np.abs(q).max()) * self.most
        if reach >= 2.0**63:
            raise ValueError(f"inner products may reach {reach:.3g}, beyond 64 bits")
        base = np.minimum(q * self.low, q * self.high)
        ends = q[self.seg_dim] * self.seg_min, q[self.seg_dim] * self.seg_max
        impact = np.maximum(*ends) - base[self.seg_dim]
        order = np.argsort(-impact, kind="stable")
        # What is left for a vector is at most the sum of each dimension's highest unprocessed impact.
        top = np.zeros(len(q))
        np.maximum.at(top, self.seg_dim, impact)
        n, need = len(self.vecs), min(k + 1, len(self.vecs))
        scores, left = np.zeros(n), float(top.sum())
        waiting = [[] for _ in q]
        for s in order:
            waiting[self.seg_dim[s]].append(impact[s])
        done = [0] * len(q)
        for a in range(0, len(order), ROUND):
            for s in order[a : a + ROUND]:
                j = self.seg_dim[s]
                scores[self.postings[s]] += q[j] * self.values[s] - base[j]
                done[j] += 1
            left = sum(w[i] for w, i in zip(waiting, done, strict=True) if i < len(w))
            kth = np.partition(scores, n - need)[n - need]
            if left <= 0 or np.count_nonzero(scores + left >= kth) <= 4 * need:
                break
        kth = np.partition(scores, n - need)[n - need]
        # Sums of doubles err by far less than this share of the largest sum.
        members = np.flatnonzero(scores + left >= kth - 1e-6 * (1 + abs(kth)) - reach * 2.0**-40)
        exact = self.vecs[members] @ query
        best = []
        for at in np.argsort(-exact, kind="stable"):
            if len(best) >= k and exact[at] < best[k - 1][1]:
                break
            ids = self.ids[members[at]].tolist()
            if own in ids and np.array_equal(self.vecs[members[at]], query):
                ids.remove(own)
            best += [(i, int(exact[at])) for i in ids]
            best.sort(key=lambda x: (-x[1], x[0]))
        return best[:k]


def top_k(vectors: DataFrame, *, k: int = 5, query: Column | None = None, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``vectors(vec_id, embedding)``; queries are the rows where ``query`` holds."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select("vec_id", quantised(F.col("embedding"), scale).alias("v"))
    asked = rows.where(query if query is not None else F.col("vec_id") % 50 == 0)
    blocks = write_shared(_pack(rows, BLOCK_ROWS, "block"), "vector-blocks")
    queries = write_shared(_pack(asked, QUERY_ROWS, "qblock").withColumnsRenamed({"ids": "qids", "vecs": "qvecs"}), "query-blocks")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = blocks.join(queries, "dim").repartition(n, "dim", "block", "qblock").sortWithinPartitions("dim", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["dim"], row["block"]) != last:
                    last = row["dim"], row["block"]
                    index = ImpactIndex(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.int64).reshape(-1, row["dim"]), k)
                asked = zip(np.frombuffer(row["qids"], np.int64).tolist(), np.frombuffer(row["qvecs"], np.int64).reshape(-1, row["dim"]), strict=True)
                found = [(row["dim"], row["qblock"], at, own, vec, score) for at, (own, q) in enumerate(asked) for vec, score in index.search(q, own, k)]
                columns = list(zip(*found, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))

    kinds = {"dim": pa.int32(), "qblock": pa.int32(), "at": pa.int32(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
    found = pairs.mapInArrow(search, "dim int, qblock int, at int, query_id long, vec_id long, score long")
    # A query row is known by its place in its block, as ids may repeat.
    best = Window.partitionBy("dim", "qblock", "at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256.0::DOUBLE * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
