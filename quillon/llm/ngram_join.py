"""N-gram Jaccard join with Bayesian pruning of candidates.

Two texts are linked if their sets of ``SHINGLE``-word shingles (A-Z lower-cased,
ASCII white space parts words) have a Jaccard similarity of at least ``THRESHOLD``.

1. One pass hashes each text: a 128-bit hash of its shingle set and HASHES MinHash
   values. Texts of equal sets are one class, of which one representative goes on.
2. Bands of ROWS values put representatives into buckets; a pair of the threshold
   shares none with a probability of (1 - THRESHOLD**ROWS)**BANDS = 3e-6. Buckets of
   the same members are looked at once.
3. Within buckets MinHash values are compared STEP at a time; a pair is dropped when
   the posterior probability (flat prior) of reaching the threshold falls below
   TOLERANCE. A bucket of many members is cut into chunks by hash and each pair of
   chunks is a unit of its own. What remains ties representatives into candidate
   groups, each unit giving at most one tie a member.
4. The candidates' shingles are made again from their texts, and every pair of a
   candidate group is verified exactly, again by pairs of chunks; only counts of
   links and ties leave a unit, so no list of all pairs exists anywhere.

Defined cases: texts without words are linked to nothing, each its own class; texts
of 1 to 4 words have one shingle of all of them; rows equal in text are copies of
each other; null ids are ids like any other; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.shared import broadcast_if, write_shared
from ._text import mix, shingle_hashes, slices, small_batches, spare_names, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 4, 24
HASHES = ROWS * BANDS
STEP, TOLERANCE = 16, 1e-5
CHUNK, CHUNK_BYTES = 512, 8 << 20
#: Candidates whose keys may be broadcast to find their texts; beyond, the join is shuffled.
BROADCAST_KEYS = 1 << 18

_rng = np.random.RandomState(77)
_XOR = _rng.randint(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.randint(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """Fewest matches among n MinHash values that keep a pair."""
    grid = (np.arange(20000) + 0.5) / 20000
    high = grid >= threshold
    for m in range(n + 1):
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max())
        if p[high].sum() >= tolerance * p.sum():
            return m
    return n


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, each text's sorted shingles, all shingles, how many of each text."""
    for a, b in slices(column):
        texts = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in column[a:b]]
        hashes, number = shingle_hashes(*word_hashes(texts), k)
        cuts = np.cumsum(number)[:-1]
        yield a, [np.unique(x) for x in np.split(hashes, cuts)], hashes, number


def signatures(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(rid, doc_id, row_hash, k1, k2, n, sig) of each row; k1, k2 and sig are null without words."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "row_hash", "k1", "k2", "n", "sig"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            sig, k1, k2, n = [], [], [], []
            for _, sets, hashes, number in _sets(batch["text"], k):
                n += [len(s) for s in sets]
                k1 += [int(s.sum().view(np.int64)) if len(s) else None for s in sets]
                k2 += [int(mix(s ^ np.uint64(0x5DEECE66D)).sum().view(np.int64)) if len(s) else None for s in sets]
                full = np.flatnonzero(number)
                starts = np.concatenate(([0], np.cumsum(number)[:-1]))[full]
                out = np.zeros((len(full), HASHES), np.uint32)
                if len(full):
                    top = (hashes >> np.uint64(32)).astype(np.uint32)
                    for i in range(HASHES):
                        out[:, i] = np.minimum.reduceat((top ^ _XOR[i]) * _MUL[i], starts)
                own = [None] * len(sets)
                for row, at in enumerate(full):
                    own[at] = out[row].tobytes()
                sig += own
            part = batch["part"].to_numpy() if batch.num_rows else np.zeros(0, np.int64)
            rid = part.astype(np.int64) * (1 << 33) + seen + np.arange(batch.num_rows)
            seen += batch.num_rows
            columns = [pa.array(rid), batch["doc_id"], batch["row_hash"], pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(n, pa.int32()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(sign, f"rid long, doc_id {kind}, row_hash long, k1 long, k2 long, n int, sig binary")


def in_units(rows: DataFrame, chunks: Column, *key: str) -> DataFrame:
    """``rows`` dealt to units (key, ui, uj) with their chunk q; every two rows of a key meet in just one."""
    rows = rows.withColumn("c", chunks.cast("int")).withColumn("q", F.pmod(F.xxhash64("rid", F.lit(5)), F.col("c")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.withColumn("ui", F.least("q", "x")).withColumn("uj", F.greatest("q", "x")).drop("c", "x")
    unit = [*key, "ui", "uj"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *unit).sortWithinPartitions(*unit, "q", "rid")


def by_unit(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each unit together; batches come sorted by unit."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch[k].to_numpy() for k in key])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(keys[:, a].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _ties(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's component, for pairs (a, b) of n members."""
    low = np.arange(n)
    while len(a):
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            break
    return low


def _pairs(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a unit: within its chunk, or across its two chunks."""
    if (other := np.flatnonzero(q != q[0])).size:
        one = np.flatnonzero(q == q[0])
        return np.repeat(one, len(other)), np.tile(other, len(one))
    return np.triu_indices(len(q), 1)


def candidate_ties(units: DataFrame, threshold: float = THRESHOLD, key: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """(a, b) ties between rows of units whose MinHash values may belong to a pair of the threshold."""
    least = {n: least_matches(n, threshold) for n in range(STEP, HASHES + 1, STEP)}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in by_unit(batches, [*key, "ui", "uj"]):
            q, rid = unit["q"].to_numpy(), unit["rid"].to_numpy()
            if unit["ui"][0].as_py() != unit["uj"][0].as_py() and (q == q[0]).all():
                continue
            sig = np.frombuffer(b"".join(unit["sig"].to_pylist()), np.uint32).reshape(len(q), HASHES)
            a, b = _pairs(q)
            same = np.zeros(len(a), np.int32)
            for s in range(0, HASHES, STEP):
                same += (sig[a, s : s + STEP] == sig[b, s : s + STEP]).sum(1, dtype=np.int32)
                keep = same >= least[s + STEP]
                a, b, same = a[keep], b[keep], same[keep]
            low = _ties(len(q), a, b)
            moved = np.flatnonzero(low != np.arange(len(q)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rid[moved]), pa.array(rid[low[moved]])], ["a", "b"])

    return units.mapInArrow(compare, "a long, b long")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exactly."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, number, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[number] > 1
    owner, number = owner[shared], np.unique(number[shared], return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    width = int(number.max()) + 1 if len(number) else 0
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    for low in range(0, width, 4096):
        a, b = np.searchsorted(number, (low, low + 4096))
        block = np.zeros((n, min(4096, width - low)), np.float32)
        block[owner[a:b], number[a:b] - low] = 1
        out += block @ block.T
    return out


def verified(units: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rid, links, copies_linked, low): exact links of each row within its unit, and one tie."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in by_unit(batches, ["root", "ui", "uj"]):
            rid, first = np.unique(unit["rid"].to_numpy(), return_index=True)
            q, copies = unit["q"].to_numpy()[first], unit["copies"].to_numpy()[first]
            if len(rid) < 2 or unit["ui"][0].as_py() != unit["uj"][0].as_py() and (q == q[0]).all():
                continue
            raw = unit["sh"].to_pylist()
            sets = [np.frombuffer(raw[i], np.uint64) for i in first]
            sizes = np.array([len(s) for s in sets], np.float64)
            a, b = _pairs(q)
            if len(rid) == 2:
                both = np.array([len(np.intersect1d(sets[0], sets[1], assume_unique=True))], np.float64)
            else:
                both = common(sets)[a, b].astype(np.float64)
            link = both >= threshold * (sizes[a] + sizes[b] - both)
            a, b = a[link], b[link]
            n = len(rid)
            links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            weight = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
            low = _ties(n, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(links.astype(np.int64)), pa.array(weight.astype(np.int64)), pa.array(rid[low])], ["rid", "links", "copies_linked", "low"])

    return units.mapInArrow(verify, "rid long, links long, copies_linked long, low long")


def _shingled(rows: DataFrame, k: int) -> DataFrame:
    """``rows(rid, root, copies, n_chunks, text)`` with the sorted shingles in place of the text."""
    names = ["rid", "root", "copies", "n_chunks"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets, _, _ in _sets(batch["text"], k):
                part = batch.slice(a, len(sets))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], [*names, "sh"])

    return rows.select(*names, "text").mapInArrow(make, "rid long, root long, copies long, n_chunks int, sh binary")


def jaccard_groups(docs: DataFrame, *, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``.

    doc_id, row_hash; class_id, the smallest doc_id of its group of linked texts;
    copy_id, the smallest doc_id with the same shingles; n_copies, rows with the same
    shingles; n_links, other rows within the threshold; n_classes, other classes
    within it; keeps, whether it is the one row that stands for its group.
    """
    rows = write_shared(signatures(docs, k), "signatures")
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "rid")).alias("r"), F.count("*").alias("copies"))
    classes = write_shared(classes.select("k1", "k2", F.col("r.rid").alias("rid"), F.col("r.doc_id").alias("copy_id"), "copies"), "classes")
    reps = write_shared(classes.select("rid", "copies").join(rows.select("rid", "doc_id", "row_hash", "n", "sig"), "rid"), "representatives")
    cut = [F.xxhash64(F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS), F.lit(i)) for i in range(BANDS)]
    bands = reps.select("rid", F.explode(F.array(*cut)).alias("bucket"))
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64("rid", F.lit(1))).alias("y")).where("m > 1")
    buckets = write_shared(buckets.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "m"), "buckets")
    members = bands.join(buckets, "bucket").join(reps.select("rid", "sig"), "rid")
    units = in_units(members.select("bucket", "rid", "sig", "m"), F.ceil(F.col("m") / CHUNK), "bucket")
    groups = connected_components(candidate_ties(units.drop("m"), threshold)).withColumnsRenamed({"id": "rid"})
    near = groups.join(reps.select("rid", "doc_id", "row_hash", "copies", "n"), "rid")
    wide = near.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") * 8 / CHUNK_BYTES)).cast("int").alias("n_chunks"))
    near = write_shared(near.join(wide, "root").drop("n"), "candidates").withColumnsRenamed({"doc_id": "i", "row_hash": "r"})
    texts = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    texts = texts.join(broadcast_if(near, BROADCAST_KEYS), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("r")))
    sets = _shingled(texts, k)
    found = write_shared(verified(in_units(sets, F.col("n_chunks"), "root").drop("n_chunks"), threshold), "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"), F.sum("copies_linked").alias("more"))
    tied = connected_components(found.where("rid <> low").select(F.col("rid").alias("a"), F.col("low").alias("b")))
    tied = tied.withColumnsRenamed({"id": "rid"}).join(reps.select("rid", "doc_id"), "rid")
    least = tied.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("head"))
    heads = tied.join(least, "root").select("rid", F.col("head.doc_id").alias("group_id"), F.col("head.rid").alias("head"))
    whole = classes.join(links, "rid", "left").join(heads, "rid", "left").withColumnRenamed("rid", "rep")
    out = rows.select("rid", "doc_id", "row_hash", "k1", "k2").join(whole, ["k1", "k2"], "left")
    found = F.col("rep").isNotNull()
    return out.select(
        "doc_id",
        "row_hash",
        F.when(F.col("head").isNotNull(), F.col("group_id")).when(found, F.col("copy_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(found, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        F.coalesce("links", F.lit(0)).alias("n_classes"),
        (F.coalesce("head", "rep", "rid") == F.col("rid")).alias("keeps"),
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows equal in id and text count as one."""
    own, key, row, twice = spare_names(docs, "own", "key", "row", "twice")
    gone = jaccard_groups(docs, **options).groupBy("doc_id", "row_hash").agg(F.max("keeps").alias("keeps")).where("not keeps")
    gone = gone.select(F.col("doc_id").alias(key), F.col("row_hash").alias(row))
    kept = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(row)), "left_anti")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        worded = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]")) > 0
        kept = kept.withColumn(twice, F.when(worded, F.lit(0).cast("long")).otherwise(F.monotonically_increasing_id())).dropDuplicates(["doc_id", own, twice])
    return kept.select(*docs.columns)


def as_function(**options) -> Callable[[DataFrame], DataFrame]:
    """``keep_one`` with its options bound, for DataFrame.transform."""
    return lambda docs: keep_one(docs, **options)
