"""Line dedup: delete later repeats of runs of lines.

A line is identified by its text without outer white space; lines without words
take no part. A run is a stretch of lines that also stands elsewhere; runs of at
least ``min_words`` words are deleted wherever they stand but first, in the order
of (doc_id, row hash, line). Steps:

1. Winnowing: for the shortest window of lines from each line on that holds
   ``min_words`` words, the line of least hash is a fingerprint. Equal runs that
   long hold an equal window, so they share a fingerprint.
2. The places of fingerprints are joined: a window goes on only if the line of its
   fingerprint stands at two places or more.
3. Windows of equal lines are matches with the first place that holds them. Each is
   extended: the windows that begin at a matched place and end at each later line are
   compared in the same way, which carries a match to the last line of its run (its
   first line begins a window of its own).
4. Lines under a match are merged into runs and deleted, but at the first place.

No match rests on a hash: all texts of a line hash are compared, those that share one
are numbered, and windows are compared as lists of at most ``min_words`` such lines.

Lines, fingerprints and windows that stand at very many places are counted before
they are joined, and joined by broadcast, so no task holds all places of one.

Defined cases: a null text stays null, an empty one empty; a table without rows
gives none; rows equal in doc_id and text count as one place and are treated
alike; very long texts are handled as any other, line by line; extra columns are passed
through, but for one named deleted_runs, which is replaced. Ties of hashes are broken
by place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import BROADCAST_BYTES, HOT_KEYS, broadcast_if, join_hot, write_shared

WORD = r"[^\x20\x09-\x0D]+"
TRIM = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
MIN_WORDS = 50


def split_lines(docs: DataFrame, line_hash: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, row_hash, line, n, h, body): lines with words, trimmed, their words and hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), F.posexplode(F.split("text", "\n", -1)).alias("line", "s")).where(F.col("s").rlike(WORD))
    body = F.regexp_replace("s", TRIM, "")
    return rows.select("doc_id", "row_hash", "line", F.regexp_count("s", F.lit(WORD)).alias("n"), line_hash(body).alias("h"), body.alias("body"))


def line_places(rows: DataFrame) -> DataFrame:
    """(h, places, texts): hashes of lines that stand at two places or more, and how many texts have them."""
    texts = rows.groupBy("h", "body").agg(F.count("*").alias("places"))
    return write_shared(texts.groupBy("h").agg(F.sum("places").alias("places"), F.count("*").alias("texts")).where("places > 1"), "places")


def with_line_id(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` with ``id``, which is equal just where the lines' texts are: the hash, and where texts share one, their number in it too."""
    shared = places.where("texts > 1").select("h")
    if not shared.take(1):
        return rows.withColumn("id", F.col("h"))
    texts = rows.join(broadcast_if(shared, HOT_KEYS), "h", "left_semi").select("h", "body").distinct()
    texts = write_shared(texts.withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("body"))), "clashes")
    rows = rows.join(broadcast_if(texts, HOT_KEYS, BROADCAST_BYTES), ["h", "body"], "left")
    return rows.withColumn("id", F.struct("h", F.coalesce("k", F.lit(0)).alias("k")))


def line_table(rows: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line, n, h, id, q, p): each place once, with the words before and up to each."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("doc_id", "row_hash", "line", "n", "h", "id").repartition(n, "doc_id", "row_hash").dropDuplicates(["doc_id", "row_hash", "line"])
    order = Window.partitionBy("doc_id", "row_hash").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("p", F.sum("n").over(order))
    return rows.withColumn("q", F.col("p") - F.col("n"))


def _matches(windows: DataFrame) -> DataFrame:
    """``windows(doc_id, row_hash, w, a, b)`` of which there are two or more, with ``at``, the first place; ``w`` lists the lines."""
    firsts = windows.groupBy("w").agg(F.min(F.struct("doc_id", "row_hash", "a")).alias("at"), F.count("*").alias("n")).where("n > 1")
    return write_shared(join_hot(windows, write_shared(firsts, "firsts"), ["w"]).select("doc_id", "row_hash", "a", "b", "at"), "matches")


def repeated_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, row_hash, runs): the lines to delete, as (first, last) pairs in order."""
    own = ["doc_id", "row_hash"]
    ahead = Window.partitionBy(*own).orderBy("q").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*own).orderBy("p").rangeBetween(-(min_words - 1), 0)
    rows = split_lines(docs, line_hash)
    places = line_places(rows)
    lines = line_table(with_line_id(rows, places))
    lines = (
        lines.withColumn("to", F.max(F.struct("q", "line", "p")).over(ahead))
        .withColumn("mark", F.min("h").over(ahead))
        .withColumn("ahead", F.collect_list("id").over(ahead))
        .withColumn("frm", F.min(F.struct("p", "line", "q")).over(behind))
        .withColumn("behind", F.collect_list("id").over(behind))
        .withColumn("is_ahead", F.col("to.p") - F.col("q") >= min_words)
        .withColumn("is_behind", F.col("p") - F.col("frm.q") >= min_words)
    )
    lines = write_shared(
        lines.select(*own, "line", F.when(F.col("is_ahead"), F.col("mark")).alias("mark"), F.when(F.col("is_ahead"), F.col("to.line")).alias("last"), F.when(F.col("is_ahead"), F.col("ahead")).alias("ahead"), F.when(F.col("is_behind"), F.col("frm.line")).alias("first"), F.when(F.col("is_behind"), F.col("behind")).alias("behind")),
        "lines",
    )
    # Fingerprints whose line stands at two places or more.
    held = lines.where("ahead is not null").groupBy("mark").agg(F.count("*").alias("n"))
    marks = write_shared(held.join(places.select(F.col("h").alias("mark")), "mark"), "marks")
    fore = join_hot(lines.where("ahead is not null"), marks, ["mark"])
    found = _matches(write_shared(fore.select(*own, F.col("ahead").alias("w"), F.col("line").alias("a"), F.col("last").alias("b")), "fore"))
    # Windows that begin at a match and reach on to each later line.
    starts = found.select(F.col("doc_id").alias("i"), F.col("row_hash").alias("r"), F.col("a").alias("first"))
    back = lines.where("behind is not null").join(starts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("r")) & (lines["first"] == starts["first"]), "left_semi")
    more = _matches(write_shared(back.select(*own, F.col("behind").alias("w"), F.col("first").alias("a"), F.col("line").alias("b")), "back"))
    again = found.unionByName(more).where(F.struct("doc_id", "row_hash", "a") != F.col("at")).select(*own, "a", "b")
    # Windows of one document that overlap or touch become one run.
    order = Window.partitionBy(*own).orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = again.withColumn("new", (F.coalesce(F.col("a") > reach + 1, F.lit(True))).cast("int"))
    steps = steps.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = steps.groupBy(*own, "run").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return runs.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("runs"))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, line_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``docs`` with repeated runs of lines deleted from its texts, and ``deleted_runs``."""
    docs = docs.drop("deleted_runs")
    runs = repeated_runs(docs, min_words=min_words, line_hash=line_hash).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash"), F.col("runs").alias("deleted_runs"))
    hit = docs.withColumn("__own", F.xxhash64("text")).join(runs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("deleted_runs", lambda r: (r["a"] <= i) & (r["b"] >= i)))
    text = F.when(F.col("deleted_runs").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return hit.withColumn("text", text).select(*docs.columns, "deleted_runs")


ORACLE = r"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n, regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM s),
p AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY line) AS p FROM l WHERE n > 0),
q AS (SELECT *, p - n AS q FROM p),
w AS (SELECT doc_id, line, s, p, q,
        max(line) OVER a AS last, max(p) OVER a AS top, string_agg(s, chr(10)) OVER a AS ahead,
        min(line) OVER b AS first, min(q) OVER b AS low, string_agg(s, chr(10)) OVER b AS behind
      FROM q WINDOW a AS (PARTITION BY doc_id ORDER BY q RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING),
                    b AS (PARTITION BY doc_id ORDER BY p RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
g AS (SELECT doc_id, ahead AS w, line AS a, last AS b, 0 AS way FROM w WHERE top - q >= 50
      UNION ALL SELECT doc_id, behind, first, line, 1 FROM w WHERE p - low >= 50),
r AS (SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY way, w ORDER BY doc_id, a) AS k FROM g) WHERE k > 1),
x AS (SELECT DISTINCT l.doc_id, l.line, l.n FROM l JOIN r ON l.doc_id = r.doc_id AND l.line BETWEEN r.a AND r.b),
k AS (SELECT s.doc_id, string_agg(s.s, chr(10) ORDER BY s.line) AS t FROM s LEFT JOIN x ON s.doc_id = x.doc_id AND s.line = x.line WHERE x.line IS NULL GROUP BY s.doc_id)
SELECT d.doc_id, coalesce((SELECT count(*) FROM x WHERE x.doc_id = d.doc_id), 0)::BIGINT AS deleted_lines,
       md5(CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.t, '') END) AS kept_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
