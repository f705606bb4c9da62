"""Mixing sources to target weights.

Rows get a hash-random key; within its source each row is placed by that key,
its range of words found by a two-level prefix sum (key ranges first, then rows
inside a range), and the source is cut at its exact word budget. Budgets above a
source's size repeat the whole source for as many epochs as fit.

Defined cases: a null text has size 0, a null source is a source of its own and
sorts last, rows with equal ids are told apart by their size and text hash (equal
rows share the cut arbitrarily but equally often), sources of size 0 get target 0,
an empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import write_shared
from ._text import spare_names

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the key that name a range: 16**3 ranges of each source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words of each source of ``totals(source, source_size)``.

    Sources by code point, null last, take ``weights`` in turn. Targets share
    ``share`` times all words by weight; none exceeds ``most`` times its source,
    and the excess goes to the others by weight. With sources ordered by
    cap / weight, the common level is that of the first one that it does not fill.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    t = totals.select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    t = t.withColumn("ratio", F.col("cap") / F.col("w"))
    full = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0))
    rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - full) / rest)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    return t.select("source", "source_size", F.least("cap", F.coalesce(level * F.col("w"), F.col("cap"))).alias("target"))


def mix_plan(docs: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "") -> DataFrame:
    """(doc_id, source, row_hash, size, source_size, target, taken) for each row.

    ``taken`` are the words that the mix takes from the row, repeats counted: the
    whole row in each full epoch, and what lies before the cut in the last.
    """
    rows = write_shared(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("key"),
            F.xxhash64("text").alias("row_hash"),
        ).withColumn("range", F.substring("key", 1, RANGE_DIGITS)),
        "mix-rows",
    )
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = write_shared(ranges.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "mix-ranges")
    goal = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, share, most)
    r, g = ranges.alias("r"), goal.alias("g")
    placed = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source"))).select(
        F.col("r.source").alias("s"), F.col("r.range").alias("k"), "base", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = own.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("k")))
    budget = F.floor("target")
    epochs = F.coalesce(F.floor(F.try_divide(budget, F.col("source_size"))), F.lit(0)).cast("long")
    cut = budget - epochs * F.col("source_size") - F.col("base") - F.col("inner")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut))
    return full.select("doc_id", "source", "row_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``.

    A row that is taken twice appears twice. Of the row in which a source's cut
    falls, the last copy holds the words before the cut, single-spaced. Rows
    without words carry none of the mix and are left out.
    """
    own, key, source, row, size, taken, copy = spare_names(docs, "own", "key", "source", "row", "size", "taken", "copy")
    plan = mix_plan(docs, **options).where("taken > 0").select(
        F.col("doc_id").alias(key), F.col("source").alias(source), F.col("row_hash").alias(row), F.col("size").alias(size), F.col("taken").alias(taken)
    )
    # Equal rows meet one row of the plan, which carries the words of all of them.
    plan = plan.groupBy(key, source, row, size).agg(F.sum(taken).alias(taken))
    one = docs.withColumn(own, F.xxhash64("text"))
    one = one.dropDuplicates(["doc_id", "source", own]) if _repeats(docs) else one
    hit = one.join(plan, F.col("doc_id").eqNullSafe(F.col(key)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(own) == F.col(row)))
    hit = hit.withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    words = F.least(F.col(size), F.col(taken) - (F.col(copy) - 1) * F.col(size)).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), words), " ")
    text = F.when(words < F.col(size), part).otherwise(F.col("text"))
    return hit.withColumn("text", text).select(*docs.columns)


def _repeats(docs: DataFrame) -> bool:
    """Whether any doc_id stands on several rows."""
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((i - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, cap / w AS ratio,
        (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
g AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * w, cap)) AS target FROM l),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT p.doc_id, p.size, g.source_size, g.target,
       (coalesce(floor(floor(target) / nullif(source_size, 0)), 0) * p.size
        + greatest(0, least(p.size, floor(target) - coalesce(floor(floor(target) / nullif(source_size, 0)), 0) * source_size - before)))::BIGINT AS taken
FROM p JOIN g ON p.source IS NOT DISTINCT FROM g.source
"""
