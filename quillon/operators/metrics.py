"""Scores of predictions(method, case_id, term_id) against gold(case_id, term_id) of cases(case_id, lang, difficulty)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import parts_unsorted


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(0.0)


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return p, r, _ratio(2 * p * r, p + r)


def score_cases(predictions: DataFrame, gold: DataFrame, cases: DataFrame, methods: DataFrame) -> DataFrame:
    """(method, case_id, lang, difficulty, tp, fp, fn) for every method and case.

    Predictions and gold ids are rows of one table, which is dealt by method and case
    into as many partitions as its rows ask for, so a task's share is bounded, and into
    so few that the rows dealt out are not held to be sorted. Ids that are null match none.
    """
    few = F.broadcast(methods.select("method").distinct())  # a few rows
    p = predictions.join(few, "method", "left_semi").select("method", "case_id", "term_id", F.lit(True).alias("p"), F.lit(False).alias("g"))
    g = gold.join(few).select("method", "case_id", "term_id", F.lit(False).alias("p"), F.lit(True).alias("g"))
    parts = max(parts_unsorted(p.count() + g.count()), predictions.sparkSession.sparkContext.defaultParallelism)
    grid = cases.select("case_id", "lang", "difficulty").join(few).repartition(parts, "method", "case_id")
    both = p.unionByName(g).repartition(parts, "method", "case_id").groupBy("method", "case_id", "term_id").agg(F.max("p").alias("p"), F.max("g").alias("g"))
    one = lambda cond: F.count(F.when(cond, 1))
    met = F.col("p") & F.col("g") & F.col("term_id").isNotNull()
    n = both.groupBy("method", "case_id").agg(one(met).alias("tp"), one(F.col("p") & ~met).alias("fp"), one(F.col("g") & ~met).alias("fn"))
    return grid.join(n, ["method", "case_id"], "left").select("method", "case_id", "lang", "difficulty", "tp", "fp", "fn").fillna(0, ["tp", "fp", "fn"])


def case_ids(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(method, case_id, tp_ids, fp_ids, fn_ids) in order of id, for every method and case with a prediction or a gold id."""
    p = predictions.select("method", "case_id", "term_id").distinct().withColumn("p", F.lit(1))
    g = gold.select("case_id", "term_id").distinct().join(F.broadcast(predictions.select("method").distinct())).withColumn("g", F.lit(1))  # a few methods
    both = p.join(g, ["method", "case_id", "term_id"], "full_outer")
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("term_id"))))
    has_p, has_g = F.col("p").isNotNull(), F.col("g").isNotNull()
    return both.groupBy("method", "case_id").agg(ids(has_p & has_g).alias("tp_ids"), ids(has_p & ~has_g).alias("fp_ids"), ids(~has_p & has_g).alias("fn_ids"))


def micro_prf(scored: DataFrame, *by: str) -> DataFrame:
    keys = by or ("method",)
    s = scored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select(*keys, "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def macro_prf(scored: DataFrame) -> DataFrame:
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return scored.groupBy("method").agg(F.round(F.avg(p), 4).alias("precision"), F.round(F.avg(r), 4).alias("recall"), F.round(F.avg(f), 4).alias("f1"))


def prf_by_group(scored: DataFrame) -> DataFrame:
    """Micro scores overall, by language and by difficulty, in one pass."""
    s = scored.groupingSets([["method"], ["method", "lang"], ["method", "difficulty"]], "method", "lang", "difficulty").agg(F.grouping_id().alias("gid"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    kind = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "lang").otherwise("difficulty")
    value = F.when(F.col("gid") == 1, F.col("lang")).when(F.col("gid") == 2, F.col("difficulty"))
    return s.select("method", kind.alias("grouping"), value.alias("value"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"))


def prf_wide(scored: DataFrame, langs: Sequence[str], difficulties: Sequence[str], metric: str = "f1") -> DataFrame:
    """A row for each method: its ``metric`` over all, by language and by difficulty, in a column each; null where it has no case."""
    columns = ["all", *[f"lang_{x}" for x in langs], *[f"difficulty_{x}" for x in difficulties]]
    name = F.when(F.col("grouping") == "all", "all").otherwise(F.concat_ws("_", "grouping", "value"))
    return prf_by_group(scored).withColumn("column", name).groupBy("method").pivot("column", columns).agg(F.first(metric))


def negative_fp_rate(scored: DataFrame) -> DataFrame:
    """Percent of cases without gold for which anything is predicted."""
    return scored.where("tp + fn = 0").groupBy("method").agg(F.count("*").alias("n"), F.round(100 * F.avg((F.col("fp") > 0).cast("int")), 2).alias("negative_fp"))


def exact_empty_rates(scored: DataFrame, timings: DataFrame | None = None) -> DataFrame:
    """Shares of cases predicted exactly, and with nothing; mean time if measured."""
    share = lambda cond: F.round(F.avg(cond.cast("int")), 4)
    out = scored.groupBy("method").agg(share((F.col("fp") == 0) & (F.col("fn") == 0)).alias("exact"), share(F.col("tp") + F.col("fp") == 0).alias("empty"))
    return out if timings is None else out.join(timings.groupBy("method").agg(F.avg("elapsed_s").alias("mean_s")), "method", "left")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame, cases: DataFrame, k: int, *, prefix: str | None = None) -> DataFrame:
    """One row of means over cases with gold: hit, recall, precision, MRR and nDCG at k; and the share of the others without a term."""
    top = ranked.where(F.col("rank") <= k).select("case_id", "term_id", "rank")
    found = top.groupBy("case_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("term_id").cast("string").startswith(prefix or ""), 1)).alias("ids"))
    hits = top.join(gold.select("case_id", "term_id").distinct(), ["case_id", "term_id"], "left_semi")
    h = hits.groupBy("case_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    g = gold.select("case_id", "term_id").distinct().groupBy("case_id").agg(F.count("*").alias("g"))
    c = cases.select("case_id").join(g, "case_id", "left").join(found, "case_id", "left").join(h, "case_id", "left").fillna(0, ["g", "n", "ids", "h", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("g"), F.lit(k))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    pos = F.col("g") > 0
    mean = lambda x: F.round(F.avg(F.when(pos, x)), 4)
    return c.agg(
        mean((F.col("h") > 0).cast("double")).alias("hit"),
        mean(F.col("h") / F.nullif("g", F.lit(0))).alias("recall"),
        mean(F.col("h") / F.greatest(F.lit(1), F.least(F.lit(k), F.col("n")))).alias("precision"),
        mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        mean(F.col("dcg") / ideal).alias("ndcg"),
        F.round(F.avg(F.when(~pos, (F.col("ids") == 0).cast("double"))), 4).alias("negative_rejected"),
    )


def latency_stats(timings: DataFrame) -> DataFrame:
    ms = F.col("elapsed_s") * 1000
    return timings.groupBy("method").agg(F.round(F.avg(ms), 3).alias("mean_ms"), F.round(F.percentile(ms, 0.5), 3).alias("median_ms"))


def ablation_delta(base: DataFrame, other: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, base, other, delta) of two one-row results."""
    b = base.select([F.col(c).cast("double").alias(c) for c in metrics]).unpivot([], metrics, "metric", "base")
    o = other.select([F.col(c).cast("double").alias(c) for c in metrics]).unpivot([], metrics, "metric", "other")
    return b.join(o, "metric").withColumn("delta", F.round(F.col("other") - F.col("base"), 4))


def latency_delta(stats: DataFrame, base: str, other: str) -> DataFrame:
    """(base_ms, other_ms, delta_ms, relative) of two methods of ``latency_stats``; relative is the share of the base's time."""
    of = lambda m: F.max(F.when(F.col("method") == m, F.col("mean_ms")))
    one = stats.agg(of(base).alias("base_ms"), of(other).alias("other_ms"))
    gap = F.col("other_ms") - F.col("base_ms")
    return one.withColumn("delta_ms", F.round(gap, 3)).withColumn("relative", F.round(gap / F.nullif("base_ms", F.lit(0.0)), 4))


def case_distribution(cases: DataFrame) -> DataFrame:
    """(lang, difficulty, n, percent, first_id, last_id)."""
    total = F.sum("n").over(Window.partitionBy())
    c = cases.groupBy("lang", "difficulty").agg(F.count("*").alias("n"), F.min("case_id").alias("first_id"), F.max("case_id").alias("last_id"))
    return c.select("lang", "difficulty", "n", F.round(100 * F.col("n") / total, 2).alias("percent"), "first_id", "last_id")
