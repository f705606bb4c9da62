"""Benchmark decontamination by canonical templates.

Numbers, units and names (capitalised words within a sentence) become typed
placeholders; what is left is lower-cased words. Windows of ``window`` canonical
words of every document are hash-joined with those of the benchmark items, so a
question asked again with other numbers or names still meets its item. A pair of
document and item is contaminated if it shares ``min_windows`` distinct windows
(or all that the item has) and its slots are consistent: along one of its alignments
each item value stands for one document value and the other way round. All alignments
with ``min_windows`` windows (or all that the item has) are tried, and those of the
most windows where none has so many. Items meet documents through those of their
windows that the fewest items hold, as many as any contaminated pair must share one of.

Defined cases: null, empty and short texts have no windows; items of fewer than
``window`` canonical words are looked for by one window of their own length, from 3
words on, and shorter ones never match; an item is told by its id, null or not, and
its text, so items that share an id are judged each by its own windows and listed
each for itself; rows equal in both are one item, and rows equal in doc_id and text one
document; an empty table gives no pairs; extra columns are not read. Of a window
that an item repeats, its first place counts. A text is one row throughout, however
long; its windows are spread over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if, write_shared
from ._text import spare_names

NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
MARKS = "\ue000-\ue002"
NUMBER_RE = r"\d+(?:[.,:/]\d+)*"
NAME_RE = r"(?<=[\p{Ll}\d,;] )\p{Lu}[\p{L}'’-]*"
#: Units that may follow a number.
UNITS = "km m cm mm kg g mg lb oz l ml h hr hrs hour hours min minute minutes s sec second seconds day days year years mile miles inch inches foot feet dollars euros cents percent usd eur mph kmh"
UNIT_RE = rf"(?i)(?<={NUM})\s?(?:%|°[cf]?|" + UNITS.replace(" ", "|") + r")(?![\p{L}\p{N}])"
MONEY_RE = r"[$€£¥]\s?(?=\d)"
TOKEN_RE = rf"[\p{{L}}\p{{N}}]+|[{MARKS}]"
WINDOW, MIN_WINDOWS, SHORTEST = 8, 6, 3
KINDS = ("exact", "reparameterised", "edited")
#: Benchmark windows that may be broadcast; beyond, the join is shuffled.
BROADCAST_WINDOWS = 1 << 20


def canonical_words(text: Column) -> Column:
    """The typed placeholders and lower-case words of a text, in order."""
    t = F.regexp_replace(text, f"[{MARKS}]", " ")
    t = F.regexp_replace(t, MONEY_RE, f" {UNIT} ")
    t = F.regexp_replace(t, NAME_RE, f" {NAME} ")
    t = F.regexp_replace(t, NUMBER_RE, NUM)
    t = F.regexp_replace(t, UNIT_RE, f" {UNIT} ")
    return F.regexp_extract_all(F.lower(t), F.lit(TOKEN_RE), F.lit(0))


def slot_values(text: Column) -> Column:
    """struct(numbers, names): the values behind the placeholders, in order."""
    t = F.regexp_replace(text, f"[{MARKS}]", " ")
    t = F.regexp_replace(t, MONEY_RE, f" {UNIT} ")
    numbers = F.regexp_extract_all(F.regexp_replace(t, NAME_RE, f" {NAME} "), F.lit(f"({NUMBER_RE})"), F.lit(1))
    names = F.transform(F.regexp_extract_all(t, F.lit(f"({NAME_RE})"), F.lit(1)), F.lower)
    return F.struct(numbers.alias("numbers"), names.alias("names"))


def windows(words: Column, k: Column) -> Column:
    """Hashes of all windows of k words."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, k), k)))


def item_windows(benchmark: DataFrame, window: int, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(item_id, h, k, at, n, held, seed): each item's distinct windows, first places, their number and how many items hold one.

    A contaminated pair shares ``min_windows`` of the item's n windows (or all), so at least
    one of any n - min_windows + 1 of them. ``seed`` marks so many, those that the fewest items hold.
    """
    items = benchmark.select("item_id", canonical_words(F.col("text")).alias("w")).where(F.size("w") >= SHORTEST)
    k = F.least(F.size("w"), F.lit(window))
    size = F.size("w") - k
    hashes = F.transform(F.sequence(F.lit(0), size), lambda i: F.xxhash64(F.slice("w", i + 1, k), k))
    rows = items.select("item_id", k.alias("k"), F.posexplode(hashes).alias("at", "h"))
    rows = rows.groupBy("item_id", "k", "h").agg(F.min("at").alias("at"))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("item_id")))
    rows = rows.join(rows.groupBy("h", "k").agg(F.count("*").alias("held")), ["h", "k"])
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("held", "h", "k"))
    return rows.withColumn("seed", place <= F.col("n") - F.least(F.lit(min_windows), F.col("n")) + 1)


def _between(words: Column, mark: str, start: Column, end: Column) -> tuple[Column, Column]:
    """(placeholders before start, placeholders from start to before end)."""
    count = lambda part: F.size(F.filter(part, lambda x: x == mark))
    return count(F.slice(words, 1, start)), count(F.slice(words, start + 1, end - start))


def _consistent(a: Column, b: Column) -> Column:
    """Whether equal-length value lists map one to one; lists of other lengths are not compared."""
    pairs = F.array_distinct(F.arrays_zip(a.alias("a"), b.alias("b")))
    one = (F.size(pairs) == F.size(F.array_distinct(a))) & (F.size(pairs) == F.size(F.array_distinct(b)))
    return (F.size(a) != F.size(b)) | one


def _pair_hits(places: DataFrame, bench: DataFrame) -> DataFrame:
    """(doc_id, row_hash, item_id, place, h, k, at, n) of all pairs that share a seed window.

    Only seeds are joined through their hash alone; an item's other windows, fewer than
    ``min_windows`` and those that most items hold, are looked up in the documents that met it.
    """
    own, use = ["doc_id", "row_hash"], ["item_id", "h", "k", "at", "n"]
    seeds = bench.where("seed").select(*use)
    met = places.join(broadcast_if(seeds, BROADCAST_WINDOWS), ["h", "k"]).select(*own, "place", *use)
    rest = bench.where("not seed").select(*use)
    wanted = met.select(*own, "item_id").distinct().join(broadcast_if(rest, BROADCAST_WINDOWS), "item_id").withColumnRenamed("doc_id", "i")
    others = places.join(wanted, ["row_hash", "h", "k"]).where(F.col("doc_id").eqNullSafe(F.col("i"))).select(*own, "place", *use)
    return met.unionByName(others)


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, min_windows: int = MIN_WINDOWS) -> DataFrame:
    """(doc_id, row_hash, item_id, matched, item_windows, kind) for each contaminated pair.

    ``kind`` is exact (same slot values), reparameterised (other values, one to
    one), or edited (the aligned stretch has a different number of slots); of several
    consistent alignments the first kind in this order.
    """
    # A struct, unlike a null id, equals itself in joins.
    benchmark = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("item_hash")).alias("item_id"), "text")
    benchmark = write_shared(benchmark.dropDuplicates(["item_id"]), "items")
    bench = write_shared(item_windows(benchmark, window, min_windows), "item-windows")
    lengths = [r["k"] for r in bench.select("k").distinct().collect()] or [window]  # at most `window` numbers
    own = ["doc_id", "row_hash"]
    spread = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), canonical_words(F.col("text")).alias("w"))
    # Every length of window comes out of one pass over the words.
    spread = spread.select("*", F.lit(lengths[0]).alias("k") if len(lengths) == 1 else F.explode(F.array(*map(F.lit, sorted(lengths))).cast("array<int>")).alias("k"))
    rows = spread.select(*own, "k", F.posexplode(windows(F.col("w"), F.col("k"))).alias("place", "h"))
    known = bench.select("h", "k").distinct()
    # Both counts below and the search for pairs read the places, so they are written once.
    places = write_shared(rows.join(broadcast_if(known, BROADCAST_WINDOWS), ["h", "k"]).select(*own, "place", "h", "k"), "window-places")
    hits = write_shared(_pair_hits(places, bench).withColumn("shift", F.col("place") - F.col("at")), "window-hits")
    # Along each alignment, then over all: windows are counted once however often a document repeats them.
    lines = hits.groupBy(*own, "item_id", "n", "k", "shift").agg(F.countDistinct("h").alias("m"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    total = hits.groupBy(*own, "item_id", "n").agg(F.countDistinct("h").alias("matched")).where(F.col("matched") >= F.least(F.lit(min_windows), F.col("n")))
    # One row a pair, its alignments as a list that a document's length bounds.
    tried = lines.groupBy(*own, "item_id").agg(F.max("m").alias("most"), F.collect_list(F.struct("m", "k", "shift", "lo", "hi")).alias("all"))
    total = total.withColumnsRenamed({"doc_id": "__doc_id", "row_hash": "__row_hash", "item_id": "__item"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("row_hash") == F.col("__row_hash"))
    pairs = tried.join(total, same & (F.col("item_id") == F.col("__item"))).withColumn("least", F.least(F.lit(min_windows).cast("long"), F.col("n"), F.col("most")))
    pairs = write_shared(pairs.select(*own, "item_id", "matched", F.col("n").alias("item_windows"), F.expr("filter(all, x -> x.m >= least)").alias("lines")), "pairs")
    return _checked(pairs, docs, benchmark).withColumn("item_id", F.col("item_id.item_id"))


def _checked(pairs: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs whose slots are consistent along any of their ``lines``, with their kind."""
    own = ["doc_id", "row_hash"]
    keys = pairs.select(*own).distinct().withColumnRenamed("doc_id", "i").withColumnRenamed("row_hash", "r")
    near = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    near = near.join(keys, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("r")), "left_semi")
    near = near.groupBy(*own).agg(F.first("text").alias("text"))
    texts = near.select(F.col("doc_id").alias("i"), F.col("row_hash").alias("r"), canonical_words(F.col("text")).alias("dw"), slot_values(F.col("text")).alias("ds"))
    items = benchmark.select("item_id", canonical_words(F.col("text")).alias("iw"), slot_values(F.col("text")).alias("is"))
    j = pairs.join(texts, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("row_hash") == F.col("r"))).join(items, "item_id")
    j = j.select(*own, "item_id", "matched", "item_windows", "dw", "ds", "iw", "is", F.explode("lines").alias("line")).select("*", "line.*")
    end = F.col("hi") + F.col("k")
    ok, same, equal = F.lit(True), F.lit(True), F.lit(True)
    for mark, field in ((NUM, "numbers"), (NAME, "names")):
        before, inside = _between(F.col("dw"), mark, F.col("lo"), end)
        a = F.slice(F.col("ds")[field], before + 1, inside)
        before, inside = _between(F.col("iw"), mark, F.col("lo") - F.col("shift"), end - F.col("shift"))
        b = F.slice(F.col("is")[field], before + 1, inside)
        ok, same, equal = ok & _consistent(a, b), same & (F.size(a) == F.size(b)), equal & (a == b)
    kind = F.when(~same, 2).when(equal, 0).otherwise(1)
    found = j.where(ok).select(*own, "item_id", "matched", "item_windows", kind.alias("kind"))
    found = found.groupBy(*own, "item_id", "matched", "item_windows").agg(F.min("kind").alias("kind"))
    return found.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that are contaminated by any item."""
    own, key, row = spare_names(docs, "own", "key", "row")
    bad = contaminated_pairs(docs, benchmark, **options).select(F.col("doc_id").alias(key), F.col("row_hash").alias(row)).distinct()
    kept = docs.withColumn(own, F.xxhash64("text"))
    return kept.join(bad, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(row)), "left_anti").select(*docs.columns)
