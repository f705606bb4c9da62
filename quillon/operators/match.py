"""Finding terms in documents. ``doc_id`` is unique in ``docs(doc_id, text)``; ``terms`` are as read_obo gives them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectorised import free_spans, near_pairs, near_windows, sequence_ratio
from ..plans.shared import BROADCAST_BYTES, broadcast_if, small_enough, write_shared

#: Dictionary names that may be broadcast; beyond, the joins are shuffled.
BROADCAST_NAMES = 1 << 20
#: Names up to which windows are judged by what their words have in common with each; a task keeps a bound for each word and name.
WORD_NAMES = 1 << 12
#: Rows of a part index that is probed where the phrases are.
PROBED_PARTS = 1 << 22


def _held(names: DataFrame) -> DataFrame:
    """Names for a join, broadcast if they are few and small."""
    return broadcast_if(names, BROADCAST_NAMES, BROADCAST_BYTES)


def explode_names(terms: DataFrame) -> DataFrame:
    """(term_id, term_name, name, pos, ord): the name, then the synonyms."""
    return terms.select("term_id", F.col("name").alias("term_name"), F.posexplode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("pos", "name"), "ord")


def name_index(terms: DataFrame, strip: bool = False) -> DataFrame:
    """names(name_lc, term_id, is_primary, n_tokens); the first in file order wins."""
    name = F.lower(F.trim("name") if strip else F.col("name"))
    rows = explode_names(terms).withColumn("name_lc", name).where("name_lc <> ''")
    first = rows.groupBy("name_lc").agg(F.min_by(F.struct("term_id", "term_name"), F.struct("ord", "pos")).alias("t"))
    return first.select("name_lc", F.col("t.term_id").alias("term_id"), (F.lower("t.term_name") == F.col("name_lc")).alias("is_primary"), F.size(F.split("name_lc", " ")).alias("n_tokens"))


def name_lookup_last_wins(terms: DataFrame) -> DataFrame:
    """(name_lc, name_id, synonym_id): separate lookups of names and synonyms, the last wins."""
    rows = explode_names(terms).withColumn("name_lc", F.lower(F.trim("name"))).where("name_lc <> ''")
    last = lambda cond: F.max_by(F.when(cond, F.col("term_id")), F.when(cond, F.struct("ord", "pos")))
    return rows.groupBy("name_lc").agg(last(F.col("pos") == 0).alias("name_id"), last(F.col("pos") > 0).alias("synonym_id"))


def _ends(lengths: str) -> tuple[Column, Column]:
    """Running sums of an array column in two steps, over blocks of 16 and inside each, so that long arrays stay cheap."""
    size, part = F.size(lengths), lambda b: F.slice(F.col(lengths), b * 16 + 1, 16)
    numbers = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / 16).cast("int"))).otherwise(F.array().cast("array<int>"))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all"))
    sums = F.transform(numbers, lambda b: F.aggregate(part(b), F.lit(0), lambda n, x: n + x))
    before = F.aggregate(sums, start(F.lit(0)), step)["all"]
    inside = F.flatten(F.transform(F.col("before"), lambda at, b: F.aggregate(part(b), start(at), step)["all"]))
    return before, inside


def token_rows(docs: DataFrame, reach: int, chars: str = T.TOKEN_CHARS) -> DataFrame:
    """(doc_id, j, start, t, ahead, behind): every token with its offset and the text of up to ``reach`` tokens around it.

    ``t`` is as spelt; ``ahead`` is the text from its end through the tokens after it,
    ``behind`` the text before it, read backwards. All three come from one pass of a
    pattern over the text, so no later step needs the text again.
    """
    near = f"(?U)([{chars}]+)(?=((?:[^{chars}]+[{chars}]+){{0,{reach}}}))"
    found = lambda c, k: F.regexp_extract_all(c, F.lit(near), F.lit(k))
    text = F.col("text")
    rows = docs.select("doc_id", found(text, 1).alias("t"), found(text, 2).alias("ahead"), F.reverse(found(F.reverse(text), 2)).alias("behind"), F.transform(F.split(text, f"(?U)[{chars}]+", -1), F.length).alias("gaps"))
    # Each token's length with that of the gap before it; their sums are the offsets.
    rows = rows.select("*", F.zip_with(F.slice("gaps", F.lit(1), F.size("t")), "t", lambda g, t: g + F.length(t)).alias("lengths"))
    before, inside = _ends("lengths")
    rows = rows.select("*", before.alias("before"))
    rows = rows.select("doc_id", F.arrays_zip(inside.alias("at"), F.slice("gaps", F.lit(1), F.size("t")).alias("gap"), "t", "ahead", "behind").alias("all"))
    # An inner explode would be preceded by a filter on the array's size, which makes the array anew with its parts inlined.
    rows = rows.select("doc_id", F.posexplode_outer("all").alias("j", "x")).where("x is not null")
    return rows.select("doc_id", "j", (F.col("x.at") + F.col("x.gap")).alias("start"), "x.t", "x.ahead", "x.behind")


#: Tokens of a piece of ``token_pieces``, at least.
PIECE = 8


def token_pieces(docs: DataFrame, reach: int, chars: str = T.TOKEN_CHARS) -> DataFrame:
    """(doc_id, j, k, t, at, piece, prev, next): every token with the piece of text it stands in and those around it.

    A text is cut once into pieces of as many tokens as a window reaches, each with the
    gaps before them, so a token's offset and what stands around it can be made from
    three pieces, and only for the tokens that are asked for (``around``). It is the
    k-th of its piece, which starts at ``at``.
    """
    size, gap, token = max(PIECE, reach), f"[^{chars}]*+", f"[{chars}]++"
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"(?U)((?:{gap}{token}){{1,{size}}}+)"), F.lit(1)).alias("pieces"))
    rows = rows.select("*", F.transform("pieces", F.length).alias("lengths"))
    before, inside = _ends("lengths")
    rows = rows.select("*", before.alias("before"))
    zipped = F.arrays_zip(inside.alias("at"), F.col("pieces").alias("piece"), F.slice(F.concat(F.array(F.lit("")), "pieces"), F.lit(1), F.size("pieces")).alias("prev"), F.slice("pieces", 2, F.size("pieces")).alias("next"))
    rows = rows.select("doc_id", zipped.alias("all"))
    # Outer, as in token_rows.
    rows = rows.select("doc_id", F.posexplode_outer("all").alias("b", "x")).where("x is not null").select("doc_id", "b", "x.*")
    rows = rows.select("*", F.posexplode_outer(F.regexp_extract_all("piece", F.lit(f"(?U)([{chars}]+)"), F.lit(1))).alias("k", "t")).where("t is not null")
    return rows.select("doc_id", (F.col("b") * size + F.col("k")).alias("j"), "k", "t", "at", "piece", "prev", F.coalesce("next", F.lit("")).alias("next"))


def around(rows: DataFrame, reach: int, chars: str = T.TOKEN_CHARS) -> DataFrame:
    """Tokens of ``token_pieces`` with ``start``, ``near``, the text from the token through ``reach`` more, and ``upto``, the text of at least as many before it."""
    gap, token = f"[^{chars}]", f"[{chars}]"
    lead = F.coalesce(*[F.when(F.col("k") == k, F.regexp_substr("piece", F.lit(f"^(?U)(?:{gap}*+{token}++){{{k}}}{gap}*+"))) for k in range(max(PIECE, reach))], F.lit(""))
    rows = rows.withColumn("lead", lead).withColumn("rest", F.concat(F.substring("piece", F.length("lead") + 1, F.length("piece")), "next"))
    near = F.regexp_substr("rest", F.lit(f"^(?U){token}++(?:{gap}++{token}++){{0,{reach}}}+"))
    return rows.withColumn("near", near).withColumn("start", F.col("at") + F.length("lead")).withColumn("upto", F.concat("prev", "lead")).drop("at", "piece", "prev", "next", "k", "lead", "rest")


def _words(text: Column, chars: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?U)([{chars}]+)"), F.lit(1))


def _tokens_of(text: Column, n: Column, chars: str = T.TOKEN_CHARS, lead: bool = False) -> Column:
    """The text's first n tokens with the gaps between them, or before each of them."""
    gap, token = f"[^{chars}]+", f"[{chars}]+"
    first, more = ("", n) if lead else (token, n - 1)
    return F.coalesce(F.regexp_substr(text, F.concat(F.lit(f"^(?U){first}(?:{gap}{token}){{"), more, F.lit("}"))), F.lit(""))


def phrase_windows(docs: DataFrame, max_n: int, stopwords: Sequence[str], chars: str = T.TOKEN_CHARS) -> DataFrame:
    """(doc_id, i, n, lead, words, start, near): token windows with their ends trimmed.

    ``lead`` stopwords were cut before; ``near`` is the text from the window's start on.
    """
    rows = token_rows(docs, max_n - 1, chars).withColumn("near", F.concat("t", "ahead"))
    rows = rows.select("doc_id", F.col("j").alias("i"), "start", "near", _words(F.col("near"), chars).alias("all"))
    w = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("n")).withColumn("words", F.slice("all", F.lit(1), F.col("n")))
    kept = F.filter(F.transform("words", lambda x, i: F.when(~x.isin(*stopwords), i)), lambda i: i.isNotNull())
    w = w.withColumn("kept", kept).where(F.size("kept") > 0)
    first, last = F.array_min("kept"), F.array_max("kept")
    return w.select("doc_id", "i", "n", first.alias("lead"), F.slice("words", first + 1, last - first + 1).alias("words"), "start", "near")


def _windows_of_names(docs: DataFrame, names: DataFrame, max_n: int, stopwords: Sequence[str]) -> DataFrame:
    """Windows whose trimmed phrase is a name, with the name's columns, offset and text.

    Only the tokens that start a name go on, and are read through as many words as a name
    of theirs has; their windows are then widened by the stopwords around them, so no row
    is made for the other positions.
    """
    reach = max_n - 1
    rows = token_pieces(docs, reach).withColumn("head", F.lower("t"))
    n_words = F.size(F.split("name_lc", " "))
    heads = names.where(n_words <= max_n).groupBy(F.substring_index("name_lc", " ", 1).alias("head")).agg(F.collect_set(n_words).alias("sizes"))
    rows = around(rows.where(~F.col("head").isin(*stopwords)).join(_held(heads), "head"), reach)
    rows = rows.withColumn("words", _words(F.col("near"), T.TOKEN_CHARS))
    rows = rows.withColumn("m", F.explode("sizes")).where(F.col("m") <= F.size("words")).drop("sizes")
    rows = rows.withColumn("name_lc", F.array_join(F.slice("words", F.lit(1), F.col("m")), " "))
    hit = rows.join(_held(names), "name_lc").where(~F.element_at("words", F.col("m")).isin(*stopwords))
    hit = hit.withColumn("behind", F.coalesce(F.regexp_substr(F.reverse("upto"), F.lit(f"^(?U)(?:[^{T.TOKEN_CHARS}]+[{T.TOKEN_CHARS}]+){{0,{reach}}}")), F.lit("")))
    hit = hit.withColumn("back", F.transform(_words(F.col("behind"), T.TOKEN_CHARS), lambda x: F.reverse(x)))
    run = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & x.isin(*stopwords), 1).otherwise(0)).alias("n"), (a["on"] & x.isin(*stopwords)).alias("on")))["n"]
    hit = hit.withColumn("left", run(F.col("back"))).withColumn("right", run(F.slice("words", F.col("m") + 1, F.greatest(F.size("words") - F.col("m"), F.lit(0)))))
    hit = hit.withColumn("a", F.explode(F.sequence(F.lit(0), F.least("left", F.lit(max_n) - F.col("m")))))
    hit = hit.withColumn("b", F.explode(F.sequence(F.lit(0), F.least("right", F.lit(max_n) - F.col("m") - F.col("a")))))
    before = F.when(F.col("a") > 0, F.reverse(_tokens_of(F.col("behind"), F.col("a"), lead=True))).otherwise("")
    hit = hit.withColumn("before", before).withColumn("window", F.concat("before", _tokens_of(F.col("near"), F.col("m") + F.col("b"))))
    return hit.select("doc_id", (F.col("j") - F.col("a")).alias("i"), (F.col("m") + F.col("a") + F.col("b")).alias("n"), "m", *[c for c in names.columns if c != "n_tokens"], (F.col("start") - F.length("before")).alias("win_start"), "window")


def docs_of_names(docs: DataFrame, names: DataFrame, max_n: int, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, name_lc, term_id), distinct: the names whose words stand in a document, as ``_windows_of_names`` finds them.

    Nothing is asked of their places, so words are cut once and no offset or text around them is made.
    """
    words = docs.select("doc_id", _words(F.col("text"), T.TOKEN_CHARS).alias("words"))
    place = lambda x, j: F.when(~x.isin(*stopwords), F.struct(x.alias("head"), F.concat_ws(" ", *[F.get("words", j + k) for k in range(max_n)]).alias("long"), F.least(F.lit(max_n), F.size("words") - j).alias("n")))
    rows = words.select("doc_id", F.explode_outer(F.transform("words", place)).alias("x")).where("x is not null").select("doc_id", "x.*")
    heads = names.select(F.substring_index("name_lc", " ", 1).alias("head")).distinct()
    rows = rows.join(_held(heads), "head", "left_semi").select("doc_id", "long", F.explode(F.sequence(F.lit(1), "n")).alias("m"))
    rows = rows.select("doc_id", F.call_function("substring_index", F.col("long"), F.lit(" "), F.col("m")).alias("name_lc"))
    return rows.where(~F.substring_index("name_lc", " ", -1).isin(*stopwords)).join(_held(names), "name_lc").select("doc_id", "name_lc", "term_id").distinct()


def _with_spans(hits: DataFrame, pad: bool) -> DataFrame:
    """Hits with the offsets of the window (win_start, win_end) and of the span (start, end).

    With ``pad`` the span is the window; else it is the phrase, looked for as it is
    spelt in lower case inside the window, and a window without it is dropped.
    """
    near = hits.withColumn("win_end", F.col("win_start") + F.length("window"))
    if pad:
        near = near.withColumn("start", F.col("win_start")).withColumn("end", F.col("win_end"))
    else:
        at = F.expr("CASE WHEN n = m THEN 1 ELSE locate(name_lc, window) END")
        near = near.withColumn("at", at).where("at > 0").withColumn("start", F.col("win_start") + F.col("at") - 1)
        near = near.withColumn("end", F.when(F.col("n") == F.col("m"), F.col("win_end")).otherwise(F.col("start") + F.length("name_lc")))
    return near.withColumn("span", F.substring("window", F.col("start") - F.col("win_start") + 1, F.col("end") - F.col("start"))).drop("window")


def resolve_overlaps(hits: DataFrame) -> DataFrame:
    """Greedy choice by document: wider windows first, then leftmost; a window one of whose ends lies in an accepted span is blocked."""
    cols = ["term_id", "span", "match_type", "score"]
    item = F.struct((-F.col("n")).alias("k"), "i", "rank", "win_start", "win_end", "start", "end", *cols)
    lists = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    lists = lists.withColumn("free", free_spans("all.win_start", "all.win_end", "all.start", "all.end"))
    return lists.select("doc_id", F.explode(F.arrays_zip("all", "free")).alias("x")).where("x.free").select("doc_id", "x.all.start", "x.all.end", *[f"x.all.{c}" for c in cols])


def _literal(found: DataFrame) -> DataFrame:
    return found.withColumn("match_type", F.when(F.col("is_primary"), "exact").otherwise("synonym")).withColumn("score", F.lit(1.0)).withColumn("rank", F.lit(0))


def match_exact(docs: DataFrame, names: DataFrame, *, max_ngram: int, stopwords: Sequence[str], pad: bool) -> DataFrame:
    """All windows whose phrase is a name, before overlaps are resolved."""
    return _literal(_with_spans(_windows_of_names(docs, names, max_ngram, stopwords), pad))


def _pairs_of_letters(text: Column) -> Column:
    """The distinct pairs of neighbouring letters of a text."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))


def _unmatched(total: Column, t: float) -> Column:
    """The most letters of two texts of ``total`` letters that may be left unmatched at a ratio of at least ``t``."""
    return total - 2 * F.ceil(t * total / 2 - 1e-9).cast("int")


def _parts(length: Column, most: int, t: float, band: int | None) -> Column:
    """Into how many parts a phrase is cut: one more than letters may be unmatched with any name of up to ``most`` letters."""
    ends = [F.floor(length * (2 - t) / t + 1e-9).cast("int"), F.lit(most)] + ([] if band is None else [length + band])
    total = length + F.least(*ends)
    return F.greatest(_unmatched(total, t), _unmatched(total - 1, t), F.lit(0)) + 1


def name_parts(names: DataFrame, *, threshold: float, band: int | None, most: int) -> DataFrame:
    """(lp, i, at, part, name_lc): what the i-th part of a phrase of ``lp`` letters, ``at`` its start, may be if it is close to the name.

    See best_fuzzy. ``most`` is the length of the longest name.
    """
    t, ln, lp, i, e = threshold, F.col("ln"), F.col("lp"), F.col("i"), F.col("e")
    low, high = F.ceil(ln * t / (2 - t) - 1e-9).cast("int"), F.floor(ln * (2 - t) / t + 1e-9).cast("int")
    if band is not None:
        low, high = F.greatest(low, ln - band), F.least(high, ln + band)
    n = names.withColumn("ln", F.length("name_lc")).withColumn("lp", F.explode(F.sequence(low, F.greatest(low, high))))
    n = n.withColumn("spare", _unmatched(ln + lp, t)).withColumn("k", _parts(lp, most, t, band)).where("spare >= abs(ln - lp)")
    n = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.least("spare", F.col("k") - 1))))
    n = n.withColumn("e", F.explode(F.sequence(-i, i, F.when(i > 0, 2).otherwise(1)))).where(F.abs(ln - lp - e) <= F.col("spare") - i)
    n = n.withColumn("from", F.expr("i * lp div k")).withColumn("size", F.expr("(i + 1) * lp div k - i * lp div k"))
    n = n.where((F.col("from") + e >= 0) & (F.col("from") + e + F.col("size") <= ln))
    return n.select("lp", "i", F.substring("name_lc", F.col("from") + e + 1, F.col("size")).alias("part"), "name_lc", F.col("from").alias("at")).distinct()


def best_fuzzy(phrases: DataFrame, names: DataFrame, *, threshold: float = 0.85, band: int | None = 10) -> DataFrame:
    """(phrase, term_id, score, name_lc): the first best name of each distinct phrase, by sequence ratio.

    A ratio of the threshold aligns two texts so that of their la + lb letters at most
    so many, say u, are left unmatched, each of them in one text only. A phrase is cut
    into more parts than that for any name that it may be close to. Give every unmatched
    letter to the part it stands in or before. Then for some i the parts up to part i
    hold i of them, and part i none: it stands unchanged in the name, moved by a sum of i
    steps to either side, and the rest of both texts makes up for the rest of u. So a
    name is entered for each length of phrase, part and such move, and a phrase meets
    names by equal parts, which loses none. An index of at most PROBED_PARTS rows is
    broadcast and probed by whole batches, and of the pairs that meet those go on whose
    longest common subsequence allows the threshold; a larger one is joined by shuffle,
    and those go on that share enough pairs of letters.

    Phrases are cut as they come; only what is scored is made distinct.
    """
    t, n = threshold, _fuzzy_names(names)
    shortest, most = n.agg(F.min(F.length("name_lc")), F.max(F.length("name_lc"))).first()
    index = write_shared(name_parts(n.select("name_lc"), threshold=t, band=band, most=most or 1), "name-parts")
    ends = (math.ceil((shortest or 1) * t / (2 - t) - 1e-9), math.floor((most or 0) * (2 - t) / t + 1e-9))
    if band is not None:
        ends = (max(ends[0], (shortest or 1) - band), min(ends[1], (most or 0) + band))
    p = phrases.select("phrase").withColumn("lp", F.length("phrase")).where(F.col("lp").between(*ends))
    if small_enough(index, PROBED_PARTS, BROADCAST_BYTES):
        pairs = near_pairs(p, index, t).distinct()
    else:
        k, lp, ln = _parts(F.col("lp"), most or 1, t, band), F.col("lp"), F.length("name_lc")
        cut = lambda i: F.floor(i * F.col("lp") / F.col("k")).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.substring(F.col("phrase"), cut(i) + 1, cut(i + 1) - cut(i)))
        met = p.withColumn("k", k).select("phrase", "lp", F.posexplode(parts).alias("i", "part")).join(index.drop("at"), ["lp", "i", "part"])
        # Of a name's pairs of letters an unmatched letter of its own breaks two at most, one of the phrase breaks one.
        own, broken = _pairs_of_letters(F.col("name_lc")), ln * (2 - 1.5 * t) + lp * (1 - 1.5 * t)
        alike = (lp < 2) | (ln < 2) | (F.size(F.array_intersect(own, _pairs_of_letters(F.col("phrase")))) >= F.size(own) - F.floor(broken + 1e-9))
        pairs = met.where(alike).select("phrase", "name_lc").distinct()
    return _best_names(pairs, n, t)


def _fuzzy_names(names: DataFrame) -> DataFrame:
    """names(name_lc, term_id, ord) of ordered_names, each once."""
    return write_shared(names.where("name_lc <> ''").groupBy("name_lc").agg(F.min_by("term_id", "ord").alias("term_id"), F.min("ord").alias("ord")), "fuzzy-names")


def _best_names(pairs: DataFrame, n: DataFrame, t: float) -> DataFrame:
    """The first best name of each phrase of ``pairs(phrase, name_lc)``, by sequence ratio."""
    scored = pairs.withColumn("score", sequence_ratio("phrase", "name_lc", F.lit(t))).where(F.col("score") >= t).join(_held(n), "name_lc")
    best = scored.groupBy("phrase").agg(F.max_by(F.struct("term_id", "score", "name_lc"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("phrase", F.col("b.term_id").alias("term_id"), F.col("b.score").alias("score"), F.col("b.name_lc").alias("name_lc"))


def ordered_names(terms: DataFrame) -> DataFrame:
    """Every name with a number in file order, as fuzzy matching tries them."""
    rows = explode_names(terms).where("name <> ''")
    return rows.select(F.lower("name").alias("name_lc"), "term_id", (F.col("ord") * 1000 + F.col("pos")).alias("ord"))


def _phrases(words: DataFrame, max_ngram: int, stopwords: Sequence[str]) -> DataFrame:
    """(phrase) of every window of two or more words of ``words(words)`` without stopwords at its ends. It is the first words of the longest one at its place."""
    most = F.lit(max_ngram)
    longest = lambda x, j: F.when(~x.isin(*stopwords), F.struct(F.concat_ws(" ", *[F.get("words", j + k) for k in range(max_ngram)]).alias("long"), F.least(most, F.size("words") - j).alias("n")))
    places = words.select(F.explode(F.transform("words", longest)).alias("x")).where("x is not null and x.n > 1").select("x.*")
    first = lambda m: F.call_function("substring_index", F.col("long"), F.lit(" "), m)
    return places.select(F.explode(F.transform(F.sequence(F.lit(2), F.col("n")), first)).alias("phrase")).where(~F.substring_index("phrase", " ", -1).isin(*stopwords))


def _near_names(docs: DataFrame, terms: DataFrame, max_ngram: int, stopwords: Sequence[str], threshold: float) -> DataFrame:
    """(name_lc, term_id, is_primary, closeness): phrases of two or more words of ``docs`` close to a name but equal to none.

    A window's trimmed phrase is a window without stopwords at its ends, so those are
    scored: of few names those that the words' bounds leave (WordBounds), else by best_fuzzy.
    """
    words, names = docs.select(_words(F.col("text"), T.TOKEN_CHARS).alias("words")), ordered_names(terms)
    known = _fuzzy_names(names)
    few = [r[0] for r in known.select("name_lc").limit(WORD_NAMES + 1).collect()]
    if len(few) <= WORD_NAMES:
        best = _best_names(near_windows(words, few, threshold, 10, max_ngram, stopwords).distinct(), known, threshold)
    else:
        best = best_fuzzy(_phrases(words, max_ngram, stopwords), names, threshold=threshold)
    exact = name_index(terms).select(F.col("name_lc").alias("phrase"))
    best = best.join(_held(exact), "phrase", "left_anti")
    return write_shared(best.select(F.col("phrase").alias("name_lc"), "term_id", F.lit(False).alias("is_primary"), F.round("score", 3).alias("closeness")), "near-names")


def match_fuzzy(docs: DataFrame, terms: DataFrame, *, max_ngram: int, stopwords: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Windows of two or more words close to a name but equal to none; found around near phrases as around names."""
    near = _near_names(docs, terms, max_ngram, stopwords, threshold)
    return _graded(_with_spans(_windows_of_names(docs, near, max_ngram, stopwords), pad=False))


def _graded(found: DataFrame) -> DataFrame:
    """Windows of names and near names with match_type, score and rank; names have no ``closeness``."""
    near = F.col("closeness").isNotNull()
    out = _literal(found).withColumn("match_type", F.when(near, "fuzzy").otherwise(F.col("match_type")))
    return out.withColumn("score", F.coalesce("closeness", "score")).withColumn("rank", near.cast("int")).drop("closeness")


def id_hits(docs: DataFrame, alias: DataFrame) -> DataFrame:
    """(doc_id, start, end, term_id, span, match_type, score) of ids written out in the text, whose places come from one pass over it."""
    rows = docs.select("doc_id", F.regexp_extract_all("text", F.lit(f"({T.TERM_ID})"), F.lit(1)).alias("t"), F.transform(F.split("text", T.TERM_ID, -1), F.length).alias("gaps")).where(F.size("t") > 0)
    rows = rows.select("*", F.zip_with(F.slice("gaps", F.lit(1), F.size("t")), "t", lambda g, t: g + F.length(t)).alias("lengths"))
    before, inside = _ends("lengths")
    rows = rows.select("*", before.alias("before")).select("doc_id", F.arrays_zip(inside.alias("at"), F.slice("gaps", F.lit(1), F.size("t")).alias("gap"), F.col("t").alias("span")).alias("all"))
    rows = rows.select("doc_id", F.explode_outer("all").alias("x")).where("x is not null").select("doc_id", (F.col("x.at") + F.col("x.gap")).alias("start"), "x.span")
    rows = rows.withColumn("any_id", F.upper("span")).join(_held(alias), "any_id")
    return rows.select("doc_id", "start", (F.col("start") + F.length("span")).alias("end"), "term_id", "span", F.lit("go_id").alias("match_type"), F.lit(1.0).alias("score"))


def _first_by(hits: DataFrame, *key: str) -> DataFrame:
    order = F.struct(F.when(F.col("match_type") == "go_id", 0).otherwise(1), F.col("start"), F.col("term_id"))
    rest = [c for c in hits.columns if c not in key]
    return hits.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*key, *[f"x.{c}" for c in rest]).select(*hits.columns)


def annotate_dictionary(docs: DataFrame, terms: DataFrame, *, alias: DataFrame | None = None, max_ngram: int = 8, fuzzy_threshold: float = 0.85, use_fuzzy: bool = True, stopwords: Sequence[str] = T.DICT_STOPWORDS) -> DataFrame:
    """Ids, names and near names of each document, overlaps resolved; one hit for each (start, end)."""
    names = name_index(terms).drop("n_tokens").withColumn("closeness", F.lit(None).cast("double"))
    if use_fuzzy:
        names = names.unionByName(_near_names(docs, terms, max_ngram, stopwords, fuzzy_threshold))
    # Near phrases are no names, so one pass over the documents finds both.
    out = resolve_overlaps(_graded(_with_spans(_windows_of_names(docs, names, max_ngram, stopwords), pad=False)))
    if alias is not None:
        out = out.unionByName(id_hits(docs, alias))
    return _first_by(out, "doc_id", "start", "end")


def annotate_ngram(docs: DataFrame, terms: DataFrame, *, alias: DataFrame | None = None, max_ngram: int = 5, pad_stopwords: bool = True) -> DataFrame:
    """The exact-only baseline; one hit for each (start, end, term)."""
    hits = match_exact(docs, name_index(terms, strip=True), max_ngram=max_ngram, stopwords=T.NGRAM_STOPWORDS, pad=pad_stopwords)
    out = resolve_overlaps(hits)
    if alias is not None:
        out = out.unionByName(id_hits(docs, alias))
    return _first_by(out, "doc_id", "start", "end", "term_id")


def candidate_phrases(docs: DataFrame, *, max_ngram: int = 5, limit: int = 80) -> DataFrame:
    """(doc_id, rank, phrase): distinct phrases, longest first, not general ones.

    A document's windows are cut, told apart and ranked in its own row, so no window is
    shuffled.
    Texts of one id, where there are any, are ranked together from their rows' phrases.
    """
    words = _words(F.col("text"), T.TOKEN_CHARS_NO_SLASH)
    rows = docs.select("doc_id", words.alias("w")).withColumn("ok", F.transform("w", lambda x: ~x.isin(*T.NGRAM_STOPWORDS)))
    kind = "array<struct<n: int, size: int, phrase: string>>"

    def best(n: int) -> Column:
        # A slice inside a lambda would copy the whole array for each window.
        cut = lambda i: F.when(F.get("ok", i) & F.get("ok", i + (n - 1)), F.concat_ws(" ", *[F.get("w", i + k) for k in range(n)]))
        windows = F.transform(F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n)), cut)
        kept = F.filter(F.array_distinct(windows), lambda x: (F.length(x) >= 3) & ~T.is_generic(x))
        ranked = F.array_sort(F.transform(kept, lambda x: F.struct(F.lit(-n).alias("n"), (-F.length(x)).alias("size"), x.alias("phrase"))))
        return F.coalesce(F.slice(ranked, 1, limit), F.array().cast(kind))

    ranked = [best(n) for n in range(max_ngram, 0, -1)]
    rows = rows.withColumn("found", F.slice(F.concat(*ranked), 1, limit))
    rows = rows.select("doc_id", "found")
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Outer, as in token_rows: a filter on the array's size would make it anew with its parts inlined.
        return rows.select("doc_id", F.posexplode_outer("found").alias("rank", "x")).where("x is not null").select("doc_id", (F.col("rank") + 1).alias("rank"), "x.phrase")
    order = Window.partitionBy("doc_id").orderBy("n", "size", "phrase")
    w = rows.select("doc_id", F.explode_outer("found").alias("x")).where("x is not null").select("doc_id", "x.*").distinct()
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("doc_id", "rank", "phrase")


def hybrid_phrases(docs: DataFrame, *, max_ngram: int = 5) -> DataFrame:
    """(doc_id, phrase): all distinct windows without stopwords at their ends, and the whole text."""
    w = phrase_windows(docs, max_ngram, T.HYBRID_STOPWORDS, T.TOKEN_CHARS_NO_SLASH).select("doc_id", F.array_join("words", " ").alias("phrase"))
    return w.unionByName(docs.select("doc_id", F.lower(F.trim("text")).alias("phrase"))).where("phrase <> ''").distinct()


def normalize_terms(mentions: DataFrame, terms: DataFrame, *, alias: DataFrame, fuzzy_threshold: float = 0.85) -> DataFrame:
    """(mention, term_id, how): by exact name, else by a leading id, else by the closest name."""
    m = mentions.select("mention").distinct().withColumn("phrase", F.lower(F.trim("mention")))
    names = name_index(terms).select(F.col("name_lc").alias("phrase"), F.col("term_id").alias("by_name"))
    m = m.join(_held(names), "phrase", "left")
    ids = alias.select(F.col("any_id").alias("lead"), F.col("term_id").alias("by_id"))
    m = m.withColumn("lead", F.upper(F.regexp_extract(F.trim("mention"), r"(?iU)^GO:\d{7}\b", 0))).join(_held(ids), "lead", "left")
    rest = m.where("by_name is null and by_id is null and lead = ''")
    near = best_fuzzy(rest, ordered_names(terms), threshold=fuzzy_threshold, band=None).select("phrase", F.col("term_id").alias("by_near"))
    out = m.join(near, "phrase", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_id").isNotNull(), "id").when(F.col("by_near").isNotNull(), "fuzzy").otherwise("none")
    return out.select("mention", F.coalesce("by_name", "by_id", "by_near").alias("term_id"), how.alias("how"))


def words_of(text: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def word_overlap(phrase: Column, name: Column) -> Column:
    """Share of the name's distinct words that stand in the phrase."""
    return F.size(F.array_intersect(words_of(phrase), words_of(name))) / F.greatest(F.size(words_of(name)), F.lit(1))


def score_normalized(normalized: DataFrame, *, min_overlap: float = 0.5) -> DataFrame:
    """``normalized(mention, name, ..)`` with confidence and match_type; general words and weak overlaps get none."""
    overlap = word_overlap(F.col("mention"), F.col("name"))
    known = F.col("name").isNotNull() & ~T.is_generic(F.col("mention"))
    exact = known & (F.lower("mention") == F.lower("name"))
    close = known & (overlap >= min_overlap)
    kind = F.when(exact, "dict_exact").when(close, "dict_fuzzy").otherwise("none")
    return normalized.withColumn("match_type", kind).withColumn("confidence", F.when(exact, 1.0).when(close, 0.6 + 0.3 * overlap).otherwise(0.0))


def score_phrases(normalized: DataFrame, *, threshold: float = 0.55) -> DataFrame:
    """The phrase variant: 0.9 for a term's name, 0.65 else, below the threshold dropped; unknown phrases stay with 0."""
    found = F.col("name").isNotNull()
    exact = F.lower("mention") == F.lower("name")
    c = F.when(~found, 0.0).when(exact, 0.9).otherwise(0.65)
    kind = F.when(~found, "none").when(exact, "dict_exact").otherwise("dict_fuzzy")
    return normalized.withColumn("confidence", c).withColumn("match_type", kind).where(~found | (F.col("confidence") >= threshold))


def gate_to_candidates(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Choices of a model that were offered for their document; the first of each term, confidence in 0..1, by default the candidate's score.

    Of choices at one place the more confident is the first.
    """
    offered = candidates.groupBy("doc_id", "term_id").agg(F.max("score").alias("__score"))
    first = Window.partitionBy("doc_id", "term_id").orderBy("pos", F.desc_nulls_last("confidence"))
    j = chosen.withColumn("k", F.row_number().over(first)).where("k = 1").join(offered, ["doc_id", "term_id"])
    return j.select("doc_id", "term_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", "__score"))).alias("confidence"))


def sentence_table(docs: DataFrame, least: int = 6) -> DataFrame:
    """(doc_id, sentence, start, end) of every sentence without outer white space: parts that full stops, semicolons and line ends part."""
    parts = docs.select("doc_id", F.split("text", "[.;\n]", -1).alias("parts"))
    parts = parts.select("doc_id", "parts", F.transform("parts", lambda s: F.length(s) + 1).alias("lengths"))
    before, inside = _ends("lengths")
    rows = parts.select("*", before.alias("before")).select("doc_id", F.explode_outer(F.arrays_zip(F.col("parts").alias("s"), inside.alias("at"))).alias("x")).where("x is not null")
    lead = F.length("x.s") - F.length(F.ltrim(F.col("x.s"), F.lit(T.BLANK)))
    rows = rows.select("doc_id", F.trim(F.col("x.s"), F.lit(T.BLANK)).alias("sentence"), (F.col("x.at") + lead).alias("start"))
    return rows.where(F.length("sentence") >= least).withColumn("end", F.col("start") + F.length("sentence"))


#: Characters of a bin in which sentences and hits meet.
BIN = 256


def overlaps(spans: DataFrame, hits: DataFrame, width: int = BIN) -> DataFrame:
    """``spans(doc_id, start, end, ..)`` with ``covered``: the sum of what each hit of the document shares with it.

    Both sides are dealt to the bins that they touch and meet there; a pair counts in
    the first bin that both touch. So a span meets what lies near it and not all hits
    of its document, and the parts of a long document are worked on apart. Only places
    go to the bins: a long span's text is not repeated in each of its own. Spans without
    a hit have 0; empty spans and hits touch nothing.
    """
    place = ["doc_id", "start", "end"]
    bins = lambda a, b: F.explode_outer(F.when(b > a, F.sequence((a / width).cast("int"), ((b - 1) / width).cast("int"))))
    s = spans.select(*place).where("end > start").distinct().withColumn("bin", bins(F.col("start"), F.col("end")))
    h = hits.select(F.col("doc_id").alias("hid"), F.col("start").alias("hs"), F.col("end").alias("he")).where("he > hs")
    h = h.withColumn("hbin", bins(F.col("hs"), F.col("he")))
    both = s.join(h, (F.col("doc_id") == F.col("hid")) & (F.col("bin") == F.col("hbin")) & (F.col("hs") < F.col("end")) & (F.col("he") > F.col("start")))
    cover = F.sum(F.least("end", "he") - F.greatest("start", "hs"))
    covered = both.where(F.col("bin") == (F.greatest("start", "hs") / width).cast("int")).groupBy(*place).agg(cover.alias("covered"))
    return spans.join(covered, place, "left").select(*spans.columns, F.coalesce("covered", F.lit(0)).alias("covered"))


def uncovered_sentences(docs: DataFrame, hits: DataFrame, *, most: float = 0.6) -> DataFrame:
    """(doc_id, sentence, start, end) of sentences of which hits cover at most ``most``."""
    return overlaps(sentence_table(docs), hits).where(F.col("covered") <= most * (F.col("end") - F.col("start")))
