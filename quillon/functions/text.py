"""Text and JSON expressions: every function takes columns and returns a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words trimmed from the ends of dictionary windows.
DICT_STOPWORDS = ("and", "or", "the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being")
#: Words trimmed from the ends of n-gram baseline windows.
NGRAM_STOPWORDS = ("the", "a", "an", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being", "and", "or", "that", "this", "which", "it", "its", "into", "under")
#: Words trimmed from the ends of hybrid windows.
HYBRID_STOPWORDS = tuple(w for w in NGRAM_STOPWORDS if w not in ("into", "under"))
#: Words too general to stand for a term.
GENERIC_WORDS = ("development", "process", "response", "regulation", "activity", "function", "organization", "pathway", "mechanism", "system", "signaling", "expression", "biosynthesis", "metabolism", "growth", "integrity", "homeostasis", "cascade", "network", "machinery")

TOKEN_CHARS, TOKEN_CHARS_NO_SLASH = r"\w\-/", r"\w\-"
TOKEN, TOKEN_NO_SLASH = rf"(?U)[{TOKEN_CHARS}]+", rf"(?U)[{TOKEN_CHARS_NO_SLASH}]+"
#: Fixed value: the characters that count as outer white space of a sentence.
BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
TERM_ID = r"(?iU)\bGO:\d{7}\b"


def tokenize(text: Column, pattern: str = TOKEN) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1))


def trim_stopwords(words: Column, stopwords: Sequence[str]) -> Column:
    """Words without stopwords at either end."""
    kept = F.transform(words, lambda w, i: F.when(~w.isin(*stopwords), i))
    kept = F.filter(kept, lambda i: i.isNotNull())
    return F.when(F.size(kept) > 0, F.slice(words, F.array_min(kept) + 1, F.array_max(kept) - F.array_min(kept) + 1)).otherwise(F.slice(words, 1, 0))


def detect_lang(text: Column, given: Column | None = None) -> Column:
    """zh if over a tenth of the characters are Chinese, else en; a given language wins."""
    chinese = F.length(text) - F.length(F.regexp_replace(text, "[一-鿿]", ""))
    found = F.when(chinese > 0.1 * F.length(text), "zh").otherwise("en")
    return found if given is None else F.when(given.isin("zh", "en"), given).otherwise(found)


def sentences(text: Column, least: int = 6) -> Column:
    """Distinct trimmed sentences of at least ``least`` characters."""
    parts = F.transform(F.split(text, "[.;\n]"), lambda s: F.trim(s, F.lit(BLANK)))
    return F.array_distinct(F.filter(parts, lambda s: F.length(s) >= least))


def node_text(*parts: tuple[str, Column]) -> Column:
    """``label: value`` lines of the parts that are not empty."""
    return F.concat_ws("\n", *[F.when(c != "", F.concat(F.lit(f"{label}: "), c)) for label, c in parts])


#: The labels of a node's parts, by its type.
NODE_PARTS = {
    "GO_Term": (("Name", "name"), ("GO ID", "node_id"), ("Namespace", "namespace"), ("Synonyms", "synonyms"), ("Description", "description"), ("Comment", "comment")),
    "Gene": (("Gene Name", "name"), ("EntrezID", "entrez_id")),
    "PMID": (("Title", "name"), ("Journal", "journal"), ("Year", "year")),
    "RTO_Term": (("RTO Term", "name"), ("RTO ID", "node_id"), ("Description", "description")),
}


def typed_node_text(node_type: Column) -> Column:
    """Text to embed of a node of any type, from the union's columns."""
    out = F.lit("")
    for kind, parts in NODE_PARTS.items():
        out = F.when(node_type == kind, node_text(*[(label, F.col(c)) for label, c in parts])).otherwise(out)
    return out


def term_text(name: Column, synonyms: Column, definition: Column, include_synonyms: bool = True) -> Column:
    """``name. Synonyms: a; b. definition`` without blank parts."""
    listed = F.filter(F.transform(synonyms, lambda s: F.trim(s)), lambda s: s != "")
    parts = [F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(definition), F.lit(""))]
    if include_synonyms:
        parts.insert(1, F.when(F.size(listed) > 0, F.concat(F.lit("Synonyms: "), F.array_join(listed, "; "))))
    return F.concat_ws(". ", *parts)


def is_generic(phrase: Column) -> Column:
    return F.lower(F.trim(phrase)).isin(*GENERIC_WORDS)


def locate_span(text: str, span: str) -> Column:
    """struct(span, start, end) for two column names."""
    at = f"locate(lower({span}), lower({text}))"
    return F.expr(f"CASE WHEN {span} <> '' AND {at} > 0 THEN named_struct('span', substring({text}, {at}, length({span})), 'start', {at} - 1, 'end', {at} - 1 + length({span})) ELSE named_struct('span', {span}, 'start', -1, 'end', -1) END")


def sanitize_answer(text: Column) -> Column:
    """Text without term-id labels and ids."""
    return F.regexp_replace(F.regexp_replace(text, r"(?iU)\bGO\s*ID\b", ""), TERM_ID, "")


def extract_ids(text: Column) -> Column:
    """Term ids in order, upper-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"({TERM_ID})"), F.lit(1)), F.upper)


def _without_thinking(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)<think>.*?</think>", "")


def parse_phrases(content: Column) -> Column:
    """The first JSON array of strings in a model answer; empty where it is none."""
    found = F.regexp_extract(_without_thinking(content), r"(?s)\[.*?\]", 0)
    return F.filter(F.coalesce(F.from_json(found, "array<string>"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")


def parse_choices(content: Column) -> Column:
    """The JSON array of (go_id, span, confidence) in a model answer; empty where it is none."""
    found = F.regexp_extract(_without_thinking(content), r"(?s)\[.*\]", 0)
    kind = "array<struct<go_id: string, span: string, confidence: double>>"
    return F.filter(F.coalesce(F.from_json(found, kind), F.array().cast(kind)), lambda x: x["go_id"].isNotNull() & (x["go_id"] != ""))
