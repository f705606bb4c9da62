"""Quality rules as a short-circuit cascade.

A rule rejects a document by a few measures, and a measure may be made from others
(the repeated windows from the words). What a rule costs is the time of those measures
that no earlier rule has paid for; what it is worth is the share of the documents still
there that it rejects. Both are taken on a sample: every task of the sample times each
measure and groups its rows by the set of rules that reject them, and the groups (at
most one a sampled row) are summed. The order is then chosen greedily: of the rules left
the one with the most rejections per second among the sampled rows that no chosen rule
rejects, at the cost of its unpaid measures.

The pass over all documents runs the rules in that order and stops at a document's first
rejection, so measures of later rules are never made for it. Measures that the caller
wants in the result are made for every document and cost the rules nothing.

The sample only decides the order: a document is kept if no rule rejects it, whatever
the order. ``rejected_by`` names the first rule in it, so it can differ between runs;
pass ``order`` to hold it.

Defined cases: null and empty texts have no words, and all measures are 0; rules divide
nothing, so no measure is undefined; a null id and repeated rows are judged like any
row; very long texts are read whole; an empty table gives no rows, an empty sample the
rules' own order; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import small_batches

#: Rows of the sample by which the rules are ordered (about; twice as many at most).
SAMPLE_ROWS = 2000
#: What counts as a symbol.
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words in windows of ``width`` words that stand twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    again = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    inside = np.zeros(len(words), bool)
    for i in range(width):
        inside[i : i + len(again)] |= again
    return int(inside.sum())


#: Measures by name: what each is made from, and how. ``text`` is the UTF-8 text.
MEASURES: dict[str, tuple[tuple[str, ...], Callable]] = {
    "words": (("text",), lambda text: text.split()),
    "n_words": (("words",), len),
    "word_chars": (("words",), lambda words: len(b"".join(words).translate(None, _CONTINUATION))),
    "n_symbols": (("text",), lambda text: len(text) - len(text.translate(None, SYMBOLS))),
    "lines": (("text",), lambda text: [x for x in text.split(b"\n") if x.strip()]),
    "n_lines": (("lines",), len),
    "n_dup_lines": (("lines",), lambda lines: len(lines) - len(set(lines))),
    "n_repeat_words": (("words",), repeated_words),
    "n_capitals": (("words",), lambda words: sum(map(bytes.isupper, words))),
    "n_exclamations": (("text",), lambda text: text.count(b"!")),
    "n_top_word": (("words",), lambda words: max(Counter(words).values(), default=0)),
    "n_wordless": (("words",), lambda words: sum(not _LETTER.search(w) for w in words)),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the measures of ``needs`` in that order."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., bool]


BASE = (
    Rule("too_few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, x: 100 * x > 50 * n),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, x: 10 * x > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, x: x < 3 * n or x > 12 * n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, x: 10 * x > 3 * n),
    Rule("capitals", ("n_words", "n_capitals"), lambda n, x: 2 * x > n),
    Rule("exclamations", ("n_words", "n_exclamations"), lambda n, x: 10 * x > n),
    Rule("one_word", ("n_words", "n_top_word"), lambda n, x: 4 * x > n),
    Rule("wordless", ("n_words", "n_wordless"), lambda n, x: 5 * x > n),
)
#: Measures that the registered query returns for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """The measures of one text, each made when it is first asked for."""

    def __init__(self, text: bytes | None):
        self.known, self.seconds = {"text": text or b""}, {}

    def __getitem__(self, name: str):
        if name not in self.known:
            parts, make = MEASURES[name]
            given = [self[p] for p in parts]
            began = time.perf_counter()
            self.known[name] = make(*given)
            self.seconds[name] = time.perf_counter() - began
        return self.known[name]

    def rejected(self, rule: Rule) -> bool:
        return bool(rule.rejects(*(self[x] for x in rule.needs)))


def parts_of(names: Sequence[str]) -> set[str]:
    """These measures and all that they are made from."""
    found: set[str] = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found and name != "text":
            found.add(name)
            todo += MEASURES[name][0]
    return found


def choose_order(rules: Sequence[Rule], seconds: dict[str, float], groups: dict[int, int], paid: Sequence[str] = ()) -> list[str]:
    """Rules by rejections per second among what is left; ``groups`` counts sampled rows by their bits of rejecting rules."""
    left, have, order = dict(enumerate(rules)), parts_of(paid), []
    while left:
        def worth(i: int) -> float:
            cost = sum(seconds.get(x, 0.0) for x in parts_of(left[i].needs) - have)
            return sum(n for bits, n in groups.items() if bits >> i & 1) / (cost + 1e-9)

        best = max(left, key=lambda i: (worth(i), -i))
        order.append(left[best].name)
        have |= parts_of(left.pop(best).needs)
        groups = {bits: n for bits, n in groups.items() if not bits >> best & 1}
    return order


def sample_costs(docs: DataFrame, rules: Sequence[Rule], rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[int, int]]:
    """(seconds of each measure, sampled rows by their bits of rejecting rules)."""
    names = sorted(parts_of([x for r in rules for x in r.needs]))
    share = max(1, docs.count() // rows)
    picked = docs.select("text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0).limit(2 * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, spent = Counter(), Counter()
        for batch in batches:
            for text in batch["text"].cast(pa.binary()).to_pylist():
                own = Measured(text)
                groups[sum(own.rejected(r) << i for i, r in enumerate(rules))] += 1
                spent.update(own.seconds)
        times = pa.array([[spent[x] for x in names]] + [None] * (len(groups) - 1), pa.list_(pa.float64())) if groups else pa.array([], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(groups), pa.int64()), pa.array(list(groups.values()), pa.int64()), times], ["bits", "n", "times"])

    found = picked.mapInArrow(run, "bits long, n long, times array<double>").collect()  # at most 2 * rows
    groups = Counter()
    for r in found:
        groups[r["bits"]] += r["n"]
    return {x: sum(r["times"][i] for r in found if r["times"]) for i, x in enumerate(names)}, groups


def cascade(docs: DataFrame, *, rules: Sequence[Rule] = RULES, report: Sequence[str] = REPORTED, order: Sequence[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the reported measures, ``n_tried`` rules, the first that rejects (``rejected_by``, else null) and ``kept``."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    if order is None:
        order = choose_order(rules, *sample_costs(docs, rules, sample_rows), report)
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, tried, first = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                own = Measured(text)
                made.append([own[x] for x in report])
                at = next((i for i, r in enumerate(ordered) if own.rejected(r)), None)
                tried.append(len(ordered) if at is None else at + 1)
                first.append(None if at is None else ordered[at].name)
            columns = [pa.array([m[i] for m in made], pa.int64()) for i in range(len(report))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns, pa.array(tried, pa.int32()), pa.array(first, pa.string())], ["doc_id", *report, "n_tried", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, {''.join(f'{x} long, ' for x in report)}n_tried int, rejected_by string")
    return out.withColumn("kept", F.col("rejected_by").isNull())


def digest(judged: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *REPORTED, failed.alias("base_failed"), "kept")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, unnest(range(len(w) - 2)) AS i, unnest([w[j + 1] || ' ' || w[j + 2] || ' ' || w[j + 3] for j in range(len(w) - 2)]) AS k FROM t WHERE len(w) > 2),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM pos),
rep AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY doc_id),
tops AS (SELECT doc_id, max(c)::BIGINT AS n_top FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM t) GROUP BY doc_id, word) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             [y for y in string_split(x, chr(10)) if regexp_matches(y, '[^\x20\x09-\x0D]')] AS ls, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_top, 0) AS n_top,
             len([y for y in w if regexp_matches(y, '[A-Z]') AND NOT regexp_matches(y, '[a-z]')]) AS n_capitals, length(regexp_replace(x, '[^!]', '', 'g')) AS n_excl,
             len([y for y in w if NOT regexp_matches(y, '[A-Za-z\x{80}-\x{10FFFF}]')]) AS n_wordless
      FROM t LEFT JOIN rep USING (doc_id) LEFT JOIN tops USING (doc_id)),
r AS (SELECT *, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 3 * n_lines OR 2 * n_capitals > n_words
            OR 10 * n_excl > n_words OR 4 * n_top > n_words OR 5 * n_wordless > n_words) AS kept
FROM r
"""
