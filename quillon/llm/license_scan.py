"""License scans: fuzzy search for short notices.

A text is reduced to its words (A-Z lower-cased, all other ASCII characters but
letters and digits part words), single-spaced. Each notice may differ by ``edits``
characters: cut into ``edits + 1`` pieces, one of them must stand unchanged
(pigeonhole), so an Aho-Corasick pass over the pieces finds every candidate place.
There the regex library matches the whole notice with bounded errors, and the span
is reported if it also holds the notice's key words unchanged, which tell one
license from another.

Defined cases: null and empty texts have no words and no matches; equal rows are
scanned alike; ties between matches at one place go to fewer edits, then to the
notice listed first; a table without rows gives none; extra columns, of whatever
name, are not read. A text is scanned whole in one task, in time that grows with its
length and the places found: word numbers are counted on from place to place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import small_batches

#: Phrases whose exact places are counted, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    keys: tuple[str, ...]
    edits: int


#: Short notices, the words that must stand unchanged, and the edits allowed.
NOTICES = (
    Notice("mit", "licensed under the mit license", ("mit",), 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("granted",), 6),
    Notice("apache-2", "licensed under the apache license version 2", ("2",), 4),
    Notice("apache-2", "http www apache org licenses license 2 0", ("2",), 3),
    Notice("cc-by-nc", "licensed under cc by nc", ("by", "nc"), 2),
    Notice("cc-by-nc", "creative commons attribution noncommercial", (), 4),
    Notice("cc-by-sa", "creative commons attribution sharealike", (), 4),
    Notice("cc-by", "licensed under creative commons attribution 4 0", ("4",), 4),
    Notice("cc0", "creative commons zero public domain dedication", (), 4),
    Notice("gpl-3", "gnu general public license version 3", ("3",), 3),
    Notice("gpl-2", "gnu general public license version 2", ("2",), 3),
    Notice("lgpl", "gnu lesser general public license", (), 3),
    Notice("agpl-3", "gnu affero general public license", (), 3),
    Notice("bsd", "redistribution and use in source and binary forms", ("binary",), 4),
    Notice("bsd", "licensed under the bsd license", ("bsd",), 3),
    Notice("mpl-2", "mozilla public license version 2", ("2",), 3),
    Notice("proprietary", "all rights reserved", ("reserved",), 1),
    Notice("unlicense", "free and unencumbered software released into the public domain", (), 5),
)

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATCH = "struct<label: string, word: long, n_words: int, edits: int, span: string>"
COLUMNS = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, matches array<{MATCH}>"


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """(offset, piece) of ``edits + 1`` nearly equal parts."""
    n, k = len(notice.text), notice.edits + 1
    cuts = [round(i * n / k) for i in range(k + 1)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """The notices' automaton and patterns, built once in each task."""

    def __init__(self, notices: Sequence[Notice], phrases: Sequence[tuple[str, str]]):
        import ahocorasick
        import regex

        self.notices, self.phrases = notices, [(f" {p} ".encode(), label) for p, label in phrases]
        seeds: dict[str, list] = {}
        for i, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                seeds.setdefault(piece, []).append((i, offset + len(piece)))
        self.seeds = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.seeds.add_word(piece, uses)
        self.seeds.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(x.text, literal_spaces=True)}){{e<={x.edits}}}(?!\S)") for x in notices]

    def places(self, padded: bytes) -> list[tuple[int, str]]:
        """(word, label) of each exact phrase, overlapping ones too."""
        found = []
        for phrase, label in self.phrases:
            at, before, word = padded.find(phrase), 0, 0
            while at >= 0:
                word, before = word + padded.count(b" ", before, at), at
                found.append((word, label))
                at = padded.find(phrase, at + 1)
        return found

    def fuzzy(self, text: str) -> list[dict]:
        """Matches of the notices in single-spaced lower-case words."""
        candidates = sorted({(i, end + 1 - reach) for end, uses in self.seeds.iter(text) for i, reach in uses})
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for i, start in candidates:
            notice, slack = self.notices[i], self.notices[i].edits
            # The window reaches from the word before the earliest start to the word after the latest end.
            low = max(0, start - slack)
            low = text.rfind(" ", 0, low) + 1
            high = text.find(" ", start + len(notice.text) + slack)
            m = self.patterns[i].search(text[low : high if high >= 0 else len(text)])
            if m and set(notice.keys) <= set(m[0].split()):
                a, b, edits = low + m.start(), low + m.end(), sum(m.fuzzy_counts)
                found[(i, a)] = min(found.get((i, a), (edits, b)), (edits, b))
        best: dict[tuple[str, int], tuple] = {}
        last, before, word = None, 0, 0
        for (i, a), (edits, b) in sorted(found.items()):
            if i != last:
                last, before, word = i, 0, 0
            word, before = word + text.count(" ", before, a), a
            key = (self.notices[i].label, word)
            if key not in best or edits < best[key][0]:
                best[key] = (edits, text[a:b])
        return [{"label": label, "word": word, "n_words": span.count(" ") + 1, "edits": e, "span": span} for (label, word), (e, span) in sorted(best.items(), key=lambda x: (x[0][1], x[0][0]))]

    def __call__(self, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
        if not words:
            return 0, 0, None, None, [], []
        joined = b" ".join(words)
        base = self.places(b" " + joined + b" ")
        at = [w for w, _ in base]
        matches = self.fuzzy(joined.decode("utf-8", "surrogatepass"))
        return len(words), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}), matches


def scan_licenses(docs: DataFrame, *, notices: Sequence[Notice] = NOTICES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, the exact phrases' places and the fuzzy matches' spans."""
    small_batches(docs.sparkSession)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32()), ("span", pa.string())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "matches"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for batch in batches:
            rows = [scanner(x.as_py()) for x in batch["text"]]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, {COLUMNS}")


def license_digest(scanned: DataFrame) -> DataFrame:
    """One line of plain columns per document; score is 1 for exact phrases, less by the share of edited characters."""
    near = F.array_max(F.transform("matches", lambda m: 1 - m["edits"] / F.greatest(F.length(m["span"]), F.lit(1))))
    labels = F.array_sort(F.array_union("base_labels", F.transform("matches", lambda m: m["label"])))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(near, F.lit(0.0))))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
