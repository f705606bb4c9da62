"""Small Arrow helpers for what column expressions cannot say."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, StructField, StructType


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two strings (asymmetric, as the classic matcher is).

    Pairs that the characters in common keep below ``least`` are given that bound; what
    is prepared of ``b`` serves all pairs in a row that have it.
    """
    matcher, last, out = SequenceMatcher(None), None, []
    for x, y, t in zip(a, b, least, strict=True):
        if y != last:
            matcher.set_seq2(y)
            last = y
        matcher.set_seq1(x)
        bound = matcher.quick_ratio()
        out.append(matcher.ratio() if bound >= t else bound)
    return pd.Series(out)


@F.pandas_udf(ArrayType(BooleanType()))
def free_spans(win_start: pd.Series, win_end: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Which of a document's windows to accept, in order: those of which neither end lies in an accepted span."""
    out = []
    for own in zip(win_start, win_end, start, end, strict=True):
        taken, kept = bytearray(int(max(own[1].max(), own[3].max())) + 1), []
        for a, b, s, e in zip(*(x.tolist() for x in own), strict=True):
            free = not (taken[a] or b and taken[b - 1])
            if free:
                taken[s:e] = b"\1" * (e - s)
            kept.append(free)
        out.append(kept)
    return pd.Series(out)


def letters(texts: list[str], width: int) -> np.ndarray:
    """Code points, a row for each text; shorter texts are filled up with 0."""
    return np.array(texts, dtype=f"<U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)


def common_letters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each row of ``a`` and of ``b``, of which fill-ups differ."""
    best = np.zeros((len(a), b.shape[1] + 1), np.int16 if b.shape[1] < 1 << 14 else np.int32)
    for x in a.T:
        # A cell is the best of those to its left, each without or with the letters' match.
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + (b == x[:, None])), axis=1)
    return best[:, -1]


#: Kinds into which letters are folded: for counts, and for masks of places.
COUNTED, MASKED = 32, 64
#: Pairs that are judged at once, few enough for their arrays to stay in the processor's cache.
JUDGED = 1 << 14


def letter_counts(a: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How many letters of each of COUNTED kinds stand in each row of ``a`` where ``own``; folded, so two rows share at least as many as their texts."""
    row, column = np.nonzero(own)
    counts = np.bincount(row * COUNTED + a[row, column] % COUNTED, minlength=len(a) * COUNTED)
    return counts.reshape(-1, COUNTED).astype(np.uint8 if a.shape[1] < 256 else np.int32)


def letter_masks(a: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The places of each of MASKED kinds of letters in each row of ``a`` where ``own``, as bits; rows of up to 64 letters."""
    masks = np.zeros((len(a), MASKED), np.uint64)
    for place in range(min(a.shape[1], 64)):
        row = np.nonzero(own[:, place])[0]
        masks[row, a[row, place] % MASKED] |= np.uint64(1 << place)
    return masks


def common_kinds(a: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """common_letters of each row of ``a`` and the text of its ``masks``, by kinds of letters and so never less; a cell of its table is a bit."""
    flat, base, left = masks.reshape(-1), np.arange(len(a)) * MASKED, np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for x in a.T:
        met = flat[base + x % MASKED] & left
        left = (left + met) | (left - met)
    return np.bitwise_count(~left).astype(np.int64)


class NameLetters:
    """Names as letters, for how many a text has in common with them, in order; it may say too many, never too few."""

    def __init__(self, names: np.ndarray, threshold: float):
        self.names, self.threshold = names, threshold
        self.sizes = np.char.str_len(self.names)
        self.letters = letters(self.names.tolist(), int(self.sizes.max(initial=1)))
        self.own = np.arange(self.letters.shape[1]) < self.sizes[:, None]
        self.letters[~self.own] = 0xFFFFFFFF
        self.masks = letter_masks(self.letters, self.own)

    def needed(self, lp: np.ndarray | int, name: np.ndarray) -> np.ndarray:
        """Letters that a phrase of ``lp`` letters must have in common with each name."""
        return (self.threshold - 1e-9) * (lp + self.sizes[name]) / 2

    def common(self, a: np.ndarray, name: np.ndarray) -> np.ndarray:
        n, long = common_kinds(a, self.masks[name]), self.sizes[name] > 64
        if long.any():
            n[long] = common_letters(a[long], self.letters[name[long]])
        return n


class PartIndex(NameLetters):
    """Names by the parts of phrases that may be close to them; see match.best_fuzzy.

    A pair of equal parts is judged by the letters in common, then by a longest common
    subsequence; both may say too much, never too little.
    """

    def __init__(self, rows: pd.DataFrame, threshold: float):
        names, number = np.unique(rows["name_lc"].to_numpy(str), return_inverse=True)
        super().__init__(names, threshold)
        self.counts = letter_counts(self.letters, self.own)
        self.parts: dict[int, list] = {}
        table = rows.assign(number=number, size=rows["part"].str.len())
        for (lp, at, size), own in table.groupby(["lp", "at", "size"]):
            key = self.hashes(letters(own["part"].tolist(), size)[:, :size])
            order = np.argsort(key, kind="stable")
            self.parts.setdefault(lp, []).append((at, size, key[order], own["number"].to_numpy()[order]))

    @staticmethod
    def hashes(part: np.ndarray) -> np.ndarray:
        h = np.zeros(len(part), np.uint64)
        for x in part.T:
            h = (h + x) * np.uint64(0x9E3779B97F4A7C15)
        return h

    def near(self, phrases: list[str], lp: int) -> tuple[list[str], list[str]]:
        """The phrases (all of ``lp`` letters) and names that share a part and enough letters in order."""
        a, found = letters(phrases, lp), []
        for at, size, keys, numbers in self.parts.get(lp, ()):
            h = self.hashes(a[:, at : at + size])
            low = np.searchsorted(keys, h)
            n = np.searchsorted(keys, h, side="right") - low
            row = np.repeat(np.arange(len(a)), n)
            found.append(row * len(self.names) + numbers[np.arange(len(row)) - np.repeat(np.cumsum(n) - n - low, n)])
        met, counts, close = np.concatenate(found) if found else np.zeros(0, int), letter_counts(a, np.ones(a.shape, bool)), []
        for i in range(0, len(met), JUDGED):
            row, name = np.divmod(met[i : i + JUDGED], len(self.names))
            shared = np.minimum(counts[row], self.counts[name]).sum(1, dtype=np.int64)
            likely = shared >= self.needed(lp, name)
            close.append(met[i : i + JUDGED][likely])
        row, name = np.divmod(np.unique(np.concatenate(close)), len(self.names)) if close else (np.zeros(0, int),) * 2
        likely = np.zeros(len(row), bool)
        for i in range(0, len(row), JUDGED):
            part = slice(i, i + JUDGED)
            likely[part] = self.common(a[row[part]], name[part]) >= self.needed(lp, name[part])
        return [phrases[i] for i in row[likely]], self.names[name[likely]].tolist()


#: Bytes of what is known of words before it is dropped, places of windows that grow together, and tokens that are read at once.
KNOWN_BYTES, GROWN, READ_TOKENS = 1 << 26, 1 << 12, 1 << 18


class WordBounds(NameLetters):
    """Windows of words that may be close to one of few names.

    A phrase has with a name no more letters in common, in order, than its words have
    with it one by one, and a space for each between words of both. So what is known
    of a word serves all windows that it stands in, and a window grows by a sum.
    """

    def __init__(self, names: list[str], threshold: float, band: int | None, most: int, stopwords: Sequence[str]):
        super().__init__(np.array(names, str), threshold)
        ends = np.floor(self.sizes * (2 - threshold) / threshold + 1e-9).astype(int)
        self.most, self.stopwords, self.longest = most, frozenset(stopwords), int((ends if band is None else np.minimum(ends, self.sizes + band)).max())
        self.kind = np.uint8 if self.longest < 250 else np.int32
        lp = np.arange(self.longest + 1)[:, None]
        need = np.ceil(self.needed(lp, np.arange(len(names))[None])).astype(int)
        spaces = np.char.count(self.names, " ")
        far = need > np.minimum(lp, self.sizes)
        if band is not None:
            far |= np.abs(lp - self.sizes) > band
        # Rows are filled up to whole eights, by names that nothing reaches, so that eight comparisons are looked through at once.
        self.width = -(-len(names) // 8) * 8
        fill = lambda x, value: np.concatenate((x, np.full((*x.shape[:-1], self.width - len(names)), value, x.dtype)), -1)
        none = np.iinfo(self.kind).max
        self.need = {m: fill(np.where(far, none, np.maximum(need - np.minimum(m - 1, spaces), 0)).astype(self.kind), none) for m in range(2, most + 1)}
        # The most letters of a phrase that may be left unmatched with each name.
        self.spare, self.long = fill(np.where(far, 0, lp - need).max(0), -1), fill(self.sizes > 64, False)
        self.counts = letter_counts(self.letters, self.own).astype(np.int32)
        # Places of up to 32 letters take half the width, and so half the time.
        self.bits = np.uint32 if self.sizes.max() <= 32 else np.uint64
        self.by_kind = fill(np.concatenate((self.masks.T, np.zeros((1, len(names)), np.uint64))).astype(self.bits), 0)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size, self.stop, self.live, self.bounds = np.zeros(0, int), np.zeros(0, bool), np.zeros(0, bool), np.zeros((0, self.width), self.kind)
        self.held = np.zeros((0, COUNTED), np.int32)

    def learn(self, words: list[str]) -> None:
        size = np.array([len(w) for w in words])
        bounds, live, held = np.zeros((len(words), self.width), self.kind), np.zeros(len(words), bool), np.zeros((len(words), COUNTED), np.int32)
        order = np.argsort(size, kind="stable")
        order = order[size[order] <= self.longest]
        for i in range(0, len(order), 256):
            part = order[i : i + 256]
            a = letters([words[j] for j in part], int(size[part].max()))
            held[part] = letter_counts(a, np.arange(a.shape[1]) < size[part][:, None])
            a = np.where(np.arange(a.shape[1]) < size[part][:, None], a % MASKED, MASKED)
            left = np.full((len(part), self.width), np.iinfo(self.bits).max, self.bits)
            for x in a.T:
                met = self.by_kind[x]
                met &= left
                kept = left - met
                left += met
                left |= kept
            bounds[part] = np.where(self.long, size[part][:, None], np.bitwise_count(~left))
            live[part] = (size[part][:, None] - bounds[part] <= self.spare).any(1)
        for w in words:
            self.known[w] = len(self.known)
        self.size, self.stop = np.concatenate((self.size, size)), np.concatenate((self.stop, [w in self.stopwords for w in words]))
        self.live, self.bounds, self.held = np.concatenate((self.live, live)), np.concatenate((self.bounds, bounds)), np.concatenate((self.held, held))

    def near(self, words: pa.Array, sizes: np.ndarray) -> tuple[list[str], list[str]]:
        """The windows, as phrases, and names that may be close; ``words`` of all documents, of which each has ``sizes``."""
        coded = words.dictionary_encode()
        spelt = coded.dictionary.to_pylist()
        if (len(self.known) + len(spelt)) * self.bounds[:1].nbytes > KNOWN_BYTES:
            self.clear()
        if new := [w for w in spelt if w not in self.known]:
            self.learn(new)
        code = coded.indices.to_numpy(zero_copy_only=False)
        row = np.array([self.known[w] for w in spelt], int)[code]
        size, stop, live, end = self.size[row], self.stop[row], self.live[row], np.repeat(np.cumsum(sizes), sizes)
        # No window with a word that leaves too many letters unmatched with every name is close to one.
        first, found = np.flatnonzero(~stop & live), []
        for i in range(0, len(first), GROWN):
            at = first[i : i + GROWN]
            lp, total = size[at], self.bounds[row[at]]
            for m in range(2, self.most + 1):
                last = at + m - 1
                on = np.flatnonzero(last < end[at])
                on = on[live[last[on]] & (lp[on] + 1 + size[last[on]] <= self.longest)]
                if len(on) < len(at):
                    at, last, lp, total = at[on], last[on], lp[on], total[on]
                lp = lp + 1 + size[last]
                total += self.bounds[row[last]]
                reached = (total >= self.need[m][lp]).reshape(-1, 8)
                eights = np.flatnonzero(reached.view(np.uint64))
                which, place = np.nonzero(reached[eights])
                close, name = np.divmod(eights[which] * 8 + place, self.width)
                judged = ~stop[last[close]]
                close, name = close[judged], name[judged]
                held = self.held[row[at]]
                for k in range(1, m):
                    held += self.held[row[at + k]]
                held[:, ord(" ") % COUNTED] += m - 1
                shared = np.minimum(held[close], self.counts[name]).sum(1)
                likely = shared >= self.needed(lp[close], name)
                found.append((at[close[likely]], np.full(int(likely.sum()), m), name[likely]))
        at, m, name = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        if not len(at):
            return [], []
        window, which = np.unique(at * (self.most + 1) + m, return_inverse=True)
        phrases = [" ".join(spelt[c] for c in code[x // (self.most + 1) : x // (self.most + 1) + x % (self.most + 1)]) for x in window.tolist()]
        phrases, back = np.unique(np.array(phrases), return_inverse=True)
        pairs = np.unique(back[which] * len(self.names) + name)
        text, name = np.divmod(pairs, len(self.names))
        lp, likely = np.char.str_len(phrases), np.zeros(len(text), bool)
        a = letters(phrases.tolist(), int(lp.max()))
        for i in range(0, len(text), JUDGED):
            part = slice(i, i + JUDGED)
            likely[part] = self.common(a[text[part]], name[part]) >= self.needed(lp[text[part]], name[part])
        return phrases[text[likely]].tolist(), self.names[name[likely]].tolist()


def near_windows(words: DataFrame, names: list[str], threshold: float, band: int | None, most: int, stopwords: Sequence[str]) -> DataFrame:
    """(phrase, name_lc): windows of 2 to ``most`` words of ``words(words)``, without stopwords at their ends, and names that may reach the ratio."""
    schema = pa.schema([("phrase", pa.string()), ("name_lc", pa.string())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not names:
            return
        known = WordBounds(names, threshold, band, most, stopwords)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch["words"]), 0).to_numpy(zero_copy_only=False).astype(int)
            flat, done, at = batch["words"].flatten(), 0, 0
            while at < len(sizes):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), READ_TOKENS, side="right")) + at)
                n = int(sizes[at:upto].sum())
                a, b = known.near(flat.slice(done, n), sizes[at:upto])
                done, at = done + n, upto
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)

    return words.select("words").mapInArrow(probe, "phrase string, name_lc string")


def near_pairs(phrases: DataFrame, index: DataFrame, threshold: float) -> DataFrame:
    """(phrase, name_lc) of ``phrases(phrase, lp)`` that may reach the ratio; ``index`` is broadcast and must be of a checked size."""
    shared = phrases.sparkSession.sparkContext.broadcast(index.toPandas())
    kept = [("phrase", pa.string()), ("name_lc", pa.string())]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, rows = PartIndex(shared.value, threshold), [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                rows += batch.num_rows
            if waiting and (batch is None or rows >= 1 << 15):
                table = pa.Table.from_batches(waiting)
                waiting, rows = [], 0
                for lp, own in table.to_pandas().groupby("lp")["phrase"]:
                    a, b = known.near(own.tolist(), lp)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], schema=pa.schema(kept))

    return phrases.select("phrase", "lp").mapInArrow(probe, "phrase string, name_lc string")


#: Tokens whose slot a task remembers.
KNOWN_TOKENS = 1 << 18


def hash_embed(rows: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, embedding): signed hashing of a text's tokens, L2-normalised; zeros without tokens. One row for each row.

    A token's number is the first 32 bits of its MD5; its slot is that modulo
    ``dim``, its sign the number's second-lowest bit. A batch is added up as one array.
    """
    plain = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n", " ")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            tokens = [[t for t in x.split(" ") if t] for x in batch["text"].to_pylist()]
            for t in {t for own in tokens for t in own} - known.keys():
                number = int.from_bytes(hashlib.md5(t.encode()).digest()[:4])
                known[t] = number % dim, 1 - 2 * (number >> 1 & 1)
            row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
            hits = np.array([known[t] for own in tokens for t in own], np.int64).reshape(-1, 2)
            v = np.bincount(row * dim + hits[:, 0], hits[:, 1], len(tokens) * dim).reshape(-1, dim)
            norm = np.sqrt((v * v).sum(1))
            flat = (v / np.where(norm == 0, 1.0, norm)[:, None]).astype(np.float32).reshape(-1)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dim), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch["key"], vectors], [key, "embedding"])
            if len(known) > KNOWN_TOKENS:
                known.clear()

    schema = StructType([rows.select(key).schema[0], StructField("embedding", ArrayType(FloatType()))])
    return rows.select(F.col(key).alias("key"), plain.alias("text")).mapInArrow(embed, schema)


def l2_normalize(vector: Column) -> Column:
    """x / norm(x); zero stays zero. The norm is repeated as an array, so it is summed once."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    scaled = F.zip_with(vector, F.array_repeat(F.nullif(norm, F.lit(0.0)), F.size(vector)), lambda x, n: x.cast("double") / n)
    return F.when(norm == 0, F.transform(vector, lambda x: x.cast("double"))).otherwise(scaled)
