"""Toxicity by classifier chains.

The chain predicts the label columns in turn (by default low quality, then toxic).
Each link is a logistic model over word features and, for all but the first, the
probabilities of the labels before it. A later link is trained with the earlier links'
out-of-fold probabilities, so it learns from the errors that they make on new texts.

Features of a text are those of its lower-cased words, stripped of punctuation: the
word, its first 4 and first 5 characters, and the punctuation that was stripped. A
feature's value is its rate, SCALE * places / (words + SMOOTH), in fitting as in
scoring, so a word that a long text holds by chance weighs little. Which features
count is decided by the number of labelled rows that hold them (the TOP with the
largest chi-square for each label), counted over all labelled rows and added up
within each task before they are shuffled; the weights are fitted on at most SAMPLE
labelled rows, those of smallest hash, as documented here. Only these rows' counts of
the chosen features come to the driver.

Labels meet their documents by a broadcast of up to BROADCAST_LABELS label rows;
more labels are joined by a shuffle, with the same result.

Defined cases: null and empty texts have no features and get the intercepts; very long
texts are scored whole, one row at a time; rows with a null label or without a document
are not trained on; rows equal in id are scored each on its own; with no labelled rows
at all every probability is 0 and nothing is rejected; extra columns are passed through,
but for columns of the result's own names, which are replaced. Ties of chi-square are
broken by the feature, ties of hashes by the labels and counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if, write_shared
from ._text import small_batches

#: Labelled rows that the weights are fitted on.
SAMPLE = 8000
#: Features of each label.
TOP = 1000
FOLDS, ROUNDS, L2, LEAST = 5, 60, 0.3, 3
SCALE, SMOOTH = 100.0, 30
#: Words a task remembers, and features it counts before it passes their counts on.
CACHE, HOLD = 1 << 18, 400_000
#: Label rows (an id and the labels) that may be broadcast.
BROADCAST_LABELS = 1 << 20
_EDGE, _WORD = re.compile(r"^(\W*)(.*?)(\W*)$", re.S), re.compile(r"\w+")


def word_features(word: str) -> list[str]:
    """The features of one white-space separated, lower-cased word."""
    if word.isalpha():
        body, mark = word, ""
    elif word[:-1].isalpha():
        body, mark = (word, "") if word[-1].isalnum() or word[-1] == "_" else (word[:-1], word[-1])
    else:
        body, mark = _EDGE.match(word)[2], _WORD.sub("", word)
    out = []
    if body:
        out = [f"w:{body}"] + [f"{n}:{body[:n]}" for n in (4, 5) if len(body) > n]
    return [*out, f"p:{mark[:4]}"] if mark else out


def text_words(text: str | None) -> Counter[str]:
    return Counter((text or "").lower().split())


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Chain:
    """Fitted links: names of the labels, features, a weight row for each, intercepts and chain weights."""

    labels: list[str]
    index: dict[str, int]
    weights: np.ndarray  # features x labels
    intercept: np.ndarray
    links: np.ndarray  # labels x labels, below the diagonal

    def probabilities(self, sums: np.ndarray) -> np.ndarray:
        """From each row's summed weights of all labels."""
        out = np.zeros_like(sums)
        for j in range(sums.shape[1]):
            out[:, j] = _chance(sums[:, j] + self.intercept[j] + out[:, :j] @ self.links[j, :j])
        return out


class _WordRows(dict):
    """Words to rows of ``table``, their summed weights; row 0 is that of words without features."""

    def __init__(self, chain: Chain):
        super().__init__()
        self.chain = chain
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.rows, self.used = {(): 0}, 1
        self.table = np.zeros((1024, self.chain.weights.shape[1]))

    def __missing__(self, word: str) -> int:
        ids = tuple(i for f in word_features(word) if (i := self.chain.index.get(f)) is not None)
        row = self.rows.get(ids)
        if row is None:
            row, self.used = self.used, self.used + 1
            if row == len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[row] = self.chain.weights[list(ids)].sum(0)
            self.rows[ids] = row
        if len(word) <= 64:
            self[word] = row
        return row

    def sums(self, text: str | None) -> np.ndarray:
        """The text's features' rates times their weights, for each label."""
        if len(self) >= CACHE:
            self.forget()
        words = text_words(text)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        places = np.fromiter(words.values(), np.float64, len(words))
        return places @ self.table[rows] * (SCALE / (places.sum() + SMOOTH))


@dataclass
class Rows:
    """Sparse feature values, row after row."""

    indptr: np.ndarray
    indices: np.ndarray
    values: np.ndarray

    def keep(self, which: np.ndarray) -> Rows:
        sizes = np.diff(self.indptr)
        entries = np.repeat(which, sizes)
        return Rows(np.concatenate(([0], np.cumsum(sizes[which]))), self.indices[entries], self.values[entries])

    def dot(self, w: np.ndarray) -> np.ndarray:
        n = len(self.indptr) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.indptr)), w[self.indices] * self.values, n)


def _fit(x: Rows, extra: np.ndarray, y: np.ndarray, n_features: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(weights, intercept, weights of extra) of an L2 logistic model, by full-batch Adam."""
    n, m = len(y), n_features + 1 + extra.shape[1]
    owner = np.repeat(np.arange(n), np.diff(x.indptr))
    w, g1, g2 = np.zeros(m), np.zeros(m), np.zeros(m)
    if 0 < y.mean() < 1:
        w[n_features] = np.log(y.mean() / (1 - y.mean()))
    for t in range(1, ROUNDS * 5 + 1):
        z = np.bincount(owner, w[x.indices] * x.values, n) + w[n_features] + extra @ w[n_features + 1 :]
        d = _chance(z) - y
        g = np.concatenate((np.bincount(x.indices, d[owner] * x.values, n_features), [d.sum()], extra.T @ d)) / n
        g[:n_features] += L2 * w[:n_features] / n
        g1, g2 = 0.9 * g1 + 0.1 * g, 0.99 * g2 + 0.01 * g * g
        w -= 0.1 * (g1 / (1 - 0.9**t)) / (np.sqrt(g2 / (1 - 0.99**t)) + 1e-8)
    return w[:n_features], float(w[n_features]), w[n_features + 1 :]


def fit_chain(x: Rows, y: np.ndarray, labels: Sequence[str], index: dict[str, int]) -> Chain:
    """Fit the links in turn; folds are by row number."""
    n, k = y.shape
    fold = np.arange(n) % FOLDS
    weights, intercept, links = np.zeros((len(index), k)), np.zeros(k), np.zeros((k, k))
    before = np.zeros((n, 0))  # out-of-fold probabilities of the links so far
    for j in range(k):
        weights[:, j], intercept[j], links[j, :j] = _fit(x, before, y[:, j], len(index))
        if j + 1 < k:
            out = np.zeros(n)
            for f in range(min(FOLDS, n)):
                train, test = fold != f, fold == f
                if train.any():
                    w, b, e = _fit(x.keep(train), before[train], y[train, j], len(index))
                    out[test] = _chance(x.keep(test).dot(w) + b + before[test] @ e)
            before = np.column_stack((before, out))
    return Chain(list(labels), index, weights, intercept, links)


class _Features(dict):
    """Words to their features, remembered."""

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= CACHE:
            self.clear()
        out = word_features(word)
        if len(word) <= 64:
            self[word] = out
        return out


def feature_counts(known: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(feature, n, targets..): texts of ``known(text, targets..)`` that hold each feature, and those of each label.

    The empty feature stands for all texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, found = _Features().__getitem__, {}

        def out() -> Iterator[pa.RecordBatch]:
            for key, own in found.items():
                columns = [pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([v] * len(own), pa.int32()) for v in key]], ["feature", "n", *targets])
            found.clear()

        for batch in batches:
            for *key, text in zip(*(batch[c].to_pylist() for c in targets), batch["text"], strict=True):
                own = found.setdefault(tuple(key), Counter())
                own.update({""}.union(*map(of, set((text.as_py() or "").lower().split()))))
            if sum(map(len, found.values())) > HOLD:
                yield from out()
        yield from out()

    kinds = "".join(f", {c} int" for c in targets)
    parts = known.select("text", *targets).mapInArrow(count, f"feature string, n long{kinds}")
    return parts.groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in targets])


def feature_rows(known: DataFrame, keep: Sequence[str], index: dict[str, int]) -> DataFrame:
    """``known(keep.., text)`` with each text's words, and the ids of its features of ``index`` with their places."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Features()
        for batch in batches:
            ids, places, sizes = [], [], []
            for text in batch["text"]:
                own, words = Counter(), text_words(text.as_py())
                for word, k in words.items():
                    for f in of[word]:
                        if f in index:
                            own[index[f]] += k
                ids.append(sorted(own))
                places.append([own[i] for i in ids[-1]])
                sizes.append(words.total())
            made = [pa.array(sizes, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *made], [*keep, "words", "ids", "places"])

    kinds = ", ".join(f"{c} {known.schema[c].dataType.simpleString()}" for c in keep)
    return known.select(*keep, "text").mapInArrow(rows, f"{kinds}, words long, ids array<int>, places array<long>")


def train_chain(docs: DataFrame, labels: DataFrame, targets: Sequence[str], *, sample: int = SAMPLE, top: int = TOP) -> Chain | None:
    """Fit a chain for 0/1 columns ``targets`` of ``labels(doc_id, ..)``; None without labelled documents."""
    small_batches(docs.sparkSession)
    clean = labels.dropna(subset=["doc_id", *targets]).select("doc_id", *[F.col(c).cast("int").alias(c) for c in targets])
    texts = docs.select("doc_id", "text")
    known = texts.join(broadcast_if(clean, BROADCAST_LABELS), "doc_id")
    counts = write_shared(feature_counts(known, targets).where((F.col("n") >= LEAST) | (F.col("feature") == "")), "feature-counts")
    total = counts.where("feature = ''").first()
    if not total:
        return None
    chosen = set()
    for c in targets:
        p, n = F.lit(total[c] / total["n"]), F.col("n")
        gap = F.abs(F.col(c) - n * p)
        chi = gap * gap / (n * p * (1 - p) + 1e-9)
        chosen |= {r["feature"] for r in counts.where("feature <> ''").orderBy(chi.desc(), "feature").limit(top).select("feature").collect()}
    index = {f: i for i, f in enumerate(sorted(chosen))}
    order = F.xxhash64("doc_id", F.lit(9))
    # The last hash that can be among the first `sample` is found on ids alone, so that few texts are read closely.
    ids = docs.select("doc_id").join(broadcast_if(clean.select("doc_id"), BROADCAST_LABELS), "doc_id")
    last = ids.select(order.alias("o")).orderBy("o").limit(sample).agg(F.max("o")).first()[0]
    near = texts.where(order <= F.lit(last)).join(broadcast_if(clean.where(order <= F.lit(last)), BROADCAST_LABELS), "doc_id")
    rows = feature_rows(near.withColumn("o", order), ["o", *targets], index)
    got = rows.orderBy("o", *targets, "ids", "places", "words").limit(sample).toArrow().combine_chunks()
    column = lambda c: np.asarray(got[c], np.float64)
    flat = lambda c: np.asarray(pc.list_flatten(got[c]), np.int64)
    sizes = np.asarray(pc.list_value_length(got["ids"]), np.int64)
    values = SCALE * flat("places") / np.repeat(column("words") + SMOOTH, sizes)
    x = Rows(np.concatenate(([0], np.cumsum(sizes))), flat("ids"), values)
    return fit_chain(x, np.column_stack([column(c) for c in targets]), targets, index)


def score_chain(docs: DataFrame, chain: Chain | None, targets: Sequence[str]) -> DataFrame:
    """``docs`` with a probability ``p_<label>`` for each link of the chain."""
    made = [f"p_{c}" for c in targets]
    docs = docs.drop(*made)
    if chain is None:
        return docs.select("*", *[F.lit(0.0).alias(c) for c in made])
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(chain)  # at most TOP features a label

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _WordRows(shared.value)
        for texts in batches:
            sums = np.array([known.sums(x.as_py()) for x in texts]).reshape(-1, len(made))
            p = shared.value.probabilities(sums)
            yield pa.StructArray.from_arrays([pa.array(p[:, j]) for j in range(len(made))], names=made)

    found = F.arrow_udf(score, "struct<" + ", ".join(f"{c} double" for c in made) + ">")
    out = docs.withColumn("__p", found("text"))
    return out.select(*docs.columns, *[F.col("__p")[c].alias(c) for c in made])


def toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and ``rejected``.

    ``labels(doc_id, quality, toxic)`` are 0/1; the chain is low quality, then toxic.
    """
    targets = ["low_quality", "toxic"]
    own = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    docs = docs.drop("rejected")
    scored = score_chain(docs, train_chain(docs, own, targets, **options), targets)
    return scored.withColumn("rejected", F.col("p_toxic") >= threshold)
