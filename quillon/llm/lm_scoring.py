"""LM scoring with a gated recurrent language model.

Tokens are the white-space separated words of a text, A-Z lower-cased, and one end.
A token belongs to a class: each of the HEAD most frequent training tokens to one of
C_HEAD classes of about equal frequency, every other word to a class by its form
(first byte and whether it ends in a punctuation mark). The model's probability of a
token is P(class | state) times, for a head token, a softmax over its class's tokens
given the state, and for another word its add-one share of the class's training
counts, so unseen words have a probability too.

The recurrent part (a gated recurrent unit) is trained in numpy by backpropagation
truncated at windows of WINDOW tokens, in one pass over all tokens of all training
texts, ends too: the pass is cut into ROUNDS rounds, in each of which replicas train
on about REPLICA_TOKENS tokens each and are averaged by tokens, in a tree. Round,
replica and order of a window come from hashes of its document and place, and the
number of replicas from the number of training tokens, so the model does not depend
on how the table is partitioned. The padding of a text's last window has no part in
the loss. Scoring runs over whole texts of all rows, the state carried from window to
window.

Only the DICTIONARY most frequent words go to the workers, a bounded list; the other
words of each text are counted and joined with the word table, and their shares of
the sums are added exactly. Texts are coded once, as two bytes a token; training and
scoring read the codes. A very long text is one row; its codes are held as one array.

Defined cases: null and empty texts are one end token; a null id is held out or not
as the text ''; rows of equal id are scored each on its own; without training rows
c, N and V are 0 and the base score is log10(1) for each token, while the model keeps
its uniform start; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import write_shared
from ._text import mix, small_batches

HEAD, C_HEAD, C_FORM = 768, 24, 16
HIDDEN = 16
DICTIONARY = 1 << 18
WINDOW, BATCH = 32, 256
ROUNDS, RATE = 4, 0.01
#: Training tokens of a replica in a round, and replicas averaged by one task.
REPLICA_TOKENS, FAN_IN = 1 << 20, 64
#: Distinct words that a counting task holds before it passes them on, and tokens scored together.
HOLD, POOL = 400_000, 1 << 22
#: Tokens whose softmaxes are taken at once, so that these stay in the processor's cache.
SLICE = 4096
SEED = 3
_N_IN = HEAD + C_FORM


def tokens(text: bytes | str | None) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def form(word: bytes) -> int:
    """Class of a word by its form, 0 to C_FORM - 1."""
    first = word[0]
    group = 7 if first >= 128 else min(6, (first - 97) * 7 // 26) if 97 <= first <= 122 else 6
    return 2 * group + (not 97 <= word[-1] <= 122 and word[-1] < 128)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, form, c) over all training texts; the end token is the empty word with form -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = list(found)
            forms = [form(w) if w else -1 for w in words]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(forms, pa.int32()), pa.array(list(found.values()), pa.int64())], ["word", "form", "c"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                if not held_out(doc):
                    found.update(tokens(text.as_py()))
                    found[b""] += 1
            if len(found) > HOLD:
                yield out()
                found.clear()
        if found:
            yield out()

    small_batches(docs.sparkSession)
    parts = docs.select("doc_id", "text").mapInArrow(count, "word binary, form int, c long")
    return parts.groupBy("word", "form").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The dictionary's words, with their places, counts and classes, and the form classes' totals."""

    def __init__(self, words: list[bytes], counts: list[int], totals: tuple[int, int], forms: dict[int, tuple[int, int]]):
        self.words = words
        self.counts = np.array(counts, np.float64)
        self.n, self.v = totals
        share = self.counts[:HEAD] / max(1.0, self.counts[:HEAD].sum())
        middle = np.cumsum(share) - share / 2
        self.head_class = np.minimum(C_HEAD - 1, (middle * C_HEAD).astype(np.int64))
        self.bounds = np.searchsorted(self.head_class, np.arange(C_HEAD + 1))
        self.form_n = np.array([forms.get(i, (0, 0))[0] for i in range(C_FORM)], np.float64)
        self.form_v = np.array([forms.get(i, (0, 0))[1] for i in range(C_FORM)], np.float64)
        self.end = words.index(b"") if b"" in words else None

    def start(self) -> dict[str, np.ndarray]:
        """Weights whose probabilities are the training shares, before any training."""
        rng = np.random.RandomState(SEED)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        h, head = HIDDEN, np.zeros(HEAD)
        head[: len(self.counts[:HEAD])] = self.counts[:HEAD]
        mass = np.concatenate((np.bincount(self.head_class, self.counts[:HEAD], C_HEAD) if len(self.head_class) else np.zeros(C_HEAD), self.form_n)) + 0.5
        return {"x": small(_N_IN, 3 * h), "u": small(h, 3 * h), "wc": small(h, C_HEAD + C_FORM), "bc": np.log(mass / mass.sum()).astype(np.float32), "wo": small(HEAD, h), "bo": np.log(head + 0.5).astype(np.float32)}


SHAPES = {"x": (_N_IN, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, C_HEAD + C_FORM), "bc": (C_HEAD + C_FORM,), "wo": (HEAD, HIDDEN), "bo": (HEAD,)}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES]).astype(np.float32)


def unflat(x: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[k] = x[at : at + n].reshape(shape).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, as a hyperbolic tangent, which does not overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _step(u: np.ndarray, gx: np.ndarray, h: np.ndarray) -> tuple:
    """The next states, and what backpropagation needs; a column a text, ``gx`` the inputs' part of the gates."""
    n = HIDDEN
    gh = u.T @ h
    zr = _sigmoid(gx[: 2 * n] + gh[: 2 * n])
    z, r, ghn = zr[:n], zr[n:], gh[2 * n :]
    new = np.tanh(gx[2 * n :] + r * ghn)
    return z * (h - new) + new, z, r, new, ghn


def _log_softmax(w: np.ndarray, h: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over the first axis of ``w @ h + b``."""
    x = w @ h
    x += b[:, None]
    x -= x.max(0)
    x -= np.log(np.exp(x).sum(0))
    return x


def token_log(w: dict, bounds: np.ndarray, head_class: np.ndarray, h: np.ndarray, ids: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log-probabilities of the model's part for tokens ``ids`` given states ``h``, a column each; with ``grads``, gradients too."""
    head = ids < HEAD
    classes = np.where(head, head_class[np.minimum(ids, len(head_class) - 1)] if len(head_class) else 0, C_HEAD + ids - HEAD)
    # The tokens by class, so that each class is one product.
    by = np.argsort(classes.astype(np.int16), kind="stable")
    h, ids, classes = h[:, by], ids[by], classes[by]
    cuts = np.searchsorted(classes, np.arange(C_HEAD + 1))
    log = _log_softmax(w["wc"].T, h, w["bc"])
    rows = np.arange(len(ids))
    out, dh = log[classes, rows], None
    if grads is not None:
        d = np.exp(log, out=log)
        d[classes, rows] -= 1
        grads["wc"] += h @ d.T
        grads["bc"] += d.sum(1)
        dh = w["wc"] @ d
    for c in range(C_HEAD):
        i, j, a, b = cuts[c], cuts[c + 1], bounds[c], bounds[c + 1]
        if i == j or b - a < 2:
            continue
        inner = _log_softmax(w["wo"][a:b], h[:, i:j], w["bo"][a:b])
        at = ids[i:j] - a, rows[: j - i]
        out[i:j] += inner[at]
        if grads is not None:
            d = np.exp(inner, out=inner)
            d[at] -= 1
            grads["wo"][a:b] += d @ h[:, i:j].T
            grads["bo"][a:b] += d.sum(1)
            dh[:, i:j] += w["wo"][a:b].T @ d
    back = np.empty_like(by)
    back[by] = rows
    return out[back], None if dh is None else dh[:, back]


def window_gradients(w: dict, bounds: np.ndarray, head_class: np.ndarray, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict, float, np.ndarray]:
    """Gradients of the mean loss over one window (batch x time), the loss, and the states after it, a column a text.

    Targets of -1, at the end of a row only, are padding: they have no loss, and no gradient comes from behind them.
    """
    n, (b, t) = HIDDEN, targets.shape
    goal, ids = targets.T.ravel(), np.maximum(inputs, 0).T.ravel()
    real = goal >= 0
    size, whole = int(real.sum()), bool(real.all())
    grads = {k: np.zeros_like(w[k]) for k in SHAPES}
    gx, kept, states = w["x"].T[:, ids], [], np.empty((n, t * b), h.dtype)
    for i in range(t):
        nxt, z, r, new, ghn = _step(w["u"], gx[:, i * b : (i + 1) * b], h)
        kept.append((h, z, r, new, ghn))
        states[:, i * b : (i + 1) * b] = h = nxt
    log, dh_real = token_log(w, bounds, head_class, states if whole else states[:, real], goal if whole else goal[real], grads)
    dh_all = dh_real
    if not whole:
        dh_all = np.zeros_like(states)
        dh_all[:, real] = dh_real
    dh, dx, du = np.zeros((n, b), h.dtype), np.empty((3 * n, t * b), h.dtype), np.empty((3 * n, b), h.dtype)
    for i in range(t - 1, -1, -1):
        before, z, r, new, ghn = kept[i]
        dh += dh_all[:, i * b : (i + 1) * b]
        away = 1 - z
        dn = dh * away * (1 - new * new)
        du[:n] = dh * (before - new) * z * away
        du[n : 2 * n] = dn * ghn * r * (1 - r)
        du[2 * n :] = dn * r
        own = dx[:, i * b : (i + 1) * b]
        own[: 2 * n], own[2 * n :] = du[: 2 * n], dn
        grads["u"] += before @ du.T
        dh = dh * z + w["u"] @ du
    grads["x"] += np.stack([np.bincount(ids, row, _N_IN) for row in dx], 1)
    return {k: g / size for k, g in grads.items()}, -float(log.mean()), h


class Adam:
    def __init__(self):
        self.m = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.v = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
        self.t = 0

    def __call__(self, w: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            w[k] -= RATE * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)


def code_texts(docs: DataFrame, shared) -> DataFrame:
    """Each row of ``docs`` coded: ``ids`` are the model's ids of all tokens, ``other`` the words outside the dictionary.

    ``known``, ``base`` and ``inner`` are the dictionary tokens' parts of n_known, the base score and the
    score of words within their form class.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "inner", "ids", "other"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, seen = shared.value, 0
        get, forms, base, inner = v["places"].get, v["forms"], v["base"], v["inner"]
        end = get(b"", -1)
        for batch in batches:
            rows = []
            for text in batch["text"].cast(pa.binary()):
                words = tokens(text.as_py())
                at = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                gaps = np.flatnonzero(at < 0)
                other = [words[i] for i in gaps.tolist()]
                inside = np.append(at[at >= 0], end) if end >= 0 else at[at >= 0]
                ids = np.append(np.where(at >= HEAD, HEAD + forms[at], at), end if end >= 0 else HEAD)
                if other:
                    ids[gaps] = [HEAD + form(x) for x in other]
                score = base[inside].sum() + (0.0 if end >= 0 else v["unseen"])
                rows.append((len(ids), len(inside), score, inner[inside[inside >= HEAD]].sum(), ids.astype("<i2").tobytes(), other))
            part = batch["part"].to_pylist()
            docs_here = batch["doc_id"].to_pylist()
            columns = [pa.array([p * (1 << 33) + seen + i for i, p in enumerate(part)], pa.int64()), batch["doc_id"], pa.array([held_out(d) for d in docs_here])]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            columns += [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            seen += len(rows)
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return rows.mapInArrow(code, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, inner double, ids binary, other array<binary>")


def training_windows(coded: DataFrame, end: int, replicas: int) -> DataFrame:
    """(round, replica, key, ids): two consecutive windows a row, led by the token before them, of the training texts."""
    span = 2 * WINDOW

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                n = len(raw) // 2
                rows = -(-n // span)
                padded = np.full(rows * span + 1, -1, "<i2")
                padded[0], padded[1 : n + 1] = end, np.frombuffer(raw, "<i2")
                own = np.uint64(zlib.crc32(raw, zlib.crc32(str(doc).encode())))
                keys.append(mix((own << np.uint64(32)) + np.arange(rows, dtype=np.uint64)))
                out += [padded[a : a + span + 1].tobytes() for a in range(0, rows * span, span)]
            key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            part = (key >> np.uint64(8)) % np.uint64(replicas)
            yield pa.RecordBatch.from_arrays(
                [pa.array((key % np.uint64(ROUNDS)).astype(np.int32)), pa.array(part.astype(np.int64)), pa.array(key.view(np.int64)), pa.array(out, pa.binary())],
                ["round", "replica", "key", "ids"],
            )

    return coded.where("not held_out").select("doc_id", "ids").mapInArrow(cut, "round int, replica long, key long, ids binary")


def update(w: dict, adam: Adam, bounds: np.ndarray, head_class: np.ndarray, rows: list[bytes]) -> int:
    """Train ``w`` on rows of ``training_windows``; the number of tokens trained on."""
    ids = np.frombuffer(b"".join(rows), np.int16).reshape(len(rows), -1).astype(np.int64)
    h, done = np.zeros((HIDDEN, len(ids)), np.float32), 0
    for a in (0, WINDOW):
        some = ids[:, a + 1] >= 0
        if not some.any():
            break
        ids, h = ids[some], h[:, some]
        targets = ids[:, a + 1 : a + WINDOW + 1]
        grads, _, h = window_gradients(w, bounds, head_class, ids[:, a : a + WINDOW], targets, h)
        adam(w, grads)
        done += int((targets >= 0).sum())
    return done


def _average(parts: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    """(tokens, mean weights) of replicas, weighted by their tokens."""
    n = [p[0] for p in parts]
    return sum(n), np.average([np.frombuffer(p[1], np.float32) for p in parts], axis=0, weights=n)


def train(windows: DataFrame, start: dict[str, np.ndarray], bounds: np.ndarray, head_class: np.ndarray, replicas: int) -> np.ndarray:
    """The flat weights after all rounds over ``windows`` of ``training_windows``."""
    spark = windows.sparkSession
    now = flat(start)

    for turn in range(ROUNDS):
        current = spark.sparkContext.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch], current=current) -> Iterator[pa.RecordBatch]:
            own, held = None, []

            def done() -> pa.RecordBatch:
                nonlocal seen
                if held:
                    seen += update(w, adam, bounds, head_class, held)
                return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([seen], pa.int64()), pa.array([flat(w).tobytes()], pa.binary())], ["replica", "n", "weights"])

            for batch in batches:
                for replica, ids in zip(batch["replica"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                    if replica != own:
                        if own is not None:
                            yield done()
                        own, w, adam, seen, held = replica, unflat(current.value), Adam(), 0, []
                    held.append(ids)
                    if len(held) == BATCH:
                        seen += update(w, adam, bounds, head_class, held)
                        held = []
            if own is not None:
                yield done()

        def merge(parts: pa.Table) -> pa.Table:
            rows = sorted(parts.to_pylist(), key=lambda r: r["replica"])
            n, mean = _average([(r["n"], r["weights"]) for r in rows])
            return pa.table({"replica": pa.array([rows[0]["replica"] // FAN_IN], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

        own = windows.where(F.col("round") == turn).select("replica", "key", "ids")
        own = own.repartitionByRange(replicas, "replica").sortWithinPartitions("replica", "key", "ids")
        parts, left = own.select("replica", "ids").mapInArrow(learn, "replica long, n long, weights binary"), replicas
        while left > FAN_IN:
            parts = parts.groupBy(F.expr(f"replica div {FAN_IN}")).applyInArrow(merge, "replica long, n long, weights binary")
            left = -(-left // FAN_IN)
        rows = parts.collect()  # at most FAN_IN rows of the model's size
        if rows:
            now = _average([(r["n"], r["weights"]) for r in sorted(rows, key=lambda r: r["replica"])])[1].astype(np.float32)
    return now


def text_logs(coded: list[np.ndarray], end: int, bounds: np.ndarray, head_class: np.ndarray, w: dict) -> np.ndarray:
    """The model's natural log-probability of each text, from the model's ids of its tokens."""
    sizes = np.array([len(x) for x in coded], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes, score = sizes[order], np.zeros(len(coded))
    h, last = np.zeros((HIDDEN, len(coded)), np.float32), np.full(len(coded), end, np.int64)
    x, width = np.ascontiguousarray(w["x"].T), int(sizes[0]) if len(sizes) else 0
    for a in range(0, width, WINDOW):
        live = int(np.searchsorted(-sizes, -a, side="left"))
        ids = np.full((WINDOW, live), -1, np.int64)
        for i in range(live):
            part = coded[order[i]][a : a + WINDOW]
            ids[: len(part), i] = part
        states, targets, owners = [], [], []
        for t in range(min(WINDOW, width - a)):
            n = int(np.searchsorted(-sizes[:live], -(a + t), side="left"))
            h = _step(w["u"], x[:, last[:n]], h[:, :n])[0]
            last = ids[t, :n]
            states.append(h)
            targets.append(last)
            owners.append(np.arange(n))
        states, targets = np.concatenate(states, 1), np.concatenate(targets)
        log = [token_log(w, bounds, head_class, states[:, i : i + SLICE], targets[i : i + SLICE])[0] for i in range(0, len(targets), SLICE)]
        score[:live] += np.bincount(np.concatenate(owners), np.concatenate(log), live)
    out = np.zeros(len(coded))
    out[order] = score
    return out


def _dictionary(table: DataFrame) -> pa.Table:
    """(word, form, c) of the DICTIONARY most frequent words, ties by word."""
    levels = table.groupBy("c").agg(F.count("*").alias("n"))  # far fewer rows than words
    upto = F.sum("n").over(Window.orderBy(F.desc("c")))
    least = levels.select("c", upto.alias("upto")).where(F.col("upto") >= DICTIONARY).agg(F.max("c")).first()[0] or 0
    return table.where(F.col("c") >= least).orderBy(F.desc("c"), "word").limit(DICTIONARY).toArrow()


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = write_shared(word_counts(docs), "words")
    by_form = {r["form"]: (r["n"], r["v"]) for r in table.groupBy("form").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}  # C_FORM + 1 rows
    total_n, total_v = sum(n for n, _ in by_form.values()), sum(v for _, v in by_form.values())
    top = _dictionary(table)  # a bounded list
    words = top["word"].to_pylist()
    counts, forms = np.asarray(top["c"], np.float64), np.maximum(0, np.asarray(top["form"], np.int64))
    head_n, head_v = np.bincount(forms[:HEAD], counts[:HEAD], C_FORM), np.bincount(forms[:HEAD], minlength=C_FORM)
    if b"" in words[:HEAD]:  # the end token belongs to no form
        head_n[0], head_v[0] = head_n[0] - counts[words.index(b"")], head_v[0] - 1
    rest = {f: (n - head_n[f], v - head_v[f]) for f, (n, v) in by_form.items() if f >= 0}
    vocabulary = Vocabulary(words, counts.tolist(), (total_n, total_v), rest)
    denominator = total_n + total_v + 1
    inner = np.log10((counts + 1) / (vocabulary.form_n[forms] + vocabulary.form_v[forms] + 1))
    places, one = {x: i for i, x in enumerate(words)}, np.zeros(1)
    shared = spark.sparkContext.broadcast({"places": places, "forms": np.append(forms, 0), "base": np.log10((np.append(counts, one) + 1) / denominator), "inner": np.append(inner, one), "unseen": float(np.log10(1 / denominator))})
    coded = write_shared(code_texts(docs, shared), "coded")
    bounds, head_class = vocabulary.bounds, vocabulary.head_class
    end = places.get(b"", -1)
    end = HEAD if end < 0 else end if end < HEAD else HEAD + int(forms[end])
    weights = flat(vocabulary.start())
    if words:
        replicas = max(1, -(-total_n // (ROUNDS * REPLICA_TOKENS)))
        weights = train(write_shared(training_windows(coded, end, replicas), "windows"), vocabulary.start(), bounds, head_class, replicas)
    model = spark.sparkContext.broadcast(weights)
    names = ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, held, size = unflat(model.value), [], 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            ids = [np.frombuffer(x, "<i2") for x in rows["ids"].to_pylist()]
            total = text_logs(ids, end, bounds, head_class, w) / np.log(10) + np.asarray(rows["inner"])
            return pa.RecordBatch.from_arrays([*(rows[c].combine_chunks() for c in names[:-1]), pa.array(total)], names)

        for batch in batches:
            held.append(batch)
            size += pc.sum(batch["n_tokens"]).as_py() or 0
            if size >= POOL:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    scored = coded.drop("other").mapInArrow(score, f"rid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    others = coded.select("rid", F.explode("other").alias("word")).groupBy("word", "rid").agg(F.count("*").alias("n"))
    found = others.join(table, "word", "left")
    n_form = F.element_at(F.array(*[F.lit(float(a + b + 1)) for a, b in zip(vocabulary.form_n, vocabulary.form_v, strict=True)]), F.col("f") + 1)
    first, last = F.substring("word", 1, 1), F.expr("substring(word, -1, 1)")
    found = found.withColumn("f", F.coalesce("form", _form_column(first, last)))
    seen = F.coalesce("c", F.lit(0))
    sums = found.groupBy("rid").agg(
        F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * F.log10((seen + 1) / F.lit(float(denominator)))).alias("more_base"),
        F.sum(F.col("n") * F.log10((seen + 1) / n_form)).alias("more_score"),
    )
    both = scored.join(sums, "rid", "left")
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(total_n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _form_column(first, last):
    """``form`` of a word as a column, from its first and last byte."""
    code = lambda b: F.conv(F.hex(b), 16, 10).cast("int")
    a, z = code(first), code(last)
    group = F.when(a >= 128, 7).when((a >= 97) & (a <= 122), F.least(F.lit(6), F.floor((a - 97) * 7 / 26).cast("int"))).otherwise(6)
    return (2 * group + F.when(((z < 97) | (z > 122)) & (z < 128), 1).otherwise(0)).cast("int")

