import numpy as np
from pyspark.sql import functions as F

from quillon.llm import lm_scoring as lm

TEXTS = ["a b c", "b a", "", " ".join("abc"[i * i % 3] for i in range(32)), " ".join("ab"[i % 2] for i in range(200))]


def vocabulary():
    return lm.Vocabulary([b"a", b"b", b"c", b""], [120, 110, 30, 5], (265, 4), {})


def coded(spark, rows):
    v = vocabulary()
    known = {"places": {x: i for i, x in enumerate(v.words)}, "forms": np.zeros(5, np.int64), "base": np.zeros(5), "inner": np.zeros(5), "unseen": 0.0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return lm.code_texts(docs, spark.sparkContext.broadcast(known))


def random_weights(rng, kind=np.float64):
    return {k: rng.standard_normal(s).astype(kind) * 0.5 for k, s in lm.SHAPES.items()}


def test_every_training_token_is_trained_on_in_one_round(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 20)]
    v = vocabulary()
    windows = lm.training_windows(coded(spark, rows), 3, 2).collect()
    assert {r["round"] for r in windows} == set(range(lm.ROUNDS)) and {r["replica"] for r in windows} == {0, 1}
    w = lm.unflat(lm.flat(v.start()))
    done = lm.update(w, lm.Adam(), v.bounds, v.head_class, [bytes(r["ids"]) for r in windows])
    assert done == sum(len(lm.tokens(t)) + 1 for i, t in rows if not lm.held_out(i))


def test_short_texts_and_their_ends_train():
    v = vocabulary()
    row = np.full(2 * lm.WINDOW + 1, -1, np.int16)
    row[:4] = 3, 0, 1, 3
    w, adam = lm.unflat(lm.flat(v.start())), lm.Adam()
    score = lambda: lm.text_logs([np.array([0, 1, 3])], 3, v.bounds, v.head_class, w)[0]
    before = score()
    for _ in range(50):
        assert lm.update(w, adam, v.bounds, v.head_class, [row.tobytes()] * 4) == 12
    assert score() > before + 1


def test_padding_has_no_gradient():
    v, rng = vocabulary(), np.random.RandomState(1)
    w = {k: x.astype(np.float64) for k, x in v.start().items()}
    ids = rng.randint(0, 4, (2, 6))
    cut = ids.copy()
    cut[1, 4:] = -1
    h = np.zeros((lm.HIDDEN, 2))
    whole, _, _ = lm.window_gradients(w, v.bounds, v.head_class, ids[:1, :-1], ids[:1, 1:], h[:, :1])
    part, _, _ = lm.window_gradients(w, v.bounds, v.head_class, ids[1:, :3], ids[1:, 1:4], h[:, :1])
    both, _, _ = lm.window_gradients(w, v.bounds, v.head_class, cut[:, :-1], cut[:, 1:], h)
    for k in both:
        np.testing.assert_allclose(both[k], (5 * whole[k] + 3 * part[k]) / 8, atol=1e-5)


def test_gradients_equal_finite_differences():
    v, rng = vocabulary(), np.random.RandomState(2)
    w = random_weights(rng)
    ids, h = rng.choice([0, 1, 2, 3, lm.HEAD, lm.HEAD + 5], (3, 8)), rng.standard_normal((lm.HIDDEN, 3)) * 0.1
    loss = lambda: lm.window_gradients(w, v.bounds, v.head_class, ids[:, :-1], ids[:, 1:], h)[1]
    grads = lm.window_gradients(w, v.bounds, v.head_class, ids[:, :-1], ids[:, 1:], h)[0]
    for k, shape in lm.SHAPES.items():
        live = np.flatnonzero(grads[k])
        for at in [*rng.choice(live, min(6, len(live)), replace=False), 0]:
            place, step = np.unravel_index(at, shape), 1e-5
            w[k][place] += step
            up = loss()
            w[k][place] -= 2 * step
            down = loss()
            w[k][place] += step
            assert abs((up - down) / (2 * step) - grads[k][place]) < 1e-6


def naive_log(ids, end, v, w):
    """Token by token, with the whole softmaxes written out."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    h, last, out, n = np.zeros(lm.HIDDEN), end, 0.0, lm.HIDDEN
    for i in ids:
        x, u = w["x"][last], h @ w["u"]
        z, r = sig(x[:n] + u[:n]), sig(x[n : 2 * n] + u[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :])
        own = np.exp(h @ w["wc"] + w["bc"])
        c = v.head_class[i] if i < lm.HEAD else lm.C_HEAD + i - lm.HEAD
        out += np.log(own[c] / own.sum())
        if i < lm.HEAD:
            members = np.flatnonzero(v.head_class == c)
            inner = np.exp(w["wo"][members] @ h + w["bo"][members])
            out += np.log(inner[members == i][0] / inner.sum())
        last = i
    return out


def test_scores_of_whole_texts_equal_brute_force():
    v, rng = vocabulary(), np.random.RandomState(3)
    w = random_weights(rng)
    texts = [rng.choice([0, 1, 2, 3, lm.HEAD + 2], n) for n in (1, 5, 31, 32, 33, 100, 64)]
    got = lm.text_logs(texts, 3, v.bounds, v.head_class, w)
    np.testing.assert_allclose(got, [naive_log(t, 3, v, w) for t in texts], rtol=1e-5)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one = lm.lm_scores(docs.repartition(1)).select("doc_id", "score")
    many = lm.lm_scores(docs.repartition(7, "text")).select("doc_id", F.col("score").alias("again"))
    assert one.join(many, "doc_id").where("abs(score - again) > 1e-6 * abs(score)").count() == 0


def test_replicas_are_averaged_in_a_tree(spark, monkeypatch):
    v = vocabulary()
    windows = lm.training_windows(coded(spark, list(enumerate(TEXTS * 20))), 3, 9).cache()
    flat = lm.train(windows, v.start(), v.bounds, v.head_class, 9)
    monkeypatch.setattr(lm, "FAN_IN", 2)
    np.testing.assert_allclose(lm.train(windows, v.start(), v.bounds, v.head_class, 9), flat, atol=1e-5)
