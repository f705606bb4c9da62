import hashlib
import random
import re

from quillon.llm import fill_middle as fm


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc_id, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_equals_brute_force(small, odd, none):
    for docs in (small, odd):
        done = fm.fill_in_middle(docs)
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        want = sorted((brute(*r) for r in rows), key=str)
        assert sorted((tuple(r) for r in done.select("doc_id", *fm.RESULT).collect()), key=str) == want
        texts = sorted(str((d, sha(o[5]), sha(t or ""))) for (d, t), o in ((r, brute(*r)) for r in rows))
        assert sorted(str((r["doc_id"], r["output_sha256"], r["restored_sha256"])) for r in fm.digest(done).collect()) == texts
    assert fm.fill_in_middle(none).count() == 0
    assert fm.fill_in_middle(odd).columns == ["doc_id", "text", "lang", "source", "n_chars", "h", *fm.RESULT]


def test_every_cut_of_any_block_size():
    rng = random.Random(7)
    texts = ["".join(rng.choice(["a", "Zq", " ", "é", "\n", "<", "P>", "字", "😀", "0"]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + ["", "x" * 900, "é" * 700]
    for block in (1, 3, 8, 64, 512):
        tree = fm.BlockTree([t.encode() for t in texts], block)
        base = tree.before(tree.first)
        for i, text in enumerate(texts):
            units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
            assert base[i + 1] - base[i] == len(units)
            import numpy as np

            place, points = tree.locate(base[i] + np.arange(len(units) + 1))
            for u in range(len(units) + 1):
                head = "".join(units[:u])
                assert place[u] - tree.begins[i] == len(head.encode()) and points[u] - points[0] == len(head)


def test_marks_and_halves_of_marks_survive(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<", "<<P", "P>S>M>", "<P <S <M", "a<", "word < P > word <", "<PP><SS>" * 20]
    docs = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    done = fm.fill_in_middle(docs, fim_percent=100, spm_percent=50)
    assert done.where(fm.restore(done["output"], done["form"]) != done["text"]).count() == 0
    assert {r[0] for r in done.select("form").distinct().collect()} == {"plain", "psm", "spm"}
