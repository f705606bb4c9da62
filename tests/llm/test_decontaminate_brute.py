"""All pairs of documents and items judged one by one in plain Python."""

import random
from collections import defaultdict

import regex

from quillon.llm import decontaminate as D

SF = "/root/testdata/sf0.001"
MARK = {D.NUM: "numbers", D.NAME: "names"}
NUMBER, NAME = regex.compile(D.NUMBER_RE.replace(r"\d", "[0-9]")), regex.compile(D.NAME_RE.replace(r"\d", "0-9"))
UNIT = regex.compile(D.UNIT_RE.replace(r"\s", "[ \t\n\x0b\f\r]"))


def canonical(text):
    """Words and placeholders, and the values behind the latter."""
    t = regex.sub(f"[{D.MARKS}]", " ", text or "")
    t = regex.sub(D.MONEY_RE.replace(r"\s", "[ \t\n\x0b\f\r]").replace(r"\d", "[0-9]"), f" {D.UNIT} ", t)
    names = [x.lower() for x in NAME.findall(t)]
    t = NAME.sub(f" {D.NAME} ", t)
    numbers = NUMBER.findall(t)
    t = UNIT.sub(f" {D.UNIT} ", NUMBER.sub(D.NUM, t))
    return regex.findall(D.TOKEN_RE, t.lower()), {"numbers": numbers, "names": names}


def one_to_one(a, b):
    pairs = set(zip(a, b, strict=True))
    return len(pairs) == len(set(a)) == len(set(b))


def judge(doc, item, width=8, least=6):
    """(matched, windows, kind), or None."""
    (dw, ds), (iw, own) = doc, item
    if len(iw) < 3:
        return None
    k = min(width, len(iw))
    cut = lambda w: [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
    first = {}
    for at, x in enumerate(cut(iw)):
        first.setdefault(x, at)
    lines, seen = defaultdict(list), set()
    for place, x in enumerate(cut(dw)):
        if x in first:
            lines[place - first[x]].append((place, x))
            seen.add(x)
    if not seen or len(seen) < min(least, len(first)):
        return None
    distinct = {s: len({x for _, x in v}) for s, v in lines.items()}
    kinds = []
    for shift, v in lines.items():
        if distinct[shift] < min(least, len(first), max(distinct.values())):
            continue
        lo, end, fits, same, equal = min(v)[0], max(v)[0] + k, True, True, True
        for mark, field in MARK.items():
            part = lambda w, values, a, b, mark=mark, field=field: values[field][w[:a].count(mark) :][: w[a:b].count(mark)]
            x, y = part(dw, ds, lo, end), part(iw, own, lo - shift, end - shift)
            fits &= len(x) != len(y) or one_to_one(x, y)
            same &= len(x) == len(y)
            equal &= x == y
        if fits:
            kinds.append(2 if not same else 0 if equal else 1)
    return (len(seen), len(first), D.KINDS[min(kinds)]) if kinds else None


def planted(items):
    """Documents that hold items in part, changed, twice, or side by side."""
    rng, out = random.Random(3), []
    for n in range(120):
        text = rng.choice(items)
        words = text.split(" ")
        for _ in range(rng.choice((0, 0, 1, 3))):
            i = rng.randrange(len(words))
            words[i] = rng.choice(("7", "12 km", "Maria", "and", words[i].upper(), words[i] + ","))
        a = rng.randrange(0, max(1, len(words) // 3))
        body = " ".join(words[a : len(words) - rng.randrange(0, max(1, len(words) // 3))])
        out.append((10**6 + n, f"Some words before it. {body} {rng.choice(items) if n % 4 == 0 else ''} and after."))
    return out


def test_pairs_equal_those_of_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    head = "read the following question with care and then answer it in one short sentence as well as you can : "
    shared = [(900 + i, head + t) for i, (_, t) in enumerate(items[:12])] + [(950 + i, f"{head} what is {i} km plus {j} km") for i, j in ((3, 5), (4, 4), (8, 9))]
    items += shared + [(980, "two short words"), (981, "a b"), (982, None), (983, "Then Anna runs 3 km")]
    docs += planted([t for _, t in items if t]) + [(1, "the same id twice, then anna runs 9 km"), (None, head + " what is 5 km plus 3 km")]
    table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = [(d, canonical(t)) for d, t in docs], [(i, canonical(t)) for i, t in items]
    want = {(d, i, *found) for d, x in plain[0] for i, y in plain[1] if (found := judge(x, y))}
    got = [tuple(r) for r in D.contaminated_pairs(*table).select("doc_id", "item_id", "matched", "item_windows", "kind").collect()]
    assert not set(got) ^ want and len(got) == len(want) > 150
    assert {x[4] for x in want} == set(D.KINDS)
