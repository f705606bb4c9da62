import re

from quillon.llm import license_scan


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(small, odd, none):
    for docs in (small, odd):
        rows = docs.select("doc_id", "text").collect()
        got = license_scan.license_digest(license_scan.scan_licenses(docs)).collect()
        want = sorted((str(r[0]), *map(str, brute(r[1]))) for r in rows)
        assert sorted(tuple(map(str, r[:6])) for r in got) == want
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert license_scan.scan_licenses(none).count() == 0


def test_bounded_errors_and_spans():
    scan = license_scan.Scanner(license_scan.NOTICES, license_scan.PHRASES)
    found = scan("Some text. This work is licenced under the Apache Licence, Version 2.0.")[5]
    assert [(m["label"], m["word"]) for m in found] == [("apache-2", 5)] and found[0]["edits"] > 0
    assert scan("licensed under the bsd license")[5][0]["label"] == "bsd"
    assert {m["label"] for m in scan("GNU General Public Lisense, version 3")[5]} == {"gpl-3"}
    assert scan("licensed under nothing that anyone has heard of")[5] == []
    assert scan("an all rights reserved")[5][0]["span"] == "all rights reserved"


def test_word_numbers_of_many_places():
    scan = license_scan.Scanner(license_scan.NOTICES, license_scan.PHRASES)
    n_words, n_base, first, last, labels, matches = scan("it is licensed under the MIT License here " * 2000)
    assert (n_words, n_base, first, last, labels) == (16000, 2000, 3, 15995, ["mit"])
    assert [m["word"] for m in matches] == [8 * i + 2 for i in range(2000)]
