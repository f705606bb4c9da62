import json
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillon.llm import token_files
from quillon.llm.queries import tokenizer_path


@given(st.lists(st.integers(0, 2**31 - 1), max_size=2000))
@settings(max_examples=50, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    levels = token_files.dac_encode(np.array(ids, np.uint32))
    assert token_files.dac_decode(levels).tolist() == ids
    assert all(token_files.dac_get(levels, i) == ids[i] for i in range(0, len(ids), 7))


FRESH = Tokenizer.from_file(tokenizer_path())


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,a1éß\u00a0\u3000"), st.characters(codec="utf-8")), max_size=200))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    want = FRESH.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_files.encoder(tokenizer_path())(text), "<u4").tolist() == want


def test_added_tokens_are_coded_as_the_library_does():
    texts = ["plain words", "a <|endoftext|> b", "<|endoftext|>", "", "no <|end of it"]
    got = [np.frombuffer(x, "<u4").tolist() for x in token_files.encoder(tokenizer_path()).batch(texts)]
    assert got == [FRESH.encode(x, add_special_tokens=False).ids for x in texts] and 50256 in got[1]


def test_tokenizers_of_another_build_code_whole_texts(tmp_path):
    spec = json.loads(FRESH.to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    want = Tokenizer.from_file(str(path)).encode("one two, three", add_special_tokens=False).ids
    assert np.frombuffer(token_files.encoder(str(path))("one two, three"), "<u4").tolist() == want


def brute(rows):
    code, start, out = FRESH, 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = code.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_digest_equals_brute_force(small, odd, none, monkeypatch):
    for docs in (small, odd):
        rows = [(r[0], r[1]) for r in docs.select("doc_id", "text").collect()]
        got = token_files.tokenize_to_files(docs, tokenizer_path()).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)
    assert token_files.tokenize_to_files(none, tokenizer_path()).count() == 0
