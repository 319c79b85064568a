"""Operator 2 against the tokenizers library."""

import hashlib
import json

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import bpe, queries
from lattica.llm.tokens import vocabulary_path

from .helpers import ODD, SF, clashing, documents, empty, odd

PATH = vocabulary_path("word_bpe_49k.json")
TRICKY = [
    "aaaaaaaaaaaaaaaaaaaaaaaaa bbbbb abababababa",
    "don't CAN'T we'll I'd they've 're 's'",
    "<|startoftext|>hello<|endoftext|> <|ENDOFTEXT|> <|endoftext|",
    "3.14159 12½ ٣٤ Ⅷ x²",
    "İIıi ẞß ﬁ é é Å ​‍﻿",
    "a b c\x85d\x1ce\x00f\x7f 　   ᠎",
    "你好世界 こん 한국 ไทย क्ष \U0001f468‍\U0001f469‍\U0001f467 \U0001f1e9\U0001f1ea",
    "__a_b__ --- ... !!?? #tag @me https://x.y/z?q=1&r=2",
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return np.array(ids, dtype="<u4").tobytes(), library.decode(ids, skip_special_tokens=False)


def test_as_the_library(library):
    texts = [*TRICKY, *(t or "" for _, t, *_ in ODD)]
    assert bpe.word_bpe(PATH).encode_batch(texts) == [expected(library, t) for t in texts]


def test_every_character_class(library):
    texts = ["a" + chr(c) + "b " + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    assert bpe.word_bpe(PATH).encode_batch(texts) == [expected(library, t) for t in texts]


def test_whole_table(spark, library):
    found = {r.doc_id: r for r in queries.op2_bpe_roundtrip(spark, SF).collect()}
    rows = documents(spark).collect()
    assert len(found) == len(rows)
    for r in rows:
        ids, decoded = expected(library, r.text)
        out = found[r.doc_id]
        assert (out.n_tokens, out.ids_sha256, out.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_defined_cases(spark, library):
    got = bpe.encode_decode(clashing(odd(spark)), PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    want = sorted((repr(i), *expected(library, t)) for i, t, *_ in ODD)
    assert sorted((repr(r.doc_id), bytes(r.ids), r.decoded) for r in got.collect()) == want
    assert bpe.encode_decode(empty(spark), PATH).count() == 0


def test_a_small_memo_changes_nothing(library):
    coder = bpe.WordBpe(PATH)
    coder.memo_limit = 3
    texts = [json.dumps({"a": i, "b": [i] * 3}) + " word" * i for i in range(30)]
    assert [x for t in texts for x in coder.encode_batch([t])] == [expected(library, t) for t in texts]
