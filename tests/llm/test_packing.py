"""Operator 10: every id in exactly one piece, sequences without gaps, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import packing, queries
from lattica.llm.tokens import byte_tokenizer, vocabulary_path

from .helpers import ODD, SF, clashing, documents, empty, odd
from .test_bpe import TRICKY

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


def test_ids_as_the_library(library):
    texts = [*TRICKY, *(t or "" for _, t, *_ in ODD), "a  b   c\n\n d\t e ", " lead", "trail ", "it's  We'll x"]
    texts += ["a" + chr(c) + "b " + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    coder = byte_tokenizer(PATH)
    for t in texts:
        assert coder.encode(t) == ids_of(library, t).tobytes() and coder.count(t) == len(ids_of(library, t))


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 1024])
def test_cuts_fill_the_document(capacity):
    for n in range(1, 3 * capacity + 5):
        pieces = packing.cut(n, capacity)
        assert sum(pieces) == n and all(0 < p <= capacity for p in pieces)


def check(pieces, capacity):
    """Sequences hold their pieces gaplessly."""
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    fill = []
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        fill.append(at)
    return fill


def test_whole_table(spark, library):
    pieces = queries.op10_harmonic_packing(spark, SF).collect()
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    rows = documents(spark).collect()
    assert len(by_doc) == len(rows)
    for r in rows:
        ids, at = np.append(ids_of(library, r.text), np.uint32(0)).astype("<u4"), 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    fill = check(pieces, 1024)
    assert sum(fill) > 0.97 * 1024 * len(fill)


def test_classes_hold_a_fixed_count():
    packer, out = packing.Packer(100), []
    for i, n in enumerate([50, 34, 50, 33, 33, 33, 25, 26, 100]):
        out.append([x[0] for x in packer.add(n, i)])
    assert out == [[], [0, 1], [], [], [], [3, 4, 5], [], [], [8]]  # of (33, 50] two, of (25, 33] three
    assert sorted(p for p, _, _ in packer.finish()) == [2, 6, 7]


def test_defined_cases(spark, library):
    pieces = packing.pack(clashing(odd(spark)), PATH, capacity=64).collect()
    check(pieces, 64)
    assert sum(p.length for p in pieces) == sum(len(ids_of(library, t)) + 1 for _, t, *_ in ODD)
    assert [(p.start, p.length, bytes(p.ids)) for p in pieces if p.doc_id == 1] == [(0, 1, bytes(4))]
    assert sum(p.doc_id == 4 for p in pieces) == 2 * len(packing.cut(len(ids_of(library, "one")) + 1, 64))
    assert packing.pack(empty(spark), PATH).count() == 0
