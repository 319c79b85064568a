"""Operator 3: the permutation, and an exact round trip through the files."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from lattica.llm import queries, tokenfiles
from lattica.llm.tokens import vocabulary_path

from .helpers import SF, clashing, documents, empty, frame, odd

PATH = vocabulary_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutation(n):
    slots = tokenfiles.feistel(np.arange(n), n, "key")
    assert sorted(slots.tolist()) == list(range(n))
    if n > 100:
        assert (slots != tokenfiles.feistel(np.arange(n), n, "other")).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.2


def stream_of(docs, end):
    library = Tokenizer.from_file(PATH)
    ids = []
    for r in docs.select("text").collect():
        ids += [*library.encode(r.text or "", add_special_tokens=False).ids, end]
    return ids


def restored(files, layout):
    rows = {r.slot: r for r in tokenfiles.read_token_files(files, layout, slots_at_once=7).collect()}
    n = layout["sequences"]
    assert sorted(rows) == list(range(n))
    assert all(r.shard == s // layout["per_shard"] for s, r in rows.items())
    slots = tokenfiles.feistel(np.arange(n), n, layout["key"]) if n else []
    return np.concatenate([np.frombuffer(bytes(rows[int(s)].ids), dtype=f"<u{layout['width']}") for s in slots]).tolist() if n else []


@pytest.mark.parametrize(("length", "per_shard"), [(1024, 16384), (64, 10), (3, 1000)])
def test_round_trip(spark, length, per_shard):
    docs = documents(spark).limit(60).coalesce(1)
    files, layout = tokenfiles.write_token_files(docs.repartition(3, "doc_id") if length == 64 else docs, PATH, length=length, per_shard=per_shard)
    got = restored(files, layout)
    want = stream_of(docs.repartition(3, "doc_id") if length == 64 else docs, 50256)
    assert layout["tokens"] == len(want) and layout["sequences"] == -(-len(want) // length)
    assert got[: len(want)] == want and not any(got[len(want) :])


def test_resume_by_arithmetic(spark):
    files, layout = tokenfiles.write_token_files(documents(spark).coalesce(1), PATH, length=128, per_shard=50)
    rows = {r.slot: bytes(r.ids) for r in tokenfiles.read_token_files(files, layout).collect()}
    for r in files.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            data = f.read()
        assert len(data) == r.n_slots * layout["stride"]
        slot = r.first_slot + r.n_slots - 1
        assert data[(slot % 50) * layout["stride"] :][: layout["stride"]] == rows[slot]


def test_defined_cases(spark):
    docs = clashing(odd(spark)).coalesce(1)
    files, layout = tokenfiles.write_token_files(docs, PATH, length=100, per_shard=8)
    want = stream_of(docs, 50256)
    assert restored(files, layout)[: len(want)] == want
    files, layout = tokenfiles.write_token_files(empty(spark), PATH)
    assert layout["sequences"] == 0 and files.count() == 0 and tokenfiles.read_token_files(files, layout).count() == 0
    files, layout = tokenfiles.write_token_files(frame(spark, [(1, None)]), PATH)
    assert (layout["tokens"], layout["sequences"], files.count()) == (1, 1, 1)


def test_the_query_covers_the_table(spark):
    out = queries.op3_token_files(spark, SF)
    assert out.columns == ["slot", "shard", "ids_crc32"]
    slots = sorted(r.slot for r in out.collect())
    assert slots == list(range(-(-len(stream_of(documents(spark), 50256)) // 1024)))
