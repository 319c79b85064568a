"""Operator 1 against all pairs: links by a full edit-distance table, classes by union-find."""

import random

import numpy as np
import pytest

from lattica.llm import neardup
from lattica.llm.neardup import edit_distance, kmers, similar, word_hashes

from .helpers import SF, clashing, documents, empty, frame, odd


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def test_banded_distance_is_exact():
    rng = random.Random(5)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        b = list(a) if rng.random() < 0.6 else [rng.randrange(4) for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
        most = rng.randrange(0, 12)
        assert edit_distance(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64), most) == min(plain_distance(a, b), most + 1)


def test_occurrences_and_order_count():
    a, b = kmers(word_hashes("a b c d e f g")), kmers(word_hashes("A, b; c d. e (f) G"))
    assert (a == b).all()
    again = kmers(word_hashes("x x x x x x x x"))
    assert len(set(neardup.label_occurrences(again).tolist())) == len(again)
    assert not (neardup.order_minhash(a, 8, 3) == neardup.order_minhash(a[::-1].copy(), 8, 3)).all()


def brute_classes(rows, similarity=0.8):
    codes = [kmers(word_hashes(t or "")) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(codes[i]) and len(codes[j]) and similar(codes[i], codes[j], similarity):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i) if len(codes[i]) else ("bare", i), []).append(rows[i][0])
    return sorted(sorted(g) for g in groups.values())


def found_classes(result):
    groups = {}
    for r in result.collect():
        groups.setdefault(r.class_id, []).append(r.doc_id)
    return sorted(sorted(g) for g in groups.values())


def test_all_pairs_of_the_small_table(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found_classes(neardup.near_duplicates(docs)) == brute_classes(rows)


@pytest.fixture(scope="module")
def planted():
    """Groups of near copies, chains of them, and unlike texts that share long passages."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, passage = [], [word() for _ in range(70)]
    for g in range(12):
        base = [word() for _ in range(rng.randrange(60, 300))]
        rows += [" ".join(base)] * 2
        for _ in range(rng.randrange(1, 8)):
            copy = list(base)
            for _ in range(rng.randrange(1, max(2, len(base) // 70))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        if g % 3 == 0:  # a chain, each link near the one before it
            for _ in range(5):
                base = [word() if rng.random() < 0.02 else w for w in base]
                rows.append(" ".join(base))
    rows += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)]) for _ in range(40)]
    return list(enumerate(rows))


def test_planted_groups_and_a_common_passage(spark, planted):
    assert found_classes(neardup.near_duplicates(frame(spark, planted))) == brute_classes(planted)


@pytest.mark.parametrize("share", [0.75, 0.78])
def test_near_copies_inside_a_long_template(spark, share):
    """Many unlike texts share most of their words; the near copies among them are found all the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    template, rows, pairs = [word() for _ in range(int(200 * share))], [], []
    own = 204 - len(template)
    for i in range(1200):
        mine = [word() for _ in range(own)]
        rows.append(" ".join(template + mine))
        if i % 12 == 0:
            pairs.append(sorted((len(rows) - 1, len(rows))))
            changed = int(0.18 * 200)  # edit similarity 0.82
            rows.append(" ".join(template + mine[: own - changed] + [word() for _ in range(changed)]))
    codes = [kmers(word_hashes(t)) for t in rows]
    assert all(similar(codes[a], codes[b], 0.8) for a, b in pairs) and not similar(codes[2], codes[3], 0.8)
    found = found_classes(neardup.near_duplicates(frame(spark, list(enumerate(rows)))))
    assert [g for g in found if len(g) > 1] == pairs


def test_one_of_each_class_is_kept(spark, planted):
    found = neardup.near_duplicates(frame(spark, planted)).collect()
    assert sorted(r.doc_id for r in found if r.is_kept) == sorted({r.class_id for r in found})
    kept = neardup.keep_one(clashing(frame(spark, planted)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in found})


def test_defined_cases(spark):
    found = [tuple(r) for r in neardup.near_duplicates(clashing(odd(spark))).select("doc_id", "class_id", "is_kept").collect()]
    assert len(found) == 10
    by_id = {i: (c, k) for i, c, k in found if i != 7}
    assert by_id[1] == (1, True) and by_id[2] == (2, True) and by_id[3] == (3, True) and by_id[None] == (None, True)
    assert [(c, k) for i, c, k in found if i == 4] == [(4, True)] * 2
    kept = neardup.keep_one(clashing(odd(spark)))
    assert kept.columns == clashing(odd(spark)).columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect() if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 7)]
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.keep_one(empty(spark)).count() == 0


def test_copies_with_nulls_first(spark):
    rows = [(None, "the very same words in both of them"), (9, "the very same words in both of them")]
    found = {r.doc_id: (r.class_id, r.is_kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert found == {None: (9, False), 9: (9, True)}


def test_the_query_covers_the_table(spark):
    from lattica.llm import queries

    out = queries.op1_near_duplicates(spark, SF)
    assert out.columns == ["doc_id", "class_id", "is_kept"] and out.count() == documents(spark).count()
