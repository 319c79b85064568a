"""Operator 7: exact neighbours against brute force, and accuracy on the rows it never learns from."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import queries, toxicity

from .helpers import clashing, documents, empty, frame, odd

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("n", [1, 40, 700])
def test_nearest_is_exact(n):
    rng = random.Random(n)
    terms = [f"t{i}" for i in range(50)]
    counts = [{rng.randrange(50): rng.randrange(1, 4) for _ in range(rng.randrange(0, 8))} for _ in range(n)]
    index = toxicity.build(terms, counts, list(range(n)), [rng.randrange(2) for _ in range(n)], k=9)
    dense = np.zeros((n, 50))
    for i, c in enumerate(counts):
        if c:
            t, w = index.weigh(c)
            dense[i, t] = w
    for _ in range(60):
        query = {rng.randrange(50): rng.randrange(1, 4) for _ in range(rng.randrange(1, 8))}
        t, w = index.weigh(query)
        cosine = np.round(dense[:, t] @ w, 12)
        by = [i for i in np.lexsort((np.arange(n), -cosine)) if cosine[i] > 0][:9]
        ids, sims = index.nearest(query)
        assert ids.tolist() == by and np.allclose(sims, cosine[by])


def test_whole_texts_meet_all_that_are_near():
    """Every example of cosine 0.5 or more, against cosines of dense vectors; unknown words count in the norm."""
    rng = random.Random(5)
    text = lambda: [rng.choice("abcdefghijklmnopqrstuvwxyz") if rng.random() < 0.6 else f"rare{rng.randrange(300)}" for _ in range(rng.randrange(0, 25))]
    base = [text() for _ in range(200)]
    texts = base + [t[: len(t) // 2] + text()[:5] for t in base]
    hashed = lambda ws: toxicity.word_counts([toxicity.word_hash(w) for w in ws])
    parts = [hashed(t) for t in texts]
    whole = toxicity.Whole(np.concatenate([h for h, _ in parts]), np.concatenate([c for _, c in parts]), np.array([len(h) for h, _ in parts]), k=9, near=0.5)
    df = Counter(w for t in texts for w in set(t))
    names = sorted(df)

    def vector(ws):
        c = Counter(ws)
        v = np.array([(1 + np.log(c[w])) * (np.log((len(texts) + 1) / (df[w] + 0.5)) + 1e-9) if w in c else 0.0 for w in names])
        other = sum(((1 + np.log(n)) * np.log((len(texts) + 1) / 0.5)) ** 2 for w, n in c.items() if w not in df)
        return v / (np.sqrt((v * v).sum() + other) or 1.0)

    dense = np.array([vector(t) for t in texts])
    for ws in [*base[:40], *(t[: len(t) // 2] + text()[:8] for t in base[:60]), *(b + [f"new{i}" for i in range(6)] for b in base[:30]), []]:
        cosine = np.round(dense @ vector(ws), 9)
        want = [i for i in np.lexsort((np.arange(len(texts)), -cosine)) if cosine[i] >= 0.5][:9]
        ids, sims = whole.nearest(*hashed(ws))
        assert ids.tolist() == want and np.allclose(sims, cosine[want])


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op7_toxicity(spark, FOLDER).collect()}


def test_held_out_accuracy(spark, scored):
    held = [(scored[r.doc_id], r.toxic) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.toxic is not None and scored[r.doc_id].held_out]
    right = [r.predicted == y for r, y in held]
    caught = [r.predicted for r, y in held if y == 1]
    assert len(caught) > 40 and np.mean(right) > 0.97 and np.mean(caught) > 0.85


def test_contract(spark, scored):
    assert len(scored) == documents(spark, FOLDER).count()
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def small(spark):
    docs = frame(spark, [(i, f"{'vilest slur' if i % 3 == 0 else 'kind words'} filler{i % 7} more filler{i % 5}") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    return docs, toxicity.train(docs, labels)


def test_evidence_and_rejection(spark):
    docs, index = small(spark)
    new = frame(spark, [(100, "what a vilest slur"), (101, "such kind words"), (102, "VILEST!! slur, slur")])
    found = {r.doc_id: r for r in toxicity.score(new, index).collect()}
    assert found[100].score > 0.5 > found[101].score and found[102].score > 0.5
    assert all(e.label == 1 for e in found[100].evidence) and len(found[100].evidence) == 3
    assert [r.doc_id for r in toxicity.reject(clashing(new), index).collect()] == [101]


def test_defined_cases(spark):
    docs, index = small(spark)
    got = toxicity.score(clashing(odd(spark)), index).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.reject(clashing(odd(spark)), index)
    assert kept.columns == clashing(odd(spark)).columns and kept.count() == 10
    assert toxicity.score(empty(spark), index).count() == 0 and toxicity.reject(empty(spark), index).count() == 0
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    one = toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(60)] + [(None, 1)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}


def test_texts_without_a_kept_term_meet_their_neighbours(spark):
    """A text with the very words of a labelled toxic example is compared with it, though none of the words is a kept term."""
    rows = [(i, f"{'vilest slur' if i % 3 == 0 else 'kind words'} filler{i % 7} more filler{i % 5}") for i in range(60)]
    rows += [(1000 + i, f"odd{i} rare{i} saying{i} nobody{i} knows{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(1000 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    index = toxicity.train(frame(spark, rows), labels)
    taught = set(index.ids.tolist())
    toxic = next(i for i in range(40) if i % 2 and 1000 + i in taught)
    new = frame(spark, [(1, rows[60 + toxic][1]), (2, "wholly unseen")])
    found = {r.doc_id: r for r in toxicity.score(new, index).collect()}
    assert [(e.doc_id, e.label, round(e.cosine, 6)) for e in found[1].evidence] == [(1000 + toxic, 1, 1.0)]
    assert found[2].evidence == [] and found[2].score == index.base
