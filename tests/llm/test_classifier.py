"""Operator 4: accuracy on the rows it never learns from, and its dual coordinate descent against the primal."""

import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import classifier, queries

from .helpers import ODD, clashing, empty, frame, odd

FOLDER = "/root/testdata/sf0.01"


def area(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    pos = labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in queries.op4_quality_classifier(spark, FOLDER).collect()}


def test_held_out_accuracy(spark, scored):
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if r.quality is not None]
    held = [(scored[i], y) for i, y in labels if scored[i].held_out]
    assert len(held) > 40
    y = np.array([y for _, y in held])
    assert area(np.array([r.score for r, _ in held]), y) > 0.9
    assert np.mean([r.predicted == label for r, label in held]) > 0.85


def test_contract(spark, scored):
    assert len(scored) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for i, r in scored.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = classifier.train(docs, labels), classifier.train(docs, other)
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 60)
    rows = [np.unique(np.where(rng.random(8) < 0.8, rng.integers(0, 20, 8) + 20 * label, rng.integers(0, 40, 8))) for label in y]
    weights, bias = classifier.fit_margin(rows, y, epochs=300)
    p, q = np.ones(1 << classifier.BITS), np.ones(1 << classifier.BITS)
    for x, label in zip(rows, y, strict=True):
        (p if label else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0
    dense = np.zeros((60, 41))
    for i, x in enumerate(rows):
        dense[i, x] = ratio[x] / np.sqrt(len(x))
    dense[:, 40] = 1
    sign, bound = np.where(y == 1, 1, -1), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    loss = lambda w: 0.5 * w @ w + (bound * np.maximum(0, 1 - sign * (dense @ w))).sum()
    own = np.r_[np.where(ratio[:40] != 0, weights[:40] / np.where(ratio[:40] == 0, 1, ratio[:40]), 0), bias]
    best = loss(own)
    for _ in range(200):
        assert loss(own + rng.normal(0, 0.05, 41)) > best - 1e-3


def test_defined_cases(spark):
    docs = clashing(odd(spark))
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (7, 1), (99, 0), (1, 0)], "doc_id long, quality int")
    model = classifier.train(docs, labels)
    got = classifier.score(docs, model).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    assert classifier.score(empty(spark), model).count() == 0
    none = classifier.train(docs, labels.where("false"))
    assert {r.score for r in classifier.score(docs, none).collect()} == {0.5}
    one = classifier.train(frame(spark, [(i, "word") for i in range(20)]), spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int"))
    assert {r.score for r in classifier.score(docs, one).collect()} == {1.0}


def test_all_of_a_text_without_blanks_counts():
    """What comes after the first signs of a long run changes the features; short signs stay whole."""
    han = "你好" * 40
    assert set(classifier.features(han)) != set(classifier.features(han + "{};=" * 500))
    mixed = "a1" * 20
    assert set(classifier.features(mixed)) != set(classifier.features(mixed + "#$" * 40))
    assert "".join(classifier.pieces("a1#B" * 100)) == "a1#B" * 100 and classifier.pieces("word") == ["word"]


def plain_features(text: str) -> np.ndarray:
    """The features of a text one level and one character at a time."""
    signs = [y for x in text.split() for y in classifier.pieces(x)]
    n, bits, levels = len(signs), classifier.BITS, classifier.LEVELS
    lines = [x for x in text.split("\n") if x]
    extra = [f"length {n.bit_length()}"] + [f"twice {i}" for i in range(levels) if len(lines) > 1 and (len(lines) - len(set(lines))) * 2**i >= len(lines)]
    found = [np.array([zlib.crc32(x.encode()) & ((1 << bits) - 1) for x in extra], np.uint64)]
    if n:
        kinds = ["".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c for c in s) for s in signs]
        shapes = [re.sub(r"(.)\1{2,}", r"\1\1\1", re.sub(r"([Aa0])\1+", r"\1", x)) for x in kinds]
        code = lambda texts: np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in texts], np.uint64)
        words = code([s.lower() for s in signs]) * np.uint64(0x9E3779B97F4A7C15)
        same = np.array([0] + [a == b for a, b in zip(signs, signs[1:], strict=False)], np.uint64)
        codes = (code(shapes) * np.uint64(2) + same) * np.uint64(0x9E3779B97F4A7C15)
        joined = lambda x: (x[:-1] ^ (x[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
        found += [(words * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits), (joined(words) * np.uint64(0xFF51AFD7ED558CCF)) >> np.uint64(64 - bits)]
        for grams in (codes, joined(codes)):
            each, counts = np.unique(grams, return_counts=True)
            level = np.minimum(np.floor(np.log2(n / counts)), levels)
            found += [((each[level <= i] + np.uint64(i + 1)) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits) for i in range(levels + 1)]
    return np.unique(np.concatenate(found)).astype(np.int64)


def test_features_are_those_of_the_plain_form():
    odd = [r[1] or "" for r in ODD] + ["a a", "\ud800x", "A" * 100 + " " + "aB1" * 40, "..... ____ !!!!!!", "½Ⅷ é" * 9, "a\na\na"]
    for text in odd:
        assert np.array_equal(classifier.features(text), plain_features(text)), text[:40]


def test_features_of_new_words_are_cheap():
    """Most words of large tables are new to a worker, so a new word must not cost a step for each of its characters."""
    rng = np.random.default_rng(5)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789-."))
    texts = [" ".join("".join(w) for w in letters[rng.integers(0, len(letters), (500, 10))]) for _ in range(120)]

    def cpu(make) -> float:
        began = time.process_time()
        for text in texts:
            make(text)
        return time.process_time() - began

    classifier.features(texts[0])
    once = []
    for _ in range(3):
        classifier._codes.clear()
        once.append(cpu(classifier.features))
    assert min(once) < 0.5 * min(cpu(plain_features) for _ in range(3))
