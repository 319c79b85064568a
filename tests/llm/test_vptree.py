"""Operator 8 against brute force: exact at factor one, recall beyond it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import queries, vptree

from .helpers import SF

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k):
    """{query: [(id, distance)]} of vectors of one length."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if is_query(q):
            near = sorted((float(np.sqrt(((a - b) ** 2).sum())), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out.setdefault(q, []).append([i for _, i in near])
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op8_vantage_points(spark, SF)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert got(out) == {q: v[0] for q, v in brute(rows, lambda i: i % 100 == 0, 10).items()}


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (12, 8))
    points = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 1, (3000, 8))).astype(np.float32)
    points[500:520] = points[500]  # ties
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_factor_one_is_exact_over_many_shards(spark, clustered):
    rows, df = clustered
    index = vptree.build_index(df, shard_rows=700)
    assert len(index) == 5
    found = got(vptree.search(df, index, F.col("id") % 20 == 0, k=10, block=40))
    want = brute([r[:2] for r in rows], lambda i: i % 20 == 0, 10)
    assert found == {q: v[0] for q, v in want.items()}


def test_recall_of_a_larger_factor(spark, clustered):
    rows, df = clustered
    found = got(vptree.search(df, vptree.build_index(df), F.col("id") % 20 == 0, k=10, factor=1.5))
    want = brute([r[:2] for r in rows], lambda i: i % 20 == 0, 10)
    recall = np.mean([len(set(found[q]) & set(v[0])) / 10 for q, v in want.items()])
    assert recall >= 0.9


def test_pruning_skips_vectors(clustered):
    rows, _ = clustered
    points = np.array([r[1] for r in rows])
    ids = np.arange(len(points))
    tree, seen = vptree.build(points), []
    search = vptree.Search(points[:1], ids[:1], 10, 1.0)
    leaf = search._leaf
    search._leaf = lambda active, p, n, i: (seen.append(len(p)), leaf(active, p, n, i))
    search.over(tree, points, ids)
    assert sum(seen) < len(points) / 2


def test_defined_cases(spark):
    rows = [
        (0, [1.0, 2.0], 0),
        (100, None, 0),
        (200, [0.0, 0.0], 0),
        (300, [1.0, None], 0),
        (400, [float("nan"), 1.0], 0),
        (500, [float("inf"), 1.0], 0),
        (None, [1.0, 2.0], 0),
        (7, [1.0, 2.0], 0),
        (5, [1.0, 2.0], 0),
        (600, [1.0, 2.0, 3.0], 0),
        (9, [4.0, 6.0], 0),
        (800, [], 0),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("vec", F.lit(1))
    out = vptree.search(df, vptree.build_index(df), F.col("id") % 100 == 0)
    assert [tuple(r) for r in out.orderBy("query_id", "rank").collect()] == [(0, 1, 5, 0.0), (0, 2, 7, 0.0), (0, 3, 9, 5.0)]
    none = df.where("false")
    assert vptree.search(none, vptree.build_index(none), F.col("id") % 100 == 0).count() == 0
