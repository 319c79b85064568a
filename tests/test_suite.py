"""Registered queries of each family against their SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lattica.plans import suite

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "cypher_segment_revenue", "scan_unlabelled", "pattern_both_directions", "pattern_trail", "optional_match", "not_pattern", "collect_subquery",
    "vlp_bounded", "shortest_path", "expr_lists", "expr_temporal", "expr_btic", "agg_percentiles", "window_values", "algo_pagerank", "algo_triangles",
    "algo_node_similarity", "vector_query_l2", "fts_query", "hybrid_rrf", "rule_negation", "rule_noisy_or", "write_set_remove", "event_sessions",
]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def test_all_are_registered():
    assert set(NAMES) <= set(suite.queries()) and set(suite.oracle_sql()) <= set(suite.queries())


@pytest.mark.parametrize("name", NAMES)
def test_as_its_sql(spark, database, name):
    df = suite.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = database.execute(suite.oracle_sql()[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    want = [[plain(row[found.index(c)]) for c in columns] for row in cursor.fetchall()]
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == sorted(map(repr, want))


def test_threshold_search_counts_every_match(spark, tmp_path):
    spark.range(1100).selectExpr("id AS doc_id", "'Apache License version two' AS text").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(suite.oracle_sql()["fts_threshold"]).fetchall()
    assert [tuple(r) for r in suite.queries()["fts_threshold"](spark, str(tmp_path)).collect()] == want == [(1100,)]
