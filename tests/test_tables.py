"""The graph of the tables keeps every row."""

import os

from lattica.session import Session
from lattica.sources.tables import table_graph

FOLDER = "/root/testdata/sf0.001"


def test_long_conversations_lose_no_turn(spark, tmp_path):
    for name in os.listdir(FOLDER):
        if name != "conversations.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    rows = [(0, t, "user", f"a{t}") for t in range(9_990, 10_010)] + [(1, t, "user", f"b{t}") for t in range(20)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    session = Session(table_graph(spark, str(tmp_path)))
    assert session.query("MATCH (t:Turn) RETURN count(*) AS n").first().n == 40
    assert session.query("MATCH (:Turn)-[:NEXT]->(:Turn) RETURN count(*) AS n").first().n == 38
