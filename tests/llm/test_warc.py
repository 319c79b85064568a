"""Operator 9: an exact round trip at any split size, payloads that look like archives included."""

import gzip
import hashlib

import pytest

from lattica.llm import queries, warc

from .helpers import SF

SCHEMA = "page_id long, url string, html string"
NESTED = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nPage-Id: 666\r\n\r\nnot a record").decode("latin-1")
BIG = "<p>" + "same body " * 200


def plain(rows):
    """(id, bytes, digest, type, target) of each row with distinct ids."""
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        again = len(body) >= 1000 and best[html or ""] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", best[html or ""] if again else None))
    return sorted(out)


def through(spark, df, **splits):
    files, _ = warc.write_warc(warc.mark_revisits(df))
    records = warc.page_records(warc.read_warc(spark, files, **splits))
    assert records.where("not digest_matches").count() == 0
    return files, records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(tuple(r) for r in queries.op9_warc(spark, SF).collect()) == plain(rows)


@pytest.fixture(scope="module")
def pages():
    rows = [(1, "http://a/\r\nX: y", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "u", None), (5, "u", ""), (6, "u", "x" * 999), (7, "u", "x" * 999), (8, "é", "é" * 500), (9, "u", "é" * 500), (10, "u", NESTED), (11, "u", NESTED * 3 + "\r\n\r\n" + "WARC/1.1\r\n" * 200)]
    return rows + [(20 + i, f"u{i}", f"page {i} " * (i * 7 % 50)) for i in range(20)]


@pytest.mark.parametrize("split", [150, 8_000_000])
def test_any_split_gives_each_record_once(spark, pages, split):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3, "page_id")
    _, records = through(spark, df, split_bytes=split)
    assert sorted(tuple(r) for r in records.collect()) == plain(pages)


def test_payloads_come_back(spark, pages):
    files, _ = warc.write_warc(warc.mark_revisits(spark.createDataFrame(pages, SCHEMA)))
    bodies = {int(r.headers["Page-Id"]): bytes(r.payload) for r in warc.read_warc(spark, files).collect() if r.headers["WARC-Type"] == "response"}
    assert all(bodies[i] == (html or "").encode() for i, _, html in pages if i in bodies)
    name = files.first().file.removeprefix("file://")
    with gzip.open(name) as f:  # any gzip reader can read an archive
        assert f.read().startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_stored_members_inside_a_payload(tmp_path):
    """A member stored without compression holds whole members as bytes; a split that starts there must not own them."""
    import zlib

    inner = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\ninner")
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = packer.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n" + inner + b"tail" * 50) + packer.flush()
    data = gzip.compress(b"WARC/1.1\r\n\r\nfirst") + outer + gzip.compress(b"WARC/1.1\r\n\r\nlast")

    class Handle:
        def read_at(self, n, start):
            return data[start : start + n]

    whole = list(warc.records_in(warc.Source(Handle(), len(data)), 0, len(data)))
    assert len(whole) == 3
    for size in (1, 5, 60, 200, len(data)):
        for hold in (0, 20, 64_000_000):  # what of a chain is held while it is followed changes nothing
            parts = [r for a in range(0, len(data), size) for r in warc.records_in(warc.Source(Handle(), len(data)), a, min(len(data), a + size), hold)]
            assert parts == whole


def test_defined_cases(spark):
    rows = [(None, "a", BIG), (None, "b", BIG), (3, "c", BIG), (3, "c", BIG), (5, None, None)]
    _, records = through(spark, spark.createDataFrame(rows, SCHEMA))
    out = records.collect()
    assert len(out) == 5 and {r.refers_to for r in out if r.record_type == "revisit"} == {3}
    _, none = through(spark, spark.createDataFrame([], SCHEMA))
    assert none.count() == 0
    from pyspark.sql import functions as F

    extra = spark.createDataFrame(rows[2:], SCHEMA).withColumns({c: F.lit(1) for c in ("digest", "best", "same", "target", "copies", "record_type", "payload_bytes", "refers_to")})
    assert through(spark, extra)[1].count() == 3
