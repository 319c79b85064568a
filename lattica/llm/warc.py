"""Operator 9: WARC archives, written and read by splits.

Writing: each partition is one ``.warc.gz`` file with a gzip member for each record. Of records with equal payloads of
at least ``least`` bytes the one with the largest id is a response; the others are revisit records that name it. Files get
their name by a rename, so a task that runs again leaves one copy.

Reading is splittable: a task gets a byte range, looks for the gzip magic from its start, and takes a candidate for a
member only if its head decodes to a WARC version line. It owns the records that start inside its range, reads the last
of them beyond the range's end, and follows members from end to start. Where a chain of members breaks off before
another member or the end of the file, its records were bytes inside a payload: they are dropped and the search goes on.
Contents of a chain are held up to a bound while it is followed; the others are decoded again once it is known to be whole.

Defined cases: a null html is an empty payload; repeated rows are equal payloads (ties on the id: the row of least url);
a null id can't be a target unless all ids of the payload are null, and then refers_to stays null; very long payloads are
one record, held whole by one task; an empty table gives no file and no record; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fs_of, work_path

MAGIC = b"\x1f\x8b\x08"
HEAD = b"WARC/1."


def mark_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html BINARY, digest, record_type, refers_to); revisits carry no payload."""
    body = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), body.alias("html")).select("*", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("payload_bytes"))
    order = F.struct(F.coalesce("page_id", F.lit(-(2**63)).cast("long")), F.xxhash64("url"))
    # the groups are small rows; of the pages' own rows only those of one digest meet it, and a hot digest is split by AQE
    best = rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.max(order).alias("best"), F.max("page_id").alias("target"), F.count("*").alias("copies")).where("copies > 1").select(F.col("digest").alias("same"), "best", "target")
    joined = rows.join(best, F.col("digest") == F.col("same"), "left")
    revisit = F.col("best").isNotNull() & ~(F.col("best") == order)
    out = joined.select("page_id", "url", F.when(~revisit | F.col("best").isNull(), F.col("html")).alias("html"), "digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("target")).alias("refers_to"))
    return out


def record_id(page_id: int | None, url: str | None) -> str:
    name = f"page:{page_id}" if page_id is not None else f"page::{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def member(page_id, url, html, digest, payload_bytes, record_type, refers_to) -> bytes:
    """One record as a gzip member."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: {record_id(page_id, url)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines += [f"WARC-Refers-To: {record_id(refers_to, None)}", f"Refers-To-Page-Id: {refers_to}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_warc(marked: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Write the archives; gives (file, bytes, records) of each file, materialised, and the folder."""
    spark = marked.sparkSession
    path = path or work_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = fs_of(path)
        fs.create_dir(base, recursive=True)
        name, out, size, n, temporary = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, 0, 0, f"{base}/_{uuid.uuid4().hex}"
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                out = out or fs.open_output_stream(temporary)
                data = member(*row)
                out.write(data)
                size, n = size + len(data), n + 1
        if out:
            out.close()
            fs.move(temporary, f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [f"{path}/{name}"], "bytes": [size], "records": [n]})

    columns = ["page_id", "url", "html", "digest", "payload_bytes", "record_type", "refers_to"]
    rows = marked.select(columns).mapInArrow(write, "file string, bytes long, records long").collect()  # one row a file
    return spark.createDataFrame([tuple(r) for r in rows], "file string, bytes long, records long"), path


class Source:
    """Bytes of a file by position, read ahead in blocks."""

    def __init__(self, handle, size: int, block: int = 1 << 20):
        self.handle, self.size, self.block, self.at, self.data = handle, size, block, 0, b""

    def get(self, start: int, n: int) -> bytes:
        n = max(0, min(n, self.size - start))
        if start < self.at or start + n > self.at + len(self.data):
            self.at, self.data = start, self.handle.read_at(min(max(n, self.block), self.size - start), start)
        return self.data[start - self.at : start - self.at + n]

    def find(self, what: bytes, start: int, end: int) -> int:
        """The first place of ``what`` that starts in [start, end), or -1."""
        while start < end:
            piece = self.get(start, min(self.block, end - start + len(what) - 1))
            at = piece.find(what)
            if 0 <= at < end - start:
                return start + at
            if len(piece) < len(what):
                return -1
            start += len(piece) - len(what) + 1
        return -1


def decode_member(source: Source, start: int, head_only: bool = False) -> tuple[bytes, int] | None:
    """(content, end) of a WARC gzip member, or None if there is none at that place."""
    if source.get(start, 3) != MAGIC:
        return None
    unpacker, parts, at, got = zlib.decompressobj(31), [], start, 0
    try:
        while not unpacker.eof:
            data = source.get(at, 65536 if not head_only else 512)
            if not data:
                return None
            parts.append(unpacker.decompress(data))
            got += len(parts[-1])
            at += len(data)
            if got >= len(HEAD):
                if not b"".join(parts[:8])[: len(HEAD)] == HEAD:
                    return None
                if head_only:
                    return b"", at
    except zlib.error:
        return None
    content = b"".join(parts)
    return (content, at - len(unpacker.unused_data)) if content.startswith(HEAD) else None


def chain_from(source: Source, at: int, end: int, hold: int) -> tuple[list[tuple[int, bytes | None]], int]:
    """Members that follow one another from ``at`` and start before ``end``, and where the last one ends.

    Contents are held up to ``hold`` bytes; those of further members are None, to be decoded again.
    """
    chain, held = [], 0
    while at < end and (found := decode_member(source, at)):
        held += len(found[0])
        chain.append((at, found[0] if held <= hold else None))
        at = found[1]
    return chain, at


def records_in(source: Source, start: int, end: int, hold: int = 64_000_000) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the records that start in [start, end); a chain is whole before its first record is given."""
    at = start
    while 0 <= (at := source.find(MAGIC, at, end)) < end:
        chain, place = chain_from(source, at, end, hold)
        if chain and (place >= source.size or decode_member(source, place, head_only=True)):
            for i, (first, content) in enumerate(chain):
                chain[i] = None  # given away
                yield first, content if content is not None else decode_member(source, first)[0]
            at = place
        else:
            at += 1


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = 8_000_000) -> DataFrame:
    """The records of archives (file, bytes): (file, position, headers MAP, named STRING, payload BINARY).

    ``named`` is the payload digest that the headers name, as lower-case hex. Each split is a task of its own.
    """
    splits = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    spans = files.select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start")).where("bytes > 0")
    schema = pa.schema([("file", pa.string()), ("position", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("named", pa.string()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, base = fs_of(file.rsplit("/", 1)[0])
                rows, held = [], 0
                with fs.open_input_file(f"{base}/{file.rsplit('/', 1)[1]}") as handle:
                    for position, content in records_in(Source(handle, size), start, min(size, start + split_bytes)):
                        head, _, rest = content.partition(b"\r\n\r\n")
                        headers = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in x)
                        body = rest[: int(headers.get("Content-Length", len(rest)))]
                        rows.append((file, position, list(headers.items()), hex_of(headers.get("WARC-Payload-Digest")), body.partition(b"\r\n\r\n")[2]))
                        held += len(body)
                        if held > 8_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return spans.repartition(min(int(splits), 100_000), "file", "start").mapInArrow(read, "file string, position long, headers map<string,string>, named string, payload binary")


def hex_of(digest: str | None) -> str | None:
    """Lower-case hex of a header's base-32 SHA-1; None for other digests."""
    return base64.b32decode(digest.removeprefix("sha1:")).hex() if digest and digest.startswith("sha1:") else None


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records read back; responses are hashed anew."""
    h = lambda name: F.col("headers").getItem(name)
    response = h("WARC-Type") == "response"

    rows = records.select(
        h("Page-Id").cast("long").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(h("Payload-Length").cast("long")).alias("payload_bytes"),
        h("WARC-Type").alias("record_type"),
        h("Refers-To-Page-Id").cast("long").alias("refers_to"),
        "named",
        F.when(response, F.sha1("payload")).alias("computed"),
    )
    return rows.select("page_id", "payload_bytes", F.coalesce("computed", "named").alias("payload_digest"), "record_type", "refers_to", (F.coalesce("computed", "named") == F.col("named")).alias("digest_matches"))
