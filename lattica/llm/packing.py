"""Operator 10: harmonic packing of token sequences.

A piece whose length lies in (C/(k+1), C/k] belongs to class k, and a bin of class k holds exactly k such pieces.
Documents are cut so that most pieces are exact reciprocals of the capacity C (C, C/2, C/4, ... C/32), which fill
their bins without rest; what remains of a document (under C/32 ids) goes to its own reciprocal class. Workers fill
bins on their own: nothing is shuffled, a partition needs one open bin for each class, and what lies in open bins
at the end of a partition is packed first-fit over all classes.

Defined cases: a null text is the empty text, which has the end id alone; null ids stay null; repeated rows are packed
once each; extra columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release, slices
from .tokens import byte_tokenizer

SMALLEST = 32


def cut(length: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces, in order: full ones, then halves by need, then the rest."""
    pieces = [capacity] * (length // capacity)
    rest, size = length % capacity, capacity // 2
    while size * SMALLEST >= capacity and size > 0:
        if rest >= size:
            pieces.append(size)
            rest -= size
        size //= 2
    return pieces + [rest] * (rest > 0)


class Packer:
    """Bins of one worker. ``add`` and ``finish`` give (piece, sequence, offset) of the bins that are closed."""

    def __init__(self, capacity: int, first: int = 0):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple[int, object]]] = {}

    def _close(self, pieces: list[tuple[int, object]]) -> list[tuple[object, int, int]]:
        out, offset = [], 0
        for length, piece in pieces:
            out.append((piece, self.next, offset))
            offset += length
        self.next += 1
        return out

    def add(self, length: int, piece: object) -> list[tuple[object, int, int]]:
        k = self.capacity // length
        bin_ = self.open.setdefault(k, [])
        bin_.append((length, piece))
        return self._close(self.open.pop(k)) if len(bin_) == k else []

    def finish(self) -> list[tuple[object, int, int]]:
        bins: list[list] = []  # a rest and its pieces
        for length, piece in sorted((x for b in self.open.values() for x in b), key=lambda x: -x[0]):
            for b in bins:
                if b[0] >= length:
                    break
            else:
                bins.append(b := [self.capacity])
            b[0] -= length
            b.append((length, piece))
        self.open.clear()
        return [x for b in bins for x in self._close(b[1:])]


SCHEMA = "key long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", runs: int = 600_000) -> DataFrame:
    """One row for each piece: (id, start, length, ids BINARY, doc_tokens, sequence_id, offset).

    ``sequence_id`` is the number of the partition times 2^33 plus the bin's number there. A worker remembers
    ``runs`` runs between tasks, about 230 bytes each.
    """
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    if capacity < 1:
        raise ValueError("capacity must be positive")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(vocabulary, runs).encode
        end = end_id.to_bytes(4, "little")
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            columns = list(zip(*rows, strict=True))
            rows, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for key, text in (row for part in slices(batch) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                ids = (encode(text) if text else b"") + end
                total, start = len(ids) // 4, 0
                for length in cut(total, capacity):
                    piece = (key, start, length, ids[4 * start : 4 * (start + length)], total)
                    start += length
                    closed = packer.add(length, piece)
                    rows += [(*p, sequence, offset) for p, sequence, offset in closed]
                    size += 4 * capacity * bool(closed)
                if size > 8_000_000:
                    yield flush()
            del batch
            release()
        rows += [(*p, sequence, offset) for p, sequence, offset in packer.finish()]
        if rows:
            yield flush()

    source = docs.select(docs[id_col].cast("long").alias("key"), docs[text_col].cast("string").alias("value"))
    return source.mapInArrow(run, SCHEMA).withColumnRenamed("key", id_col)
