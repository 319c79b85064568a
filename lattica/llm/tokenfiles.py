"""Operator 3: training-order token files.

All documents, each followed by an end id, form one stream of ids, cut into sequences of a fixed length (the last is
padded). A keyed Feistel permutation with cycle-walking maps the number of a sequence to its slot in training order, a
bijection of 0..N-1 that needs no table. Slots are range-partitioned into shards of a fixed number of slots, and each
shard is one file of fixed-stride records, so slot s lies at byte (s mod per_shard) * stride of shard s // per_shard:
a trainer reads sequentially and resumes at any slot by arithmetic.

A first pass encodes each partition into compressed blocks of ids, written to the shared folder with their place in the
partition; one number of a partition goes to the driver. A second one cuts the blocks and deals the pieces to the task of
their shard, one row for each block and shard; nothing but ids is shuffled, and nothing is sorted: a task sets the pieces
into one buffer of a shard's size. The order of the stream is the order of the input's partitions and rows when it was encoded.
Files are written under a temporary name and renamed, so a task that runs again leaves the same file.

Defined cases: a null text counts as the empty text (its end id alone); null ids and extra columns have no influence;
repeated rows are repeated in the stream; an empty table writes no shard and gives no row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fs_of, materialise, work_path
from .tokens import byte_tokenizer

ROUNDS = 6


def feistel(values: np.ndarray, domain: int, key: str) -> np.ndarray:
    """The place of each value of 0..domain-1 under the keyed permutation."""
    half = max(1, ((max(domain, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]
    out = np.asarray(values, dtype=np.uint64).copy()
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for k in keys:
            mixed = right ^ k
            mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= domain]  # cycle-walking: until it falls into the domain
    return out.astype(np.int64)


def write_token_files(docs: DataFrame, vocabulary: str, path: str | None = None, length: int = 1024, key: str = "training", end_id: int = 50256, per_shard: int = 16384, block_bytes: int = 2_000_000, text_col: str = "text") -> tuple[DataFrame, dict]:
    """Write the shards below ``path``; gives a table (shard, file, first_slot, n_slots) and the layout.

    The returned table has been materialised: the files exist when this returns.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "token-files")
    source = docs.select(docs[text_col].cast("string").alias("value"))
    end = end_id.to_bytes(4, "little")
    width = 2 if end_id < 65536 and vocabulary_size(vocabulary) <= 65536 else 4
    kind = f"<u{width}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, part = byte_tokenizer(vocabulary).encode, TaskContext.get().partitionId()
        pending, size, at = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal pending, size, at
            ids = np.frombuffer(b"".join(pending), dtype="<u4")
            first, at = at, at + len(ids)
            pending, size = [], 0
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "at": [first], "n": [len(ids)], "ids": [zstandard.compress(ids.astype(kind).tobytes(), 3)]})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                pending.append((encoded(text) if text else b"") + end)
                size += len(pending[-1])
                if size > block_bytes:
                    yield flush()
        if pending:
            yield flush()

    blocks = materialise(source.mapInArrow(encode, "part int, at long, n long, ids binary"), "token-blocks")
    bases, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        bases[r.part] = total
        total += r.n
    n_sequences = -(-total // length)
    layout = {"path": path, "length": length, "width": width, "stride": width * length, "per_shard": per_shard, "sequences": n_sequences, "tokens": total, "key": key}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time: they are large
                part, at, n, stream = (batch.column(c)[i].as_py() for c in range(4))
                at += bases[part]
                data = np.frombuffer(zstandard.decompress(stream), dtype=kind)
                bounds = np.array([at, *range((at // length + 1) * length, at + n, length), at + n], dtype=np.int64)
                slots = feistel(bounds[:-1] // length, n_sequences, key)
                shards, out = slots // per_shard, []
                for shard in np.unique(shards).tolist():
                    own = np.flatnonzero(shards == shard)
                    ids = np.concatenate([data[bounds[k] - at : bounds[k + 1] - at] for k in own])
                    places = (slots[own] - shard * per_shard) * length + bounds[own] % length
                    out.append((shard, places.tobytes(), (bounds[own + 1] - bounds[own]).tobytes(), zstandard.compress(ids.tobytes(), 3)))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["shard", "places", "lengths", "ids"])

    n_shards = max(1, -(-n_sequences // per_shard))
    pieces = blocks.mapInArrow(deal, "shard long, places binary, lengths binary, ids binary")
    dealt = pieces.repartitionById(n_shards, F.col("shard").cast("int"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers: dict[int, np.ndarray] = {}  # a partition is one shard
        for batch in batches:
            for i in range(batch.num_rows):
                shard, places, lengths, ids = (batch.column(c)[i].as_py() for c in range(4))
                if shard not in buffers:
                    buffers[shard] = np.zeros(min(per_shard, n_sequences - shard * per_shard) * length, dtype=kind)
                data, at = np.frombuffer(zstandard.decompress(ids), dtype=kind), 0
                for place, n in zip(np.frombuffer(places, dtype=np.int64).tolist(), np.frombuffer(lengths, dtype=np.int64).tolist(), strict=True):
                    buffers[shard][place : place + n] = data[at : at + n]
                    at += n
        fs, base = fs_of(path)
        fs.create_dir(base, recursive=True)
        for shard, buffer in buffers.items():
            temporary = f"{base}/_{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as out:
                out.write(memoryview(buffer).cast("B"))
            fs.move(temporary, f"{base}/shard-{shard:08d}.bin")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [f"{path}/shard-{shard:08d}.bin"], "first_slot": [shard * per_shard], "n_slots": [len(buffer) // length]})

    rows = dealt.mapInArrow(write, "shard long, file string, first_slot long, n_slots long").collect() if n_sequences else []  # one row a file
    return spark.createDataFrame([tuple(r) for r in rows], "shard long, file string, first_slot long, n_slots long"), layout


def vocabulary_size(vocabulary: str) -> int:
    """Number of ids of a vocabulary file."""
    return byte_tokenizer(vocabulary).library.get_vocab_size()


def read_token_files(files: DataFrame, layout: dict, slots_at_once: int = 4096) -> DataFrame:
    """(slot, shard, ids BINARY): each record read back from its place."""
    stride, per_shard = layout["stride"], layout["per_shard"]
    spans = files.select("file", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_slots") - 1, F.lit(slots_at_once).cast("long"))).alias("first"), "n_slots")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, shard, first, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                fs, name = fs_of(file.rsplit("/", 1)[0])
                n = min(slots_at_once, n - first)
                with fs.open_input_file(f"{name}/{file.rsplit('/', 1)[1]}") as f:
                    data = f.read_at(n * stride, first * stride)
                yield pa.RecordBatch.from_pydict({"slot": np.arange(n, dtype=np.int64) + shard * per_shard + first, "shard": np.full(n, shard, dtype=np.int64), "ids": pa.array([data[i : i + stride] for i in range(0, n * stride, stride)], pa.binary())})

    return spans.repartition(max(1, min(4096, layout["sequences"] // slots_at_once)), "file", "first").mapInArrow(read, "slot long, shard long, ids binary")
