"""Helpers that the operators share: the shared folder, materialised tables, words, folds."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate and classifier operators: runs of letters, digits and underscores, lower case.
WORD = re.compile(r"\w+")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see; a temporary one only where none is configured (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.conf.get("spark.lattica.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + _temporary()
        spark.conf.set("spark.lattica.shared.dir", path)
    return path.rstrip("/")


def _temporary() -> str:
    """A folder of this process, removed when it ends."""
    path = tempfile.mkdtemp(prefix="lattica-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the table to the shared folder and read it back: it cuts lineage and outlives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from learning."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def output_name(df: DataFrame, wanted: str) -> str:
    """A column name that no column of the input has: ``wanted``, or ``wanted_1`` and so on."""
    taken, name, n = {c.lower() for c in df.columns}, wanted, 0
    while name.lower() in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def chunks(texts: list, limit: int = 4_000_000):
    """Slices (start, end) of a list of texts, each of about ``limit`` characters or one text."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo(dict):
    """A dict that fills itself by a function and is emptied beyond ``limit`` entries."""

    def __init__(self, make, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def flat_binary(column, kind: str):
    """All values of an Arrow binary column one after the other, as numbers read from its buffers."""
    import numpy as np

    parts = [np.zeros(0, kind)]
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if ends[-1] > ends[0]:
                parts.append(np.frombuffer(chunk.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(parts)


@functools.cache
def _trim():
    """glibc's malloc_trim; where there is another C library, nothing."""
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def release() -> None:
    """Give back what Arrow and the C library hold of batches and texts that are gone; workers are used again by later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch, size: int = 256):
    """Parts of a batch of at most ``size`` rows, so that only their texts are Python strings at once."""
    for a in range(0, len(batch), size):
        yield batch.slice(a, size)


@functools.cache
def fs_of(uri: str):
    """(pyarrow filesystem, base path) of a URI or an absolute path."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)
