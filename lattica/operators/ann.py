"""Approximate nearest neighbours: inverted cells around centroids, and one fixed-size vector for a list of vectors.

An index is a table partitioned by cell; a query reads the cells whose centroids are nearest and ranks their vectors by exact
distance, so it errs only by cells it doesn't read. All index types of the dialect are served by cells with whole vectors.
Centroids come from a sample of a stated size; every row is assigned. Without ``nprobes`` a query scans all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..catalog import VID
from ..errors import CompileError
from ..storage import work_path

SAMPLE = 20_000


@dataclass
class Cells:
    """Centroids and the table of (_vid, vec, _cell) by cell; ``source`` is the label's table they were made of."""

    centroids: np.ndarray
    path: str
    metric: str
    source: DataFrame

    def nearest(self, query: list[float], nprobes: int) -> list[int]:
        q = directed(np.array([query], dtype=np.float64), self.metric)
        by = np.argsort(gaps(q, self.centroids, self.metric)[0], kind="stable")
        return [int(c) for c in by[: max(1, nprobes)]]

    def candidates(self, query: list[float], nprobes: int) -> DataFrame:
        """(_vid, vec) of the nearest cells; Spark reads their folders alone."""
        table = self.source.sparkSession.read.schema(f"{VID} bigint, vec array<double>, _cell int").parquet(self.path)
        return table.where(F.col("_cell").isin(self.nearest(query, nprobes))).select(VID, "vec")


def directed(x: np.ndarray, metric: str) -> np.ndarray:
    """Unit vectors for cosine; others as they are."""
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300) if metric == "cosine" else x


def gaps(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """What ranks centroids: negative products for dot, squared distances otherwise."""
    product = x @ centroids.T
    return -product if metric == "dot" else (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * product


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids by Lloyd's rounds from a draw of rows; an empty cell takes the row that is farthest from its centroid."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        far = gaps(x, centroids, "l2")
        cell = far.argmin(1)
        own = far[np.arange(len(x)), cell]
        moved = np.zeros_like(centroids)
        np.add.at(moved, cell, x)
        n = np.bincount(cell, minlength=len(centroids))
        moved[n > 0] /= n[n > 0, None]
        for empty in np.flatnonzero(n == 0):
            moved[empty] = x[own.argmax()]
            own[own.argmax()] = -1
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def build_cells(df: DataFrame, prop: str, partitions: int = 64, metric: str = "cosine", sample: int = SAMPLE) -> Cells:
    """Index the vectors of a label's table; rows without one take no part."""
    spark = df.sparkSession
    rows = df.where(F.col(prop).isNotNull()).select(VID, F.col(prop).cast("array<double>").alias("vec"))
    drawn = rows.orderBy(F.xxhash64(VID)).limit(sample).select("vec").toArrow()["vec"].to_pylist()  # bounded by sample
    if not drawn:
        raise CompileError(f"no vectors of {prop} to index")
    centroids = k_means(directed(np.array(drawn, dtype=np.float64), metric), partitions)
    shared = spark.sparkContext.broadcast(centroids)  # partitions x dimensions

    @pandas_udf("int")
    def cell(vecs: pd.Series) -> pd.Series:
        return pd.Series(gaps(directed(np.array(vecs.tolist(), dtype=np.float64), metric), shared.value, metric).argmin(1).astype(np.int32))

    path = work_path(spark, "cells")
    rows.withColumn("_cell", cell("vec")).write.partitionBy("_cell").parquet(path)
    return Cells(centroids, path, metric, df)


def fixed_encoding(vectors: Column, size: int, query: bool = False, repetitions: int = 8, bits: int = 3, seed: int = 11) -> Column:
    """One vector of repetitions * 2^bits * size numbers for a list of vectors; products of a query's and a document's estimate their MaxSim.

    Random planes deal vectors into buckets; a query's bucket holds their sum, a document's their mean, or where it is empty the vector
    whose signs are nearest to the bucket's.
    """
    planes = np.random.default_rng(seed).normal(size=(repetitions, size, bits))

    @pandas_udf("array<double>")
    def encode(lists: pd.Series) -> pd.Series:
        out = []
        for one in lists:
            x = np.array([list(v) for v in one], dtype=np.float64) if one is not None and len(one) else np.zeros((0, size))
            parts = []
            for plane in planes:
                signs = (x @ plane > 0).astype(np.int64)
                bucket = signs @ (1 << np.arange(bits))
                sums = np.zeros((1 << bits, size))
                np.add.at(sums, bucket, x)
                n = np.bincount(bucket, minlength=1 << bits)
                if not query and len(x):
                    sums[n > 0] /= n[n > 0, None]
                    for b in np.flatnonzero(n == 0):
                        own = (b >> np.arange(bits)) & 1
                        sums[b] = x[(signs != own).sum(1).argmin()]
                parts.append(sums.ravel())
            out.append(np.concatenate(parts) / np.sqrt(repetitions))
        return pd.Series(out)

    return encode(vectors)
