"""Operator 8: nearest neighbours by vantage-point trees, one for each shard.

Vectors are dealt into shards by a hash of their id; a task builds the tree of a shard and writes it to the shared folder.
Each query goes to every shard, in blocks: a task takes one block through one tree, and the k nearest of each shard are merged
by a ranking with a limit. A child whose distance interval to the vantage point shows that none of its vectors can be nearer
than ``bound`` is skipped if lower_bound * factor > bound: factor 1 is exact, larger factors prune more. In a leaf, squared
norms and products rule out most vectors, with a margin above their rounding; the others get their distance summed
component by component.

Defined cases: null vectors, zero vectors and vectors with null or non-finite components, and rows with a null id, take no
part; vectors are compared with those of their own length only; very long ones are held whole, a block of queries and a leaf
at a time; rows that share a query's id count as the query's own, and each of them is a query;
ties go to the smaller id; fewer candidates than k give fewer rows; empty tables give no row; extra columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fs_of, work_path

LEAF = 96


def build(points: np.ndarray) -> dict[str, np.ndarray]:
    """Tree over rows: ``order`` and for each node (start, end, vantage row, near child, far child, intervals)."""
    order = np.arange(len(points))
    nodes, bounds = [], []
    stack = [(0, len(points), -1, 0)]
    while stack:
        start, end, parent, side = stack.pop()
        node = len(nodes)
        nodes.append([start, end, -1, -1, -1])
        bounds.append([0.0, 0.0, 0.0, 0.0])
        if parent >= 0:
            nodes[parent][3 + side] = node
        if end - start <= LEAF:
            continue
        own = order[start:end]
        vantage = own[(end - start) * 7919 % (end - start) if end - start < 7919 else 7919]
        far = np.sqrt(((points[own] - points[vantage]) ** 2).sum(1))
        vantage = own[int(far.argmax())]  # a point at the rim separates better than one in the middle
        d = np.sqrt(((points[own] - points[vantage]) ** 2).sum(1))
        by = np.argsort(d, kind="stable")
        order[start:end], d = own[by], d[by]
        middle = (end - start) // 2
        nodes[node][2] = vantage
        bounds[node] = [d[0], d[middle - 1], d[middle], d[-1]]
        stack += [(start, start + middle, node, 0), (start + middle, end, node, 1)]
    return {"order": order, "nodes": np.array(nodes, dtype=np.int64).reshape(-1, 5), "bounds": np.array(bounds).reshape(-1, 4)}


class Search:
    """The k nearest so far of a block of queries."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, factor: float):
        self.q, self.ids, self.k, self.factor = queries, ids, k, factor
        self.norm = (queries * queries).sum(1)
        self.dist = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)

    def over(self, tree: dict[str, np.ndarray], points: np.ndarray, ids: np.ndarray) -> None:
        nodes, bounds, order = tree["nodes"], tree["bounds"], tree["order"]
        norms = (points * points).sum(1)
        stack = [(0, np.arange(len(self.q)), np.zeros(len(self.q)))] if len(points) else []
        while stack:
            node, active, low = stack.pop()
            open_ = low * self.factor <= self.dist[active, -1] * (1 + 1e-12)
            active = active[open_]
            if not len(active):
                continue
            start, end, vantage, near, far = nodes[node]
            if vantage < 0:
                own = order[start:end]
                for a in range(0, len(active), 1024):
                    self._leaf(active[a : a + 1024], points[own], norms[own], ids[own])
                continue
            d = np.sqrt(((self.q[active] - points[vantage]) ** 2).sum(1))
            b = bounds[node]
            near_low = np.maximum(np.maximum(b[0] - d, d - b[1]), 0)
            far_low = np.maximum(np.maximum(b[2] - d, d - b[3]), 0)
            first = near_low <= far_low
            for child, lows, which in ((far, far_low, first), (near, near_low, ~first), (far, far_low, ~first), (near, near_low, first)):
                if which.any():
                    stack.append((child, active[which], lows[which]))

    def _leaf(self, active: np.ndarray, points: np.ndarray, norms: np.ndarray, ids: np.ndarray) -> None:
        size = self.norm[active][:, None] + norms[None, :]
        about = size - 2 * (self.q[active] @ points.T)  # squared distances, up to rounding
        worst = self.dist[active, -1:]
        r, c = np.nonzero((about <= worst * worst + 1e-9 * size) & (ids[None, :] != self.ids[active][:, None]))
        if not len(r):
            return
        dist = np.empty(len(r))
        for a in range(0, len(r), 65536):
            diff = self.q[active[r[a : a + 65536]]] - points[c[a : a + 65536]]
            dist[a : a + 65536] = np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1])
        rows = np.unique(r)
        held = active[rows]
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.searchsorted(rows, r)])
        dist, found = np.concatenate([self.dist[held].ravel(), dist]), np.concatenate([self.found[held].ravel(), ids[c]])
        by = np.lexsort((found, dist, at))
        place = np.arange(len(by)) - np.searchsorted(at[by], np.arange(len(rows)))[at[by]]
        by = by[place < self.k].reshape(len(rows), self.k)
        self.dist[held], self.found[held] = dist[by], found[by]


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id LONG, vec ARRAY<DOUBLE>) of the rows that take part."""
    vec = df[vec_col].cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(df[id_col].cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def build_index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = 100_000, path: str | None = None) -> list[tuple[int, str]]:
    """Write a tree file for each shard; gives (vector length, file), one entry a shard."""
    spark = df.sparkSession
    path = path or work_path(spark, "vptree")
    rows = valid_vectors(df, id_col, vec_col)
    n = rows.count()
    shards = max(1, -(-n // shard_rows))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        points = np.array(group["vec"].tolist(), dtype=np.float64)
        if np.array_equal(points, points.astype(np.float32)):
            stored = points.astype(np.float32)
        else:
            stored = points
        buffer = io.BytesIO()
        np.savez(buffer, points=stored, ids=group["id"].to_numpy(np.int64), **build(points))
        fs, base = fs_of(path)
        fs.create_dir(base, recursive=True)
        name, temporary = f"tree-{points.shape[1]}-{int(group['shard'].iloc[0]):06d}.npz", f"{base}/_{uuid.uuid4().hex}"
        with fs.open_output_stream(temporary) as f:
            f.write(buffer.getbuffer())
        fs.move(temporary, f"{base}/{name}")
        return pd.DataFrame({"dim": [points.shape[1]], "file": [f"{path}/{name}"]})

    dealt = rows.withColumn("dim", F.size("vec")).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return sorted((r.dim, r.file) for r in dealt.groupBy("dim", "shard").applyInPandas(write, "dim int, file string").collect())  # one row a shard


def search(df: DataFrame, index: list[tuple[int, str]], is_query: Column, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which ``is_query`` (over column ``id``) holds."""
    spark = df.sparkSession
    trees = spark.createDataFrame(index, "dim int, file string")  # one row a shard
    copies = Window.partitionBy("id", "vec").orderBy("id")
    queries = valid_vectors(df, id_col, vec_col).where(is_query).withColumn("copy", F.row_number().over(copies))
    blocks = max(1, -(-queries.count() // block))
    dealt = queries.join(F.broadcast(trees), F.size("vec") == F.col("dim")).withColumn("block", F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = Search(np.array(group["vec"].tolist(), dtype=np.float64), group["id"].to_numpy(np.int64), k, factor)
        file = group["file"].iloc[0]
        fs, base = fs_of(file.rsplit("/", 1)[0])
        with fs.open_input_file(f"{base}/{file.rsplit('/', 1)[1]}") as f:
            tree = dict(np.load(io.BytesIO(f.read())))
        found.over(tree, tree["points"].astype(np.float64), tree["ids"])
        r, c = np.nonzero(np.isfinite(found.dist))
        return pd.DataFrame({"query_id": found.ids[r], "query": group["query"].to_numpy()[r], "vec_id": found.found[r, c], "score": found.dist[r, c]})

    # a query is told from others of its id by its vector and the number of the copy
    named = dealt.select("id", "vec", F.struct(F.xxhash64("vec").alias("vec_hash"), "copy").cast("string").alias("query"), "file", "block")
    near = named.groupBy("file", "block").applyInPandas(run, "query_id long, query string, vec_id long, score double")
    order = Window.partitionBy("query_id", "query").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_force(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> list[list[int]]:
    """Ids of the k nearest by comparing all, for recall."""
    out = []
    for q, own in zip(queries, query_ids, strict=True):
        d = np.sqrt(((points - q) ** 2).sum(1))
        d[ids == own] = np.inf
        by = np.lexsort((ids, d))[:k]
        out.append([int(i) for i in ids[by] if True][: int(np.isfinite(d).sum())])
    return out
