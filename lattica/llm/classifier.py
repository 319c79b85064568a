"""Operator 4: quality classifier, naive-Bayes support vectors.

Features are indicators of n-grams of one and two signs, runs without white space (long ones are cut into pieces, which all
count): n-grams of the words as they are in lower case, and n-grams of their shapes (letters by case, digits, other signs as
they are), marked where a sign repeats the one before it. An indicator of a shape says that its n-gram makes up at least
2^-level of the text. Indicators are scaled by the log-ratio of the
classes' smoothed counts, and a linear hinge-loss model is fitted on them by dual coordinate descent, as Wang and Manning
describe (NBSVM). Scores are calibrated by a logistic curve over margins of folds that the margin's model did not see.

Learning uses at most ``sample`` labelled rows, those of least hash of their id, outside fold 0; all rows are scored.

Defined cases: null and empty texts have the features of the empty text and a score; null ids and null labels teach nothing;
a document with several labels counts for each; with one class or none among the labels every score is the
share of label 1 (0.5 without labels); repeated rows get the same score; very long texts are read whole; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, flat_binary, fold_of, release, slices

BITS = 20
LEVELS = 9
RUN = re.compile(r"(.)\1{2,}")
SAME = re.compile(r"([Aa0])\1+")

#: Kinds of characters by code point, for str.translate.
_kinds = Memo(lambda point: "A" if (c := chr(point)).isupper() else "a" if c.isalpha() else "0" if c.isnumeric() else c)


def _collapse(kinds: str) -> str:
    return RUN.sub(r"\1\1\1", SAME.sub(r"\1", kinds))


def shape(sign: str) -> str:
    """Letters by case in runs of one, digits as 0, other signs kept in runs of three at most."""
    return _collapse(sign.translate(_kinds))


def pieces(sign: str) -> list[str]:
    """The sign itself, or where it is long, consecutive pieces of it: 64 letters, or 16 where their shape is longer than that."""
    cut = [sign[i : i + 64] for i in range(0, len(sign), 64)]
    return [y for x in cut for y in ([x] if len(x) <= 16 or len(shape(x)) <= 16 else [x[i : i + 16] for i in range(0, len(x), 16)])]


def _code(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


#: Codes of shapes, in the upper half; many signs have the same kinds of characters.
_shapes = Memo(lambda kinds: _code(_collapse(kinds)) << 32, 50_000)
#: Codes of a sign: its shape's in the upper half, its lower-case word's in the lower one.
_codes = Memo(lambda sign: _shapes[sign.translate(_kinds)] | _code(sign.lower()), 200_000)
HALF = np.uint64(32)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, as np.unique gives them."""
    x = np.sort(x)
    first = np.empty(len(x), dtype=bool)
    first[:1] = True
    np.not_equal(x[1:], x[:-1], out=first[1:])
    return x[first]


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers below 2^BITS."""
    signs = text.split()
    if signs and max(map(len, signs)) > 16:
        signs = [y for x in signs for y in (pieces(x) if len(x) > 16 else (x,))]
    n = len(signs)
    lines = [x for x in text.split("\n") if x]
    extra = [_code(f"length {n.bit_length()}")]
    extra += [_code(f"twice {i}") for i in range(LEVELS) if len(lines) > 1 and (len(lines) - len(set(lines))) * 2**i >= len(lines)]
    if not n:
        return np.unique(np.array(extra, dtype=np.int64) & ((1 << BITS) - 1))
    codes = np.fromiter(map(_codes.__getitem__, signs), np.uint64, n)
    words = (codes & np.uint64(0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    codes >>= HALF
    same = np.zeros(n, dtype=bool)
    same[1:] = np.fromiter(map(operator.eq, signs, signs[1:]), bool, n - 1)
    codes = (codes * np.uint64(2) + same) * np.uint64(0x9E3779B97F4A7C15)
    pairs = (codes[:-1] ^ (codes[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    couples = (words[:-1] ^ (words[1:] >> np.uint64(7))) * np.uint64(0xC2B2AE3D27D4EB4F)
    parts = [np.concatenate([words * np.uint64(0xFF51AFD7ED558CCD), couples * np.uint64(0xFF51AFD7ED558CCF)]) >> np.uint64(64 - BITS)]
    for grams in (codes, pairs):
        found, counts = np.unique(grams, return_counts=True)
        level = np.minimum(np.floor(np.log2(n / counts)), LEVELS).astype(np.int64)
        times = LEVELS + 1 - level  # one for each level from its own on
        ends = np.cumsum(times)
        at = np.repeat(found, times) + (np.arange(times.sum()) - np.repeat(ends - LEVELS - 2, times)).astype(np.uint64)
        parts.append((at * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - BITS))
    parts.append(np.array(extra, dtype=np.uint64) & np.uint64((1 << BITS) - 1))
    return distinct(np.concatenate(parts).astype(np.int32)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32, for each feature number
    bias: float
    slope: float
    offset: float
    constant: float | None = None

    def margin(self, feats: np.ndarray) -> float:
        return float(self.weights[feats].sum()) / max(1.0, np.sqrt(len(feats))) + self.bias

    def score(self, feats: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(feats) + self.offset, -40, 40))))


def fit_margin(rows: list[np.ndarray], labels: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias: log-count ratios times the hinge-loss weights found by dual coordinate descent."""
    size = 1 << BITS
    p, q = np.ones(size), np.ones(size)
    for x, y in zip(rows, labels, strict=True):
        (p if y else q)[x] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(p == 1) & (q == 1)] = 0
    values = [(ratio[x] / max(1.0, np.sqrt(len(x)))).astype(np.float32) for x in rows]
    squares = np.array([v @ v for v in values]) + 1.0
    share = labels.mean()
    bound = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * c  # both classes weigh alike
    sign, alpha = np.where(labels == 1, 1.0, -1.0), np.zeros(len(rows))
    w, bias, order = np.zeros(size), 0.0, np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            gradient = sign[i] * (w[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / squares[i], 0.0), bound[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[x] += step * sign[i] * v
                bias += step * sign[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return (w * ratio).astype(np.float32), bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, by Newton steps with his smoothed targets."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, folds: int = 3) -> Model:
    """Model and calibration; constant where there is nothing to tell apart."""
    zero = np.zeros(1 << BITS, dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return Model(zero, 0.0, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.5)
    weights, bias = fit_margin(rows, labels)
    model = Model(weights, bias, 1.0, 0.0)
    margins, part = np.zeros(len(rows)), np.arange(len(rows)) % folds
    for k in range(folds):
        own = np.flatnonzero(part != k)
        if len(set(labels[own].tolist())) < 2:
            margins[part == k] = [model.margin(rows[i]) for i in np.flatnonzero(part == k)]
            continue
        other = Model(*fit_margin([rows[i] for i in own], labels[own]), 1.0, 0.0)
        margins[part == k] = [other.margin(rows[i]) for i in np.flatnonzero(part == k)]
    model.slope, model.offset = logistic(margins, labels)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, value, label) of at most ``sample`` labelled rows outside fold 0, those of least hash.

    ``sample`` bounds the label rows, so they may be broadcast to the documents.
    """
    chosen = labels.select(labels["doc_id"].cast("long").alias("lid"), labels[target].cast("int").alias("label")).where(F.col("lid").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("lid")) != 0)).orderBy(F.xxhash64("lid"), "lid", "label").limit(sample)
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("value"))
    return source.join(F.broadcast(chosen), F.col("doc_id") == F.col("lid")).drop("lid")


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = 12_000) -> Model:
    """Fit on the driver from at most ``sample`` label rows' feature numbers: 4 bytes for each distinct n-gram, about 3 kB a row.

    Where ids repeat, a label meets several texts; at most twice ``sample`` of them teach, in the order of their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = [features(t).astype("<i4").tobytes() for part in slices(batch) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(feats, pa.binary())], names=["doc_id", "label", "feats"])
            del batch, feats
            release()

    found = labelled_sample(docs, labels, target, sample).mapInArrow(run, "doc_id long, label int, feats binary")
    table = found.orderBy("doc_id", "label", "feats").limit(2 * sample).toArrow()
    taught = np.array(table["label"].to_pylist(), dtype=np.int64)
    ends = np.cumsum(pc.divide(pc.binary_length(table["feats"]), 4).to_numpy().astype(np.int64))[:-1]
    rows = np.split(flat_binary(table["feats"], "<i4"), ends) if len(taught) else []
    del table
    release()
    order = np.random.default_rng(1).permutation(len(rows))
    return fit([rows[i] for i in order.tolist()], taught[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(features(t)) for part in slices(batch) for t in part.column(1).to_pylist()], pa.float64())], names=["key", "score"])
            del batch
            release()

    source = docs.select(docs[id_col].cast("long").alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("value"))
    return source.mapInArrow(run, "key long, score double").withColumnRenamed("key", id_col)
