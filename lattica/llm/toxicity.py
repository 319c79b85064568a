"""Operator 7: toxicity by nearest labelled examples.

Terms are words and their beginnings of three to eight letters. Terms that tell labelled toxic documents from others are kept,
all that pass the test; documents are TF-IDF vectors over them. A document's nearest examples are found exactly by
cosine: examples lie in blocks, the largest weight of every term in every block bounds what a block can reach, and
blocks are visited by falling bound until none can hold a nearer example. Votes of the ``k`` nearest examples, weighted by
nearness, are calibrated by a logistic curve over votes that leave the example itself out; the examples, their labels and
cosines are the evidence.

Documents without a kept term are compared with all examples by TF-IDF over all words: the neighbours are the ``k`` nearest of
those with a cosine of ``near`` or more, found exactly through the rarest words of the text, as the other words together can't
reach ``near``. Their votes have a curve of their own, learnt from examples without a kept term; a text without such a
neighbour gets the share of toxic ones among the examples without one.

Learning uses at most ``sample`` labelled rows outside fold 0, those of least hash of their id, so the index that is
broadcast is bounded by their words; every document is scored.

Defined cases: null and empty texts have no term; null ids and labels teach nothing; ties of cosine go to
the earlier example; with one class or none among the labels every score is the share of label 1 (0 without labels);
very long texts are scored whole; repeated rows get the same score; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classifier import labelled_sample, logistic
from .common import WORD, Memo, flat_binary, materialise, release, slices

BLOCK = 128


def _terms_of(word: str) -> tuple[str, ...]:
    return (word, *("^" + word[:n] for n in range(3, 9) if len(word) > n))


_terms = Memo(_terms_of, 100_000)


def word_hash(word: str) -> bytes:
    return xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))


class Vectors:
    """Counts of the kept terms of a text, and the hashes of its words."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.heads = {t[1:4] for t in terms if t[0] == "^"}
        self.of_run = Memo(self._run, 100_000)

    def _run(self, run: str) -> tuple[tuple[int, ...], bytes]:
        words = (run,) if run.isalnum() else WORD.findall(run)
        return tuple(i for w in words for i in self._word(w)), b"".join(map(word_hash, words))

    def _word(self, word: str) -> tuple[int, ...]:
        if word[:3] in self.heads:
            return tuple(self.number[t] for t in _terms_of(word) if t in self.number)
        return (self.number[word],) if word in self.number else ()

    def read(self, text: str) -> tuple[dict[int, int], list[bytes]]:
        """Counts of kept terms; hashes of the words of each run."""
        found: dict[int, int] = {}
        runs = list(map(self.of_run.__getitem__, text.lower().split()))
        for hits, _ in runs:
            for i in hits:
                found[i] = found.get(i, 0) + 1
        return found, [h for _, h in runs]


def word_counts(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes and how often each occurs."""
    return np.unique(np.frombuffer(b"".join(hashes), dtype=">u8").astype(np.uint64), return_counts=True)


class Whole:
    """TF-IDF over all words of the examples, numbered from the rarest on; words are 64-bit hashes.

    Postings hold an example and a count in six bytes; weights are made of them when they are read.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, sizes: np.ndarray, k: int, near: float):
        """``words`` and ``counts`` of all examples one after the other, ``sizes`` words each."""
        n = len(sizes)
        self.n, self.k, self.near = n, k, near
        self.words = np.unique(words)
        term = np.searchsorted(self.words, words)
        df = np.bincount(term, minlength=len(self.words))
        order = np.lexsort((self.words, df))
        self.number = np.empty(len(order), dtype=np.int32)
        self.number[order] = np.arange(len(order), dtype=np.int32)
        self.idf = np.log((n + 1) / (df[order] + 0.5)) + 1e-9
        self.unseen = float(np.log((n + 1) / 0.5))
        self.tf = np.r_[0.0, 1 + np.log(np.arange(1, 1 << 16))]
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.terms, self.counts = self.number[term], np.minimum(counts, (1 << 16) - 1).astype(np.uint16)
        del term
        example = np.repeat(np.arange(n, dtype=np.int32), sizes)
        weight = self.tf[self.counts] * self.idf[self.terms]
        self.norm = np.maximum(np.sqrt(np.bincount(example, weight * weight, n)), 1e-300)
        del weight
        by = np.argsort(self.terms, kind="stable")
        self.post_ids, self.post_counts = example[by], self.counts[by]
        self.starts = np.searchsorted(self.terms[by], np.arange(len(order) + 1))
        self.slope, self.offset, self.constant = 8.0, -4.0, None

    def weigh(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the known words, the rarest first; unknown ones count in the norm alone."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(0, len(self.words) - 1))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), dtype=bool)
        numbers, tf = self.number[at[known]], self.tf[np.minimum(counts, len(self.tf) - 1)]
        w = tf[known] * self.idf[numbers]
        norm = np.sqrt((w * w).sum() + ((tf[~known] * self.unseen) ** 2).sum())
        by = np.argsort(numbers)
        return numbers[by], w[by] / norm if len(w) else w

    def nearest(self, hashes: np.ndarray, counts: np.ndarray, leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest that reach ``near``, nearest first."""
        terms, w = self.weigh(hashes, counts)
        rest = np.sqrt(np.append(np.cumsum((w * w)[::-1])[::-1], 0.0))  # norm of the words from each one on
        if not len(w) or rest[0] < self.near - 1e-9:
            return np.zeros(0, np.int64), np.zeros(0)
        cut = int(np.argmax(rest <= 0.6 * self.near))  # those from here on add at most 0.6 * near
        scaled = w * self.idf[terms]
        first, length = self.starts[terms[:cut]], self.starts[terms[:cut] + 1] - self.starts[terms[:cut]]
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        sums = np.bincount(self.post_ids[at], np.repeat(scaled[:cut], length) * self.tf[self.post_counts[at]], self.n)
        ids = np.flatnonzero(sums >= (self.near - rest[cut] - 1e-9) * self.norm)
        ids = ids[ids != leave_out]
        sims = np.empty(len(ids))
        for i, e in enumerate(ids.tolist()):
            own = slice(self.ends[e], self.ends[e + 1])
            place = np.minimum(np.searchsorted(terms, self.terms[own]), len(terms) - 1)
            sims[i] = (scaled[place] * self.tf[self.counts[own]])[terms[place] == self.terms[own]].sum() / self.norm[e]
        sims = np.round(sims, 9)
        ids, sims = ids[sims >= self.near], sims[sims >= self.near]
        by = np.lexsort((ids, -sims))[: self.k]
        return ids[by], sims[by]


@dataclass
class Index:
    """Block-max inverted index over the labelled examples."""

    terms: list[str]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    block_max: np.ndarray  # terms x blocks
    starts: np.ndarray  # of the postings of (term, block)
    post_ids: np.ndarray
    post_weights: np.ndarray
    k: int
    slope: float = 1.0
    offset: float = 0.0
    base: float = 0.0
    constant: float | None = None
    whole: Whole | None = None  # for texts without a kept term

    def judge_bare(self, hashes: list[bytes]) -> tuple[float, np.ndarray, np.ndarray]:
        """(score, example numbers, cosines) of a text without a kept term."""
        if self.whole is None:
            return self.calibrated(None), np.zeros(0, np.int64), np.zeros(0)
        ids, sims = self.whole.nearest(*word_counts(hashes))
        vote = self.vote(ids, sims)
        if vote is None or self.constant is not None:
            return self.calibrated(None), ids, sims
        return float(1 / (1 + np.exp(-np.clip(self.whole.slope * vote + self.whole.offset, -40, 40)))), ids, sims

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        terms = np.fromiter(sorted(counts), np.int64, len(counts))
        w = (1 + np.log([counts[t] for t in terms.tolist()])) * self.idf[terms]
        return terms, w / np.sqrt((w * w).sum())

    def nearest(self, counts: dict[int, int], leave_out: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest, nearest first; examples without a common term aren't near."""
        terms, w = self.weigh(counts)
        bound = w @ self.block_max[terms]
        blocks = self.block_max.shape[1]
        ids, sims, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        order, done, group = np.argsort(-bound, kind="stable"), 0, 4
        order = order[bound[order] > 0]
        while done < len(order) and bound[order[done]] >= least - 1e-12:
            own = order[done : done + group]  # a few blocks at once; the first of them isn't ruled out
            done, group = done + group, 2 * group
            cells = (terms[:, None] * blocks + own).ravel()
            first, length = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
            at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
            examples = self.post_ids[at]
            dense = np.bincount(examples, np.repeat(np.repeat(w, len(own)), length) * self.post_weights[at], len(self.ids))
            new = np.flatnonzero(dense > 0)
            new = new[new != leave_out]
            ids, sims = np.concatenate([ids, new]), np.concatenate([sims, np.round(dense[new], 12)])
            if len(ids) > self.k:
                by = np.lexsort((ids, -sims))[: self.k]
                ids, sims = ids[by], sims[by]
            if len(ids) == self.k:
                least = sims.min()
        by = np.lexsort((ids, -sims))
        return ids[by], sims[by]

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float | None:
        """Share of toxic ones among the nearest, weighted by nearness; None without any."""
        if not len(ids):
            return None
        w = 1 / (1.05 - np.minimum(sims, 1.0))
        return float((w * self.labels[ids]).sum() / w.sum())

    def calibrated(self, vote: float | None) -> float:
        if self.constant is not None:
            return self.constant
        return self.base if vote is None else float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.offset, -40, 40))))


def build(terms: list[str], counts: list[dict[int, int]], ids: list[int], labels: list[int], k: int = 15) -> Index:
    """Index over the examples, and its calibration."""
    n, m = len(counts), len(terms)
    y = np.array(labels, dtype=np.float64)
    df = np.zeros(m)
    for c in counts:
        df[list(c)] += 1
    blocks = max(1, -(-n // BLOCK))
    index = Index(terms, np.log((n + 1) / (df + 0.5)) + 1e-9, np.array(ids, dtype=np.int64), y, np.zeros((m, blocks)), np.zeros(m * blocks + 1, np.int64), np.zeros(0, np.int64), np.zeros(0), k)
    rows = [(*index.weigh(c), i) for i, c in enumerate(counts) if c]
    if rows:
        term = np.concatenate([t for t, _, _ in rows])
        weight = np.concatenate([w for _, w, _ in rows])
        example = np.concatenate([np.full(len(t), i) for t, _, i in rows])
        cell = term * blocks + example // BLOCK
        by = np.lexsort((example, cell))
        index.post_ids, index.post_weights = example[by], weight[by]
        index.starts = np.searchsorted(cell[by], np.arange(m * blocks + 1))
        np.maximum.at(index.block_max.reshape(-1), cell, weight)
    if len(set(labels)) < 2:
        index.constant = float(y.mean()) if n else 0.0
        return index
    bare = [label for label, c in zip(labels, counts, strict=True) if not c]
    index.base = (sum(bare) + y.mean()) / (len(bare) + 1)
    votes = [(index.vote(*index.nearest(c, i)), y[i]) for i, c in enumerate(counts) if c]
    votes = [(v, label) for v, label in votes if v is not None]
    if len({label for _, label in votes}) == 2:
        index.slope, index.offset = logistic(np.array([v for v, _ in votes]), np.array([label for _, label in votes]))
    else:
        index.slope, index.offset = 8.0, -4.0
    return index


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = 12_000, k: int = 15, least: int = 3, near: float = 0.5) -> Index:
    """Choose terms and build the index from at most ``sample`` label rows.

    Term counts are summed by Spark; the terms that pass the test and the examples' word hashes and counts (12 bytes for each
    distinct word of an example) go to the driver.
    """
    # bounded by sample; copies of a text would make its words look telling
    rows = materialise(labelled_sample(docs, labels, target, sample).dropDuplicates(["value", "label"]), "toxicity-sample")
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return build([], [{}] * (n0 + n1), list(range(n0 + n1)), [0] * n0 + [1] * n1, k)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: Counter(), 1: Counter()}

        def flush():
            terms = list(sums[0].keys() | sums[1].keys())
            batch = pa.RecordBatch.from_pydict({"term": terms, "c0": [sums[0][t] for t in terms], "c1": [sums[1][t] for t in terms]})
            sums[0].clear()
            sums[1].clear()
            return batch

        for batch in batches:
            for text, label in (row for part in slices(batch) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                sums[label].update({t for w in set(WORD.findall(text.lower())) for t in _terms[w]})
                if len(sums[0]) + len(sums[1]) > 200_000:
                    yield flush()
        if sums[0] or sums[1]:
            yield flush()
        _terms.clear()  # no later stage reads it
        release()

    counted = rows.select("value", "label").mapInArrow(count, "term string, c0 long, c1 long").groupBy("term").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    counted = materialise(counted.where(F.col("c1") >= least), "toxicity-terms")
    tested, share = max(2, counted.count()), n1 / (n0 + n1)
    n = F.col("c0") + F.col("c1")
    ratio = F.log(((F.col("c1") + 0.5) / (n1 + 1)) / ((F.col("c0") + 0.5) / (n0 + 1)))
    # log-likelihood ratio against the common share; among so many terms chance reaches about log(tested)
    evidence = F.col("c1") * F.log(F.col("c1") / (n * share)) + F.when(F.col("c0") > 0, F.col("c0") * F.log(F.col("c0") / (n * (1 - share)))).otherwise(0.0)
    kept = counted.withColumns({"ratio": ratio, "evidence": evidence}).where((F.col("ratio") > 2.0) & (F.col("evidence") > float(np.log(tested)) + 1))
    chosen = [r.term for r in kept.orderBy(F.col("evidence").desc(), "term").select("term").collect()]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vectors(chosen)
        for batch in batches:
            rows = []
            for text in (t for part in slices(batch) for t in part.column(1).to_pylist()):
                counts, hashes = of.read(text)
                words, n = word_counts(hashes)
                own = sorted(counts)
                rows.append((np.array(own, "<i4").tobytes(), np.array([counts[t] for t in own], "<i4").tobytes(), words.astype("<u8").tobytes(), n.astype("<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(4))], names=["doc_id", "label", "terms", "counts", "words", "times"])
            del batch, rows
            release()

    found = rows.select("doc_id", "value", "label").mapInArrow(vectors, "doc_id long, label int, terms binary, counts binary, words binary, times binary")
    table = found.orderBy("doc_id", "label", "words", "times").toArrow()
    ids, taught = table["doc_id"].to_pylist(), table["label"].to_pylist()
    flat = lambda name, kind: flat_binary(table[name], kind)
    sizes = lambda name, width: pc.divide(pc.binary_length(table[name]), width).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes("terms", 4))[:-1]
    counts = [dict(zip(t.tolist(), c.tolist(), strict=True)) for t, c in zip(np.split(flat("terms", "<i4"), ends), np.split(flat("counts", "<i4"), ends), strict=True)] if ids else []
    index = build(chosen, counts, ids, taught, k)
    words, times, lengths = flat("words", "<u8"), flat("times", "<i4"), sizes("words", 8)
    del table
    whole = index.whole = Whole(words, times, lengths, k, near)
    release()
    own = lambda i: slice(whole.ends[i], whole.ends[i + 1])
    votes = [(index.vote(*whole.nearest(words[own(i)], times[own(i)], i)), index.labels[i]) for i, c in enumerate(counts) if not c]
    votes = [(v, label) for v, label in votes if v is not None]
    if len({label for _, label in votes}) == 2:
        whole.slope, whole.offset = logistic(np.array([v for v, _ in votes]), np.array([label for _, label in votes]))
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, evidence) of each row; evidence: the nearest examples as structs (doc_id, label, cosine)."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by train's sample and terms
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        of = Vectors(index.terms)

        def judge(items: tuple) -> tuple[float, list]:
            counts = dict(items)
            ids, sims = index.nearest(counts)
            return index.calibrated(index.vote(ids, sims)), shown(ids, sims)

        def shown(ids: np.ndarray, sims: np.ndarray) -> list:
            return [{"doc_id": int(index.ids[i]), "label": int(index.labels[i]), "cosine": float(s)} for i, s in zip(ids[:3], sims[:3], strict=True)]

        def judge_text(text: str) -> tuple[float, list]:
            counts, hashes = of.read(text)
            if counts:
                return memo[tuple(sorted(counts.items()))]
            found, ids, sims = index.judge_bare(hashes)
            return found, shown(ids, sims)

        memo = Memo(judge, 20_000)
        for batch in batches:
            out = [judge_text(t) for a in range(0, len(batch), 256) for t in batch.column(1).slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], evidence)], names=["key", "score", "evidence"])
            release()

    source = docs.select(docs[id_col].cast("long").alias("key"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("value"))
    return source.mapInArrow(run, "key long, score double, evidence array<struct<doc_id:long,label:int,cosine:double>>").withColumnRenamed("key", id_col)


def reject(docs: DataFrame, index: Index, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        of = Vectors(index.terms)
        memo = Memo(lambda items: index.calibrated(index.vote(*index.nearest(dict(items)))), 20_000)

        def low(text: str | None) -> bool:
            counts, hashes = of.read(text or "")
            return (memo[tuple(sorted(counts.items()))] if counts else index.judge_bare(hashes)[0]) < threshold

        for batch in batches:
            texts = batch.column(at).cast(pa.string())
            yield batch.filter(pa.array([low(t) for a in range(0, len(batch), 256) for t in texts.slice(a, 256).to_pylist()], pa.bool_()))
            del texts
            release()

    return docs.mapInArrow(run, docs.schema)
