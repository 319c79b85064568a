"""Operator 5: quality rules with cross-document line frequency.

Every line is normalised (lower case, blanks collapsed, digits as 0) and hashed. For each host the distinct documents of a
line are counted; lines in more documents than the host's limit are removed, and a document of which too little is left is
rejected. Exact copies count as one document, or every group of copies would lose its lines: documents are distinct texts,
told apart by a 64-bit hash of the whole text, so texts that differ in a letter or digit are two documents.

Texts are read once for base figures and line hashes, which are written to the shared folder; what is counted and joined for
the verdicts are numbers. A hot line is one row for each distinct text before its final count, so no task gets it whole.
``apply`` moves each text once more, to its verdict, and takes lines out by their places with DataFrame functions.

Defined cases: null and empty texts have no words and fail the base rules; a null host is the empty host; repeated rows get
the same verdict and count as one document; ties don't arise; very long texts are taken whole, in time about linear in their
length; extra columns are kept by ``apply`` and ignored by ``judge``; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, output_name, release

WORDS = re.compile(r"[^ \t-\r]+")
#: White space of str.split() that doesn't part words here.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
WINDOW = 8
DIGIT = re.compile(r"[0-9]")


def split_words(text: str) -> list[str]:
    return WORDS.findall(text) if OTHER_SPACE.search(text) else text.split()


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that are found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    if len(number) == len(words):
        return 0
    size = len(words)
    code, span = ids, 1
    while span < window:  # exact: codes of windows of 2, 4, 8 words are renumbered densely before they are combined
        step = min(span, window - span)
        pair = code[: size - span - step + 1] * np.uint64(size + 1) + code[step : size - span - step + 1 + step]
        span += step
        code = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    seen = np.bincount(code.astype(np.int64))[code.astype(np.int64)] > 1
    if not seen.any():
        return 0
    edge = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(seen)
    edge[at] += 1
    edge[at + window] -= 1
    return int((np.cumsum(edge)[:size] > 0).sum())


def line_hash(line: str) -> int:
    """Signed 64-bit hash of the normalised line."""
    value = xxhash.xxh64_intdigest(DIGIT.sub("0", " ".join(split_words(line.lower()))).encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def figures(text: str) -> tuple[int, int, int, int, int, list[int], list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; place, hash and word count of each line with a word."""
    words = split_words(text)
    lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(BLANKS)]
    hashes, counts = [line_hash(x) for _, x in lines], [len(split_words(x)) for _, x in lines]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len({x for _, x in lines}), repeat_words(words), [i for i, _ in lines], hashes, counts


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base figures and lines of each row, written to the shared folder, with a row number that stays."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), *[pa.int64()] * 5, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["row_id", "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_at", "lines", "line_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_id = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, hosts, hashes = (batch.column(i) for i in (0, 2, 3))
            for a in range(0, len(batch), 256):  # a few texts at once are Python strings
                texts = batch.column(1).slice(a, 256).to_pylist()
                rows = [(row_id + i, *figures(t)) for i, t in enumerate(texts)]
                row_id += len(texts)
                own = list(zip(*rows, strict=True))
                columns = [own[0], *(c.slice(a, 256) for c in (keys, hosts, hashes)), *own[1:]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            del batch, keys, hosts, hashes
            release()

    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    source = docs.select(docs[id_col].cast("long").alias("key"), text.alias("value"), F.coalesce(docs[host_col].cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("text_hash"))
    schema = "row_id long, doc_id long, host string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_at array<int>, lines array<long>, line_words array<int>"
    return materialise(source.mapInArrow(run, schema), "line-figures")


def frequent_lines(measured: DataFrame, least: int = 20, share: float = 0.002) -> DataFrame:
    """(host, line) of the lines in more distinct texts of a host than max(least, share * its distinct texts)."""
    lines = measured.select("host", "text_hash", F.explode(F.array_distinct("lines")).alias("line"))
    # two steps, both with partial sums: first a row for each (host, line, text), then their number
    counted = lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.sum("one").alias("n_docs")).where(F.col("n_docs") > least)
    hosts = measured.groupBy("host", "text_hash").agg(F.lit(1).alias("one")).groupBy("host").agg(F.sum("one").alias("host_docs"))
    return counted.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * share).select("host", "line", "n_docs")


def judge(docs: DataFrame, least: int = 20, share: float = 0.002, keep_share: float = 0.25, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Figures, places of the lines removed (of the text split at \\n) and verdict; one row for each row of ``docs``."""
    measured = measure(docs, id_col, text_col, host_col)
    frequent = frequent_lines(measured, least, share)
    lines = measured.select("row_id", "host", F.explode(F.arrays_zip("line_at", "lines", "line_words")).alias("x")).select("row_id", "host", F.col("x.line_at").alias("at"), F.col("x.lines").alias("line"), F.col("x.line_words").alias("words"))
    removed = lines.join(frequent, ["host", "line"]).groupBy("row_id").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("at")).alias("removed_lines"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return (
        measured.drop("line_at", "lines", "line_words")
        .join(removed, "row_id", "left")
        .select("doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"), "removed_lines", (~base_failed & (left >= F.col("n_words") * keep_share)).alias("kept"))
    )


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines at the sorted places ``gone``; linear in its lines."""
    before = F.concat(F.array(F.lit(-1)), F.slice(gone, F.lit(1), F.size(gone) - 1))
    stays = F.flatten(F.zip_with(gone, before, lambda at, last: F.concat(F.array_repeat(F.lit(True), at - last - 1), F.array(F.lit(False)))))
    # the array of flags ends with the last line that goes; lines behind it have a null flag
    return F.array_join(F.zip_with(F.split(text, "\n"), stays, lambda line, stay: F.when(F.coalesce(stay, F.lit(True)), line)), "\n")


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The rows of ``docs`` that are kept, with the frequent lines taken out of their texts; all columns stay."""
    verdicts = judge(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits).where("kept")
    own_id, own_host, own_hash, gone = (output_name(docs, f"_{n}") for n in ("id", "host", "hash", "lines"))
    verdicts = verdicts.select(F.col("doc_id").alias(own_id), F.col("host").alias(own_host), F.col("text_hash").alias(own_hash), F.col("removed_lines").alias(gone)).dropDuplicates([own_id, own_host, own_hash])
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_hash)) & (F.coalesce(docs[host_col].cast("string"), F.lit("")) == F.col(own_host))
    cleaned = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col).cast("string"), F.col(gone)))
    return docs.join(verdicts, same).withColumn(text_col, cleaned).select(docs.columns)


def judge_sql(least: int = 20, share: float = 0.002, keep_share: float = 0.25) -> str:
    """Figures and verdicts of ``documents`` in DuckDB's dialect."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{word}') AS words FROM d),
starts AS (SELECT rid, words, unnest(generate_series(1, len(words) - {WINDOW - 1})) AS i FROM w),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i : i + {WINDOW - 1}], ' ')) AS n FROM starts),
twice AS (SELECT rid, count(DISTINCT place) AS n_repeat_words FROM (SELECT rid, unnest(generate_series(i, i + {WINDOW - 1})) AS place FROM windows WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, host, text, line, regexp_replace(array_to_string(regexp_extract_all(lower(line), '{word}'), ' '), '[0-9]', '0', 'g') AS norm, len(regexp_extract_all(line, '{word}')) AS n
  FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}')),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS host_docs FROM d GROUP BY host),
frequent AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT text) AS n_docs FROM lines GROUP BY host, norm) JOIN hosts USING (host) WHERE n_docs > {least} AND n_docs > host_docs * {share}),
gone AS (SELECT rid, sum(n) AS removed_words FROM lines JOIN frequent USING (host, norm) GROUP BY rid),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(removed_words, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN twice USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - removed_words >= n_words * {keep_share} AS kept, removed_words FROM b"""
