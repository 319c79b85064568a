"""Operator 1: near-duplicates by Order MinHash, candidates verified by banded alignment.

Texts are lower-case words; a k-mer is five words, labelled with its occurrence number, so repeats differ. Each of
``sketches`` hash functions picks the ``picks`` least labelled k-mers, keeps them in text order and hashes that tuple: texts of
high edit similarity meet in a sketch with a probability that grows with what they share in the same order. Candidates are
verified by the edit similarity 1 - d / max(n, m) of their k-mer sequences, d the Levenshtein distance found by a banded
alignment; ``similarity`` (0.8) or more links two texts. Classes are the connected components of the links.

Copies are one text from the start, so a group of copies is a count. A bucket (one value of one sketch) is not expanded into
pairs: its members are compared with one of them, the most typical, which is the one whose buckets are the largest: in a group
of edited copies that is the text they were made from. Members of buckets that hold several classes after that meet again in
finer buckets of two sketches (those 1 to ``rounds`` apart), where they are compared with ``centres`` of other classes, drawn
by a hash that differs from bucket to bucket. Whatever buckets hold several classes after that is compared exactly: a link
needs max(n, m) - d common labelled k-mers, so two linked texts share one among the rarest n - least + 1 of each, least being what a text
of n k-mers must have in common. Texts that share such a k-mer and are of different classes are all compared, in blocks where
they are many. Rarity is an estimate from a sample; it orders k-mers alike for all texts and decides cost only. What
may be lost is a link of a text that meets no text of another class in any sketch.

Most candidates are decided by bounds of the distance: k-mers that the other text lacks must be edited, and the longest
chain of k-mers in common order leaves gaps that an alignment can always edit. The banded alignment decides the rest.

Components grow by alternating min-label steps over written tables; nothing is collected but counts.

Defined cases: null and empty texts form no group (each row its own class); a text with one to four words is one k-mer of
them all; rows with the same id and text fall into one class; null ids keep their rows and rank last as
representatives; ties of the least id go to the lesser text hash; very long texts are sketched and aligned whole, a band at a
time; extra columns are kept by ``keep_one``; empty tables give empty results.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Memo, materialise, output_name, release, slices

K = 5
#: Bits of the cells in which k-mers are counted.
CELLS = 20


def _hash_run(run: str) -> bytes:
    return b"".join(xxhash.xxh64_digest(w.encode("utf-8", "surrogatepass")) for w in WORD.findall(run))


_runs = Memo(_hash_run, 100_000)


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the lower-case words."""
    return np.frombuffer(b"".join(map(_runs.__getitem__, text.lower().split())), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    """Codes of the k-mers in text order; of fewer words than k one code of all."""
    n = len(words)
    if n == 0:
        return words
    k = min(n, k)
    code = np.zeros(n - k + 1, dtype=np.uint64)
    for i in range(k):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return code


def label_occurrences(code: np.ndarray) -> np.ndarray:
    """Codes combined with the number of equal codes before them."""
    by = np.argsort(code, kind="stable")
    ordered = code[by]
    heads = np.r_[True, ordered[1:] != ordered[:-1]]
    if heads.all():
        return code
    place = np.arange(len(code)) - np.maximum.accumulate(np.where(heads, np.arange(len(code)), 0))
    number = np.empty(len(code), dtype=np.uint64)
    number[by] = place
    return code + number * np.uint64(0xD6E8FEB86659FD93)


def seeds(sketches: int) -> np.ndarray:
    return mix(mix(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))


def order_minhash(code: np.ndarray, sketches: int, picks: int) -> np.ndarray:
    """A hash for each sketch, of its least labelled k-mers in text order."""
    labelled = label_occurrences(code)
    n, picks = len(labelled), min(picks, len(labelled))
    if picks == n:
        at = np.broadcast_to(np.arange(n), (sketches, n))
    else:
        parts, step = [], max(1, 2_000_000 // n)  # a few sketches at once of very long texts
        for i in range(0, sketches, step):
            hashed = mix((labelled[None, :] ^ seeds(sketches)[i : i + step, None]) * np.uint64(0x9FB21C651E98DF25))
            parts.append(np.argpartition(hashed, picks - 1, axis=1)[:, :picks])
        at = np.concatenate(parts)
    chosen = labelled[np.sort(at, axis=1)]
    out = np.arange(sketches, dtype=np.uint64)
    for i in range(picks):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
    return out.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance of two code sequences if it is at most ``most``, else most + 1; only a band is computed."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    same = a == b[: len(a)]
    start = int(np.argmin(same)) if len(a) and not same.all() else len(a)
    a, b = a[start:], b[start:]
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        cut = int(np.argmin(same)) if not same.all() else len(a)
        a, b = a[: len(a) - cut], b[: len(b) - cut]
    if not len(a) or not len(b):
        return min(len(a) + len(b), most + 1)
    band = min(most, max(8, len(b) - len(a)))
    while True:
        d = _banded(a, b, band)
        if d <= band or band >= most:
            return d if d <= most else most + 1
        band = min(most, 4 * band)


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Distance within the diagonals -band..band; exact if at most band."""
    n, m, width = len(a), len(b), 2 * band + 1
    far = np.int32(1 << 29)
    columns = np.arange(width, dtype=np.int32)
    padded = np.zeros(m + 2 * width + n, dtype=b.dtype)
    inside = np.zeros(len(padded), dtype=bool)
    padded[band + 1 : band + 1 + m] = b  # b[j] at j + band + 1
    inside[band + 1 : band + 1 + m] = True
    # row i holds the cells j = i - band .. i + band of the table of prefixes
    row = np.where(columns >= band, columns - band, far).astype(np.int32)
    row[columns - band > m] = far
    for i in range(1, n + 1):
        # cell (i, j) from (i-1, j-1), same column; from (i-1, j), next column; b[j-1] lies at j + band
        piece = slice(i, i + width)
        cost = row + (padded[piece] != a[i - 1])
        cost[~inside[piece]] = far
        up = np.append(row[1:], far) + 1
        row = np.minimum(cost, up)
        if i <= band:
            row[band - i] = i  # j = 0
            row[: band - i] = far
        row = columns + np.minimum.accumulate(row - columns)
        over = m - i + band + 1
        if over < width:
            row[over:] = far
        if int(row.min()) > band:
            return band + 1
    return int(row[m - n + band]) if 0 <= m - n + band < width else band + 1


def longest_increasing(x: np.ndarray) -> np.ndarray:
    """Places of a longest strictly increasing subsequence."""
    if (x[1:] > x[:-1]).all():
        return np.arange(len(x))
    tails: list[int] = []
    ends: list[int] = []
    before = np.empty(len(x), dtype=np.int64)
    for i, v in enumerate(x.tolist()):
        k = bisect.bisect_left(tails, v)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(v)
            ends.append(i)
        else:
            tails[k], ends[k] = v, i
    out, i = np.empty(len(tails), dtype=np.int64), ends[-1]
    for k in range(len(tails) - 1, -1, -1):
        out[k], i = i, before[i]
    return out


def distance_bounds(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Bounds of the Levenshtein distance of two code sequences, by their labelled codes."""
    la, lb = label_occurrences(a), label_occurrences(b)
    by = np.argsort(lb, kind="stable")
    ordered = lb[by]
    at = np.minimum(np.searchsorted(ordered, la), len(ordered) - 1)
    hit = ordered[at] == la
    place_a, place_b = np.flatnonzero(hit), by[at[hit]]
    least = max(len(a), len(b)) - len(place_a)
    chain = longest_increasing(place_b)
    gap_a, gap_b = (np.diff(np.concatenate([[-1], p[chain], [n]])) - 1 for p, n in ((place_a, len(a)), (place_b, len(b))))
    return least, int(np.maximum(gap_a, gap_b).sum())


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the edit similarity of two k-mer sequences reaches the threshold."""
    if not len(a) or not len(b):
        return False
    longest = max(len(a), len(b))
    most = int(np.floor((1 - similarity) * longest + 1e-9))
    if longest - min(len(a), len(b)) > most:
        return False
    least, reached = distance_bounds(a, b)
    return least <= most and (reached <= most or edit_distance(a, b, most) <= most)


def sketch_rows(docs: DataFrame, sketches: int, picks: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, word_key, sketch ARRAY<LONG>) of each row; word_key is a hash of the words, null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = [], []
            for text in (t for part in slices(batch) for t in part.column(2).to_pylist()):
                words = word_hashes(text)
                keys.append(xxhash.xxh128_hexdigest(words.tobytes()) if len(words) else None)
                hashes.append(order_minhash(kmers(words), sketches, picks) if len(words) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string()), pa.array(hashes, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "word_key", "sketch"])
            del batch, keys, hashes
            release()

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, text_hash long, word_key string, sketch array<long>")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, value): what names a row, and its text."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("value"))


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the candidate pairs (a, b) of word keys that are similar; texts: (word_key, value), one row a key.

    A text travels once for each pair it is in; hot centres are on the side that a skewed join copies.
    """
    joined = pairs.join(texts.select(F.col("word_key").alias("b"), F.col("value").alias("text_b")), "b").join(texts.select(F.col("word_key").alias("a"), F.col("value").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent = Memo(lambda text: kmers(word_hashes(text)), 16)
        for batch in batches:
            texts_of_pairs = (row for part in slices(batch) for row in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
            hit = [similar(recent[x], kmers(word_hashes(y)), similarity) for x, y in texts_of_pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))
            del batch
            release()

    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (a, b): the least node of its component.

    Alternating large-star and small-star steps; each step is a written table and a join-free aggregation over pairs.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: of every node, larger neighbours are linked to the least of its neighbours and itself
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        joined = large.join(least, large["u"] == least["n"])
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def first_candidates(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (word_key, bucket) of the buckets with two texts or more, and the pairs (a, b) of each text with its buckets' centres."""
    buckets = sketched.select("word_key", F.posexplode("sketch").alias("s", "h")).select("word_key", F.xxhash64("s", "h").alias("bucket"))
    sizes = materialise(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    met = materialise(buckets.join(sizes, "bucket"), "met")
    typical = met.groupBy("word_key").agg(F.sum(F.floor(F.log2("n") * 16)).alias("t"))
    ranked = materialise(met.join(typical, "word_key").select("word_key", "bucket", "t"), "ranked")
    centre = F.max(F.struct("t", F.xxhash64("word_key").alias("r"), "word_key"))
    centres = materialise(ranked.groupBy("bucket").agg(centre.alias("c")).select("bucket", F.col("c.word_key").alias("centre")), "centres")
    pairs = ranked.join(centres, "bucket").where("word_key <> centre").select(F.col("centre").alias("a"), F.col("word_key").alias("b")).distinct()
    return ranked.select("word_key", "bucket"), pairs


def mixed(rows: DataFrame, *more) -> DataFrame:
    """The buckets of rows (bucket, root) that hold several classes."""
    return rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), *more).where("lo <> hi").drop("lo", "hi")


def texts_apart(met: DataFrame, root: DataFrame) -> DataFrame:
    """(word_key, root) of the texts that share one of the first buckets with another class."""
    members = materialise(met.join(root, met["word_key"] == root["node"], "left").withColumn("root", F.coalesce("root", "word_key")).drop("node"), "members")
    return members.join(materialise(mixed(members), "mixed"), "bucket", "left_semi").select("word_key", "root").distinct()


def further_candidates(sketched: DataFrame, met: DataFrame, root: DataFrame, rounds: int, centres: int) -> DataFrame:
    """(a, b) of texts of different classes that share two sketches, 1 to ``rounds`` apart, one of them drawn by the bucket.

    Only texts take part that share one of the first buckets with another class.
    """
    apart = texts_apart(met, root)
    sketch = lambda i: F.element_at("sketch", i + 1)
    width = F.size("sketch")
    keys = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda step: F.transform(F.sequence(F.lit(0), width - 1), lambda s: F.xxhash64(step, s, sketch(s), sketch((s + step) % width)))))
    finer = materialise(apart.join(sketched.select("word_key", "sketch"), "word_key").select("word_key", "root", F.explode(keys).alias("bucket")), "finer")
    drawn = [F.min(F.struct(F.xxhash64("bucket", "word_key", F.lit(i)).alias("r"), "word_key", "root")).alias(f"c{i}") for i in range(centres)]
    chosen = mixed(finer, *drawn).select("bucket", F.array_distinct(F.array(*[F.struct(f"c{i}.word_key", f"c{i}.root") for i in range(centres)])).alias("chosen"))
    met_again = finer.join(materialise(chosen, "drawn"), "bucket").select("word_key", F.filter("chosen", lambda c: c["root"] != F.col("root")).alias("others")).where(F.size("others") > 0)
    return met_again.select("word_key", F.explode("others").alias("c")).select(F.greatest("word_key", "c.word_key").alias("a"), F.least("word_key", "c.word_key").alias("b")).distinct()


def rarest(code: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest labelled k-mers of a text, so many that every text linked to it shares one of its own such ones."""
    labelled = label_occurrences(code)
    order = np.lexsort((labelled, counts[(mix(labelled) >> np.uint64(64 - CELLS)).astype(np.int64)]))
    return labelled[order[: int(np.floor((1 - similarity) * len(labelled) + 1e-9)) + 1]]


def kmer_counts(texts: DataFrame, sample: int) -> np.ndarray:
    """Estimated frequency of k-mers, by cells of their hash, from about ``sample`` of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << CELLS, dtype=np.int64)
        for batch in batches:
            for text in (t for part in slices(batch) for t in part.column(0).to_pylist()):
                np.add.at(sums, (mix(label_occurrences(kmers(word_hashes(text)))) >> np.uint64(64 - CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(sums[cells])], names=["cell", "n"])

    part = texts.where(F.pmod(F.xxhash64("word_key", F.lit(1)), F.lit(max(1, texts.count() // sample))) == 0)
    found = part.select("value").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2^CELLS rows at most
    counts = np.zeros(1 << CELLS, dtype=np.int32)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def exact_candidates(apart: DataFrame, texts: DataFrame, similarity: float, sample: int = 20_000, block: int = 256) -> DataFrame:
    """(a, b) of all texts (word_key, root) of different classes that share one of their rarest k-mers and are of like length."""
    whole = materialise(apart.join(texts, "word_key"), "apart")
    shared = apart.sparkSession.sparkContext.broadcast(kmer_counts(whole, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            for part in slices(batch):
                codes = [kmers(word_hashes(t)) for t in part.column(2).to_pylist()]
                rare = [rarest(c, counts, similarity).view(np.int64) for c in codes]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(c) for c in codes], pa.int64()), pa.array(rare, pa.list_(pa.int64()))], names=["word_key", "root", "size", "rare"])
            del batch
            release()

    listed = whole.select("word_key", "root", "value").mapInArrow(run, "word_key string, root string, size long, rare array<long>")
    rows = materialise(listed.select("word_key", "root", "size", F.explode("rare").alias("bucket")), "rarest")
    groups = mixed(rows, F.ceil(F.count("*") / block).alias("blocks"))
    rows = materialise(rows.join(groups, "bucket"), "rarest-mixed")
    # one side of a large group is dealt into blocks, the other meets each of them
    a = rows.select("bucket", F.pmod(F.xxhash64("word_key"), "blocks").alias("block"), F.col("word_key").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"))
    b = rows.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("word_key").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"))
    like = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-6
    return a.join(b, ["bucket", "block"]).where((F.col("a") > F.col("b")) & (F.col("root_a") != F.col("root_b")) & like).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, similarity: float = 0.8, sketches: int = 16, picks: int = 3, rounds: int = 3, centres: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, class_id, is_kept, has_words) of each row: the class's least doc_id, and whether this row is the one that stays.

    Rows that share the kept row's id and text are kept alike; ``keep_one`` leaves one of them. No ``rounds``: neither finer buckets nor the exact pass.
    """
    rows = materialise(sketch_rows(docs, sketches, picks, id_col, text_col), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    # one row for each distinct sequence of words
    sketched = materialise(rows.where("word_key is not null").groupBy("word_key").agg(F.min(first).alias("least"), F.first("sketch").alias("sketch")), "distinct-sketches")
    met, pairs = first_candidates(sketched)
    pairs = materialise(pairs, "pairs")
    texts = materialise(texts_of(docs, sketched, met.select(F.col("word_key").alias("w")).distinct(), id_col, text_col), "texts")
    root = components(materialise(verify(pairs, texts, similarity), "found"))
    if rounds:
        tried = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        further = materialise(further_candidates(sketched, met, root, rounds, centres).join(tried, ["a", "b"], "left_anti"), "further-pairs")
        found = materialise(verify(further, texts, similarity), "further-found")
        if not found.isEmpty():
            root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))
        tried = tried.unionAll(further).unionAll(further.select(F.col("b").alias("a"), F.col("a").alias("b")))
        last = materialise(exact_candidates(texts_apart(met, root), texts, similarity).join(tried, ["a", "b"], "left_anti"), "last-pairs")
        found = materialise(verify(last, texts, similarity), "last-found")
        if not found.isEmpty():
            root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(found))
    # a class is named by its least id; texts without a link are their own root
    named = sketched.select("word_key", "least").join(root, F.col("word_key") == F.col("node"), "left").select("word_key", "least", F.coalesce("root", "word_key").alias("root"))
    named = materialise(named, "named")
    chosen = materialise(named.groupBy("root").agg(F.min("least").alias("chosen")), "chosen")
    classes = named.join(chosen, "root").select(F.col("word_key").alias("wk"), "chosen")
    joined = rows.select("doc_id", "text_hash", "word_key").join(classes, F.col("word_key") == F.col("wk"), "left")
    is_kept = F.col("chosen").isNull() | (F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("text_hash") == F.col("chosen.text_hash")))
    return joined.select("doc_id", "text_hash", F.when(F.col("chosen").isNull(), F.col("doc_id")).otherwise(F.col("chosen.doc_id")).alias("class_id"), is_kept.alias("is_kept"), F.col("word_key").isNotNull().alias("has_words"))


def texts_of(docs: DataFrame, sketched: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word_key, value) of the wanted keys: the text of each key's least row."""
    source = sketched.join(wanted, sketched["word_key"] == wanted["w"], "left_semi").select("word_key", F.col("least.doc_id").alias("id"), F.col("least.text_hash").alias("th"))
    texts = keyed(docs, id_col, text_col)
    joined = source.join(texts, source["id"].eqNullSafe(texts["doc_id"]) & (source["th"] == texts["text_hash"]))
    return joined.groupBy("id", "th").agg(F.first("word_key").alias("word_key"), F.first("value").alias("value")).select("word_key", "value")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row of each class, with all columns of ``docs``; rows without words all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **parameters).where("is_kept")
    row_id, row_hash, kept_id, kept_hash, worded = (output_name(docs, f"_{n}") for n in ("row_id", "row_hash", "kept_id", "kept_hash", "worded"))
    kept = found.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), F.col("has_words").alias(worded)).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    marked = docs.withColumns({row_id: docs[id_col].cast("long"), row_hash: F.xxhash64(text)})
    joined = marked.join(kept, F.col(row_id).eqNullSafe(F.col(kept_id)) & (F.col(row_hash) == F.col(kept_hash)))
    return joined.where(worded).dropDuplicates([row_id, row_hash]).unionAll(joined.where(~F.col(worded))).select(docs.columns)
