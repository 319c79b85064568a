"""Vector, full-text, sparse and hybrid search as DataFrame plans.

All are exact: a filter comes first, scores are column expressions, the best k are kept by TakeOrdered. Statistics of
full text (document frequency, mean length) are aggregations over the label's whole table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import LABELS, VID
from ..errors import CompileError
from ..functions.scalar import cosine, distance, similarity
from ..storage import keep

K1, B = 1.2, 0.75
STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def analyse(text: Column, tokenizer: str = "simple", lower: bool = True, stop: bool = False, fold: bool = True, stem: bool = False, longest: int = 40, gram: int = 3) -> Column:
    """Terms of a text: simple (letters and digits), whitespace, raw or ngram; folded, stopped and stemmed as asked."""
    c = F.lower(text) if lower else text
    if fold:
        c = F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    if tokenizer == "raw":
        terms = F.array(c)
    elif tokenizer == "whitespace":
        terms = F.split(F.trim(c), r"\s+")
    elif tokenizer == "ngram":
        terms = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - gram + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(gram)))
    else:
        terms = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    terms = F.filter(terms, lambda t: (F.length(t) > 0) & (F.length(t) <= longest))
    if stop:
        terms = F.filter(terms, lambda t: ~t.isin(STOP))
    return F.transform(terms, lambda t: F.regexp_replace(t, r"(?<=\w{3})(ings|ing|edly|ed|es|s|ly)$", "")) if stem else terms


def _occurrences(terms: str, word: str) -> Column:
    return F.size(F.filter(terms, lambda t: t == word))


def bm25(docs: DataFrame, text: Column, query: str, **analyzer) -> DataFrame:
    """(_vid, score) of the rows of ``docs`` (with _vid) that hold a term of the query.

    Texts are read once: a row's length and the counts of the query's terms are written, statistics are one aggregation over
    that table, and a score adds the terms in the query's order, so it doesn't depend on the partitions.
    """
    spark = docs.sparkSession
    wanted = spark.range(1).select(F.array_distinct(analyse(F.lit(query), **analyzer))).first()[0]
    if not wanted:
        return docs.select(VID, F.lit(0.0).alias("score")).limit(0)
    terms = docs.select(VID, analyse(text, **analyzer).alias("terms")).where("terms is not null")
    tf = [_occurrences("terms", w).alias(f"tf{i}") for i, w in enumerate(wanted)]
    counted = keep(terms.select(VID, F.size("terms").alias("dl"), *tf), "bm25")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n, df, tf = stats["n"], stats[f"df{i}"], F.col(f"tf{i}")
        score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / (stats["mean"] or 1.0)))
    return counted.where(F.greatest(*[F.col(f"tf{i}") for i in range(len(wanted))], F.lit(0)) > 0).select(VID, score.alias("score"))


def _label(ctx, label: str) -> DataFrame:
    df = ctx.graph.scan_nodes([[label]])
    if ctx.graph.resolve_label(label) is None:
        raise CompileError(f"no label {label}")
    return df


def _filtered(ctx, df: DataFrame, condition) -> DataFrame:
    """Rows that meet a filter: an expression's text over the property names, or a map of equal values."""
    if condition is None:
        return df
    if isinstance(condition, dict):
        return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), condition.items(), df)
    from ..cypher.compiler import Expressions
    from ..cypher.parser import Parser
    from ..cypher.scope import Entry, State

    scope = {c: Entry("value", c) for c in df.columns}
    return df.where(Expressions(ctx, State(df, scope)).boolean(Parser(condition).expr()))


def _node(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns if c in (VID, LABELS) or not c.startswith("_")]).alias("node")


def vector_query(ctx, args) -> DataFrame:
    """label, property, query vector, k[, filter][, threshold][, options]: the k nearest; threshold is a greatest distance.

    All rows are compared, but where the option ``nprobes`` asks for that many cells of the property's index.
    """
    label, prop, query, k = args[:4]
    condition, threshold, options = (args[4:] + [None] * 3)[:3]
    if isinstance(condition, dict) and options is None and ({"metric", "reranker"} & set(condition)):
        condition, options = None, condition
    options = options or {}
    metric = options.get("metric", "cosine")
    df = _filtered(ctx, _label(ctx, label), condition).where(F.col(prop).isNotNull())
    q = F.array(*[F.lit(float(x)) for x in query]) if not isinstance(query[0], (list, tuple)) else None
    if q is None:
        if options.get("muvera"):
            df = muvera_candidates(df, prop, query, int(k) * int(options.get("over_fetch", 10)))
        return maxsim_query(ctx, df, prop, query, k)
    if options.get("nprobes") and (cells := indexed_cells(ctx, label, prop, metric)) is not None:
        near = cells.candidates([float(x) for x in query], int(options["nprobes"])).select(F.col(VID).alias("_near"))
        df = df.join(near, F.col(VID) == F.col("_near"), "left_semi")
    scored = df.withColumn("distance", distance(F.col(prop), q, metric))
    if threshold is not None:
        scored = scored.where(F.col("distance") <= threshold)
    best = scored.orderBy("distance", VID).limit(int(k))
    out = best.select(F.col(VID).alias("vid"), "distance", similarity(F.col("distance"), metric).alias("score"), F.lit(None).cast("double").alias("rerank_score"), _node(df))
    return out


def indexed_cells(ctx, label: str, prop: str, metric: str):
    """The cells of an index over the label's present table, if there is one of that metric."""
    for index in ctx.graph.indexes:
        cells = index.get("cells")
        if cells is not None and index["label"] == label and index["props"][0] == prop and cells.metric == metric and cells.source is ctx.graph.nodes.get(label):
            return cells
    return None


def maxsim(doc: Column, query: list[list[float]]) -> Column:
    """Sum over the query's vectors of their best cosine with one of the document's."""

    def best(vector: list[float]) -> Column:
        q = F.array(*[F.lit(float(x)) for x in vector])
        return F.array_max(F.transform(doc, lambda d: cosine(d, q)))

    return reduce(lambda a, b: a + b, map(best, query))


def muvera_candidates(df: DataFrame, prop: str, query, fetch: int) -> DataFrame:
    """The ``fetch`` rows whose fixed encodings have the greatest product with the query's."""
    from ..functions.scalar import dot
    from .ann import fixed_encoding

    size = len(query[0])
    one = df.sparkSession.createDataFrame([([[float(x) for x in v] for v in query],)], "q array<array<double>>").select(fixed_encoding(F.col("q"), size, query=True).alias("e")).first()[0]
    encoded = df.select(VID, fixed_encoding(F.col(prop).cast("array<array<double>>"), size).alias("_e"))
    best = encoded.orderBy(dot(F.col("_e"), F.array(*[F.lit(x) for x in one])).desc(), VID).limit(fetch).select(F.col(VID).alias("_near"))
    return df.join(best, F.col(VID) == F.col("_near"), "left_semi")


def maxsim_query(ctx, df: DataFrame, prop: str, query, k) -> DataFrame:
    scored = df.withColumn("score", maxsim(F.col(prop), query)).orderBy(F.col("score").desc(), VID).limit(int(k))
    return scored.select(F.col(VID).alias("vid"), (-F.col("score")).alias("distance"), "score", F.col("score").alias("rerank_score"), _node(df))


def fts_query(ctx, args) -> DataFrame:
    """label, property, text, k[, threshold]: BM25 divided by the best score; scores that agree in nine digits are ties.

    Where k is null, all rows that hold a term and reach the threshold are found.
    """
    label, prop, query, k = args[:4]
    threshold = args[4] if len(args) > 4 else None
    df = _label(ctx, label)
    scored = bm25(df, F.col(prop), query)
    best = scored.agg(F.max("score").alias("top"))
    out = scored.crossJoin(F.broadcast(best)).select(VID, F.round(F.col("score") / F.col("top"), 9).alias("score"))
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    found = (out if k is None else out.orderBy(F.col("score").desc(), VID).limit(int(k))).select(F.col(VID).alias("vid"), "score")
    return df.join(found if k is None else F.broadcast(found), F.col(VID) == F.col("vid")).select("vid", "score", _node(df))  # k rows at most are broadcast


def sparse_query(ctx, args) -> DataFrame:
    """label, property, {indices, values}, k: greatest dot products, by a join on the query's indices."""
    label, prop, query, k = args[:4]
    threshold = args[4] if len(args) > 4 else None
    df = _label(ctx, label)
    wanted = ctx.spark.createDataFrame([(int(i), float(v)) for i, v in zip(query["indices"], query["values"], strict=True)], "i int, qv double")
    terms = df.select(VID, F.explode(F.arrays_zip(F.col(prop)["indices"].alias("indices"), F.col(prop)["values"].alias("values"))).alias("t")).select(VID, F.col("t.indices").alias("i"), F.col("t.values").cast("double").alias("v"))
    scored = terms.join(F.broadcast(wanted), "i").groupBy(VID).agg(F.sum(F.col("v") * F.col("qv")).alias("score"))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    top = scored.orderBy(F.col("score").desc(), VID).limit(int(k))
    return df.join(F.broadcast(top.select(F.col(VID).alias("vid"), "score")), F.col(VID) == F.col("vid")).select("vid", "score", _node(df))


def fuse(arms: dict[str, DataFrame], method: str = "rrf", weights: dict[str, float] | None = None, constant: int = 60) -> DataFrame:
    """(vid, score and each arm's score) of ranked lists (vid, score[, distance]).

    rrf: sum of 1 / (constant + rank); weighted: scores scaled by their arm's extremes; dbsf: standard scores.
    The lists have over-fetched length, so a window over one of them is a bounded sort.
    """
    weights = weights or dict.fromkeys(arms, 1.0)
    parts = []
    for name, df in arms.items():
        every = Window.partitionBy(F.lit(1))
        if method == "rrf":
            part = 1 / (constant + F.row_number().over(every.orderBy(F.col("score").desc(), "vid")))
        elif method == "weighted":
            low, high = F.min("distance").over(every) if "distance" in df.columns else None, F.max("distance").over(every) if "distance" in df.columns else None
            if low is not None:
                part = F.when(high == low, F.lit(1.0)).otherwise(1 - (F.col("distance") - low) / F.nullif(high - low, F.lit(0.0)))
            else:
                part = F.coalesce(F.col("score") / F.nullif(F.max("score").over(every), F.lit(0.0)), F.lit(0.0))
            part = part * weights.get(name, 0.0)
        elif method == "dbsf":
            sd = F.stddev_pop("score").over(every)
            part = F.when(sd == 0, F.lit(0.0)).otherwise((F.col("score") - F.avg("score").over(every)) / F.nullif(sd, F.lit(0.0))) * weights.get(name, 1.0)
        else:
            raise CompileError(f"unknown fusion {method}")
        parts.append(df.select("vid", F.lit(name).alias("arm"), F.col("score").alias("own"), part.alias("part"), (F.col("distance") if "distance" in df.columns else F.lit(None).cast("double")).alias("distance")))
    rows = reduce(DataFrame.unionAll, parts)
    own = [F.max(F.when(F.col("arm") == n, F.col("own"))).alias(f"{n}_score") for n in ("vector", "fts", "sparse")]
    return rows.groupBy("vid").agg(F.sum("part").alias("score"), *own, F.max("distance").alias("distance"))


def hybrid(ctx, args) -> DataFrame:
    """label, {vector, fts, sparse}, text, vector, k[, filter][, options]."""
    label, props, text, vector, k = args[:5]
    condition, options = (args[5:] + [None] * 2)[:2]
    options = options or {}
    fetch = max(int(k), int(round(k * options.get("over_fetch", 2.0))))
    arms = {}
    if props.get("vector") and vector is not None:
        arms["vector"] = vector_query(ctx, [label, props["vector"], vector, fetch, condition]).select("vid", "score", "distance")
    if props.get("fts") and text is not None:
        arms["fts"] = fts_query(ctx, [label, props["fts"], text, fetch]).select("vid", "score")
    if props.get("sparse") and options.get("sparse_query"):
        arms["sparse"] = sparse_query(ctx, [label, props["sparse"], options["sparse_query"], fetch]).select("vid", "score")
    if not arms:
        raise CompileError("nothing to search with")
    alpha = options.get("alpha", 0.5)
    listed = options.get("weights")
    weights = dict(zip(("vector", "fts", "sparse"), listed, strict=False)) if listed else {"vector": alpha, "fts": 1 - alpha, "sparse": 1.0}
    fused = fuse(arms, options.get("method", "rrf"), weights)
    df = _filtered(ctx, _label(ctx, label), condition)
    top = fused.orderBy(F.col("score").desc(), "vid").limit(int(k))
    joined = df.join(F.broadcast(top), F.col(VID) == F.col("vid"), "inner")
    return joined.select("vid", "score", F.lit(None).cast("double").alias("rerank_score"), "vector_score", "fts_score", "sparse_score", "distance", _node(df))


def embed(text: Column, size: int = 64) -> Column:
    """Deterministic hashing embedding, for tests and as a default model: signed counts of hashed terms, unit length."""
    terms = analyse(text)
    slots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.filter(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(size)) == i), F.lit(0.0), lambda s, t: s + F.when(F.pmod(F.hash(t), F.lit(2)) == 0, 1.0).otherwise(-1.0)))
    norm = F.sqrt(F.aggregate(slots, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(slots, lambda x: F.when(norm > 0, x / F.nullif(norm, F.lit(0.0))).otherwise(0.0))


def words(ctx, args) -> DataFrame:
    """label, property: (vid, position, word) of each text."""
    df = _label(ctx, args[0])
    return df.select(F.col(VID).alias("vid"), F.posexplode(F.regexp_extract_all(F.col(args[1]), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("position", "word"))


def sentences(ctx, args) -> DataFrame:
    """label, property: (vid, position, sentence) of each text."""
    df = _label(ctx, args[0])
    parts = F.filter(F.split(F.col(args[1]), r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)
    return df.select(F.col(VID).alias("vid"), F.posexplode(parts).alias("position", "sentence"))


def entities(ctx, args) -> DataFrame:
    """label, property: (vid, entity, kind, start) found by rules: addresses, numbers, capitalised runs."""
    df = _label(ctx, args[0])
    kinds = {"email": r"([\w.+-]+@[\w-]+\.[\w.]+)", "url": r"(https?://\S+)", "number": r"(\b\d+(?:\.\d+)?\b)", "name": r"(\b\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"}
    parts = [df.select(F.col(VID).alias("vid"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(args[1]), F.lit(p), F.lit(1)))).alias("entity"), F.lit(k).alias("kind")) for k, p in kinds.items()]
    return reduce(DataFrame.unionAll, parts).join(df.select(F.col(VID).alias("_v"), F.col(args[1]).alias("_t")), F.col("vid") == F.col("_v")).select("vid", "entity", "kind", (F.instr(F.col("_t"), F.col("entity")) - 1).alias("start"))


PROCEDURES = {"uni.vector.query": vector_query, "uni.fts.query": fts_query, "uni.sparse.query": sparse_query, "uni.search": hybrid, "uni.nlp.words": words, "uni.nlp.sentences": sentences, "uni.nlp.entities": entities, "uni.nlp.extract": entities}
