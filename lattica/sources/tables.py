"""The tables of a folder as one property graph.

Vertex ids are a tag of the label times 2^40 plus the key, so they never meet; those of turns are below zero; edges of line items get their id from a hash of
all columns and the number of the copy, since no key of theirs is unique.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import DST, EID, SRC, VID, EdgeTable, Graph

TAGS = {"Region": 1, "Nation": 2, "Customer": 3, "Supplier": 4, "Part": 5, "Order": 6, "Document": 7, "Page": 8, "Vec": 9, "Benchmark": 10, "User": 11, "Event": 12, "Turn": 13}
SHIFT = 1 << 40


def vid(label: str, key: str) -> Column:
    return F.lit(TAGS[label] * SHIFT) + F.col(key).cast("long")


def turn_vid() -> Column:
    """Below zero, so it meets no other label: conv_id * 2^31 + turn, which can't collide; keys out of range are an error."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    outside = (conv < 0) | (conv >= 1 << 32) | (turn < 0) | (turn >= 1 << 31)
    return F.when(outside, F.raise_error(F.lit("conv_id or turn is out of range")).cast("long")).otherwise(-(conv * F.lit(1 << 31) + turn) - 1)


def table_graph(spark: SparkSession, folder: str) -> Graph:
    """Labels and edge types over ``<folder>/<table>.parquet``; a table is opened when a query first uses it."""
    read = cache(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
    g = Graph(spark)

    def vertices(label: str, name: str, key: str) -> DataFrame:
        df = read(name)
        return df.select(vid(label, key).alias(VID), *df.columns)

    for label, name, key in (("Region", "region", "r_regionkey"), ("Nation", "nation", "n_nationkey"), ("Customer", "customer", "c_custkey"), ("Supplier", "supplier", "s_suppkey"), ("Part", "part", "p_partkey"), ("Order", "orders", "o_orderkey"), ("Document", "documents", "doc_id"), ("Page", "pages", "page_id"), ("Vec", "embeddings", "vec_id"), ("Benchmark", "benchmark", "item_id"), ("Event", "events", "event_id")):
        g.nodes.later(label, partial(vertices, label, name, key))
    g.nodes.later("User", lambda: read("events").select("user_id").distinct().select(vid("User", "user_id").alias(VID), "user_id"))

    def link(type_: str, a: tuple[str, str], b: tuple[str, str], rows: Callable[[], DataFrame], eid: Column, *props: str) -> None:
        g.edges.later(type_, lambda: EdgeTable(rows().select(eid.alias(EID), vid(*a).alias(SRC), vid(*b).alias(DST), *props), (a[0],), (b[0],)))

    link("IN_REGION", ("Nation", "n_nationkey"), ("Region", "n_regionkey"), lambda: read("nation"), F.col("n_nationkey").cast("long"))
    link("PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"), lambda: read("orders"), F.lit(2 * SHIFT) + F.col("o_orderkey"))
    link("DID", ("User", "user_id"), ("Event", "event_id"), lambda: read("events"), F.lit(3 * SHIFT) + F.col("event_id"))
    people = lambda: read("customer").select((F.lit(4 * SHIFT) + F.col("c_custkey")).alias(EID), vid("Customer", "c_custkey").alias(SRC), vid("Nation", "c_nationkey").alias(DST))
    firms = lambda: read("supplier").select((F.lit(5 * SHIFT) + F.col("s_suppkey")).alias(EID), vid("Supplier", "s_suppkey").alias(SRC), vid("Nation", "s_nationkey").alias(DST))
    g.edges.later("CUSTOMER_OF", lambda: EdgeTable(people(), ("Customer",), ("Nation",)))
    g.edges.later("SUPPLIER_OF", lambda: EdgeTable(firms(), ("Supplier",), ("Nation",)))
    g.edges.later("IN_NATION", lambda: EdgeTable(people().unionAll(firms()), ("Customer", "Supplier"), ("Nation",)))

    def numbered_items() -> DataFrame:
        items = read("lineitem")
        return items.withColumn("_h", F.xxhash64(*items.columns)).withColumn("_n", F.row_number().over(Window.partitionBy("_h").orderBy(F.lit(1))))

    link("CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey"), numbered_items, F.xxhash64("_h", "_n"), "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    link("SUPPLIED_BY", ("Part", "l_partkey"), ("Supplier", "l_suppkey"), lambda: read("lineitem").select("l_partkey", "l_suppkey").distinct(), F.lit(7 * SHIFT) + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"))
    talk = cache(lambda: read("conversations").select("conv_id", "turn", "role", "text", turn_vid().alias(VID)).dropDuplicates(["conv_id", "turn"]))
    g.nodes.later("Turn", talk)

    def next_turns() -> EdgeTable:
        follow = talk().select("conv_id", (F.col("turn") - 1).alias("turn"), F.col(VID).alias(DST))
        pairs = talk().select("conv_id", "turn", F.col(VID).alias(SRC)).join(follow, ["conv_id", "turn"])
        return EdgeTable(pairs.select(F.col(SRC).alias(EID), SRC, DST), ("Turn",), ("Turn",))

    g.edges.later("NEXT", next_turns)
    return g


def trade_graph(spark: SparkSession, folder: str) -> Graph:
    """Nations as vertices; TRADES joins a customer's nation to its neighbours by key, with weights; small and fixed."""
    g = Graph(spark)
    nations = spark.read.parquet(f"{folder}/nation.parquet").select(F.col("n_nationkey").cast("long").alias(VID), "n_nationkey", "n_name", "n_regionkey")
    g.add_nodes("Nation", nations)
    a, b = nations.select(F.col(VID).alias(SRC)), nations.select(F.col(VID).alias(DST))
    pairs = a.crossJoin(b).where(f"({SRC} * 7 + {DST} * 3) % 11 = 1 and {SRC} <> {DST}")  # 25 x 25 rows
    g.add_edges("TRADES", pairs.select((F.col(SRC) * 100 + F.col(DST)).alias(EID), SRC, DST, ((F.col(SRC) + F.col(DST)) % 5 + 1).cast("double").alias("weight")), "Nation", "Nation")
    forward = pairs.where(f"{SRC} < {DST}")
    g.add_edges("FLOWS", forward.select((F.col(SRC) * 100 + F.col(DST)).alias(EID), SRC, DST, ((F.col(SRC) + F.col(DST)) % 5 + 1).cast("double").alias("weight")), "Nation", "Nation")
    return g


def referral_graph(spark: SparkSession, folder: str) -> Graph:
    """Customers as vertices; REFERS joins the customer of an order to that of the order with the next key, about ten edges each.

    It grows with ``orders``; parallel edges are one, of the least weight, loops are none. FOLLOWS are those to a greater key.
    """
    g = Graph(spark)
    customers = spark.read.parquet(f"{folder}/customer.parquet")
    g.add_nodes("Customer", customers.select(F.col("c_custkey").cast("long").alias(VID), *customers.columns))
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    a = orders.select(F.col("o_orderkey").cast("long").alias(EID), F.col("o_custkey").cast("long").alias(SRC))
    b = orders.select((F.col("o_orderkey").cast("long") - 1).alias("_next"), F.col("o_custkey").cast("long").alias(DST))
    edges = a.join(b, F.col(EID) == F.col("_next")).where(F.col(SRC) != F.col(DST)).groupBy(SRC, DST).agg(F.min(EID).alias(EID), F.min((F.col(EID) % 5 + 1).cast("double")).alias("weight"))
    edges = edges.select(EID, SRC, DST, "weight")
    g.add_edges("REFERS", edges, "Customer", "Customer")
    g.add_edges("FOLLOWS", edges.where(F.col(SRC) < F.col(DST)), "Customer", "Customer")
    return g
