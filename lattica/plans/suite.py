"""Queries over the graph of the tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Graph
from ..session import Session
from ..sources.tables import referral_graph, table_graph, trade_graph

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
TRADES = "e AS (SELECT a.n_nationkey::BIGINT AS s, b.n_nationkey::BIGINT AS d, ((a.n_nationkey + b.n_nationkey) % 5 + 1)::DOUBLE AS w FROM nation a, nation b WHERE (a.n_nationkey * 7 + b.n_nationkey * 3) % 11 = 1 AND a.n_nationkey <> b.n_nationkey), v AS (SELECT n_nationkey::BIGINT AS id FROM nation)"
HOPS = f"WITH RECURSIVE {TRADES}, h(s, n, k) AS (SELECT id, id, 0 FROM v UNION SELECT h.s, e.d, h.k + 1 FROM h JOIN e ON h.n = e.s WHERE h.k < 25), dist AS (SELECT s, n, min(k) AS k FROM h GROUP BY ALL) "


def cypher(name: str, text: str, sql: str | None = None, graph=table_graph, **params) -> None:
    """Register a query text."""
    _QUERIES[name] = lambda spark, folder: Session(graph(spark, folder)).query(text, **params)
    if sql:
        _SQL[name] = sql


def rules(name: str, text: str, sql: str | None = None, graph=table_graph) -> None:
    """Register a rule program; its last command's rows are the result."""
    _QUERIES[name] = lambda spark, folder: Session(graph(spark, folder)).rules_program(text).rows()
    if sql:
        _SQL[name] = sql


def plain(name: str, function: Query, sql: str | None = None) -> None:
    _QUERIES[name] = function
    if sql:
        _SQL[name] = sql


def trade(name: str, text: str, sql: str | None = None, **params) -> None:
    cypher(name, text, sql, trade_graph, **params)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- scans and patterns -----------------------------------------------------------------------------------------
cypher("cypher_segment_revenue", "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.o_totalprice > $x RETURN c.c_mktsegment AS seg, count(o) AS n, round(sum(o.o_totalprice), 2) AS total ORDER BY total DESC LIMIT 5", "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY total DESC LIMIT 5", x=1000.0)
cypher("scan_label_filter", "MATCH (p:Part) WHERE p.p_size > 40 AND p.p_brand STARTS WITH 'Brand' RETURN p.p_partkey AS k, p.p_name AS name", "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_size > 40 AND starts_with(p_brand, 'Brand')")
cypher("scan_label_disjunction", "MATCH (n:Customer|Supplier) RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier")
cypher("scan_unlabelled", "MATCH (n) WHERE n.n_name IS NOT NULL OR n.r_name IS NOT NULL RETURN coalesce(n.n_name, n.r_name) AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
cypher("scan_edges", "MATCH ()-[r:CONTAINS]->() RETURN r.l_returnflag AS flag, count(*) AS n, round(avg(r.l_quantity), 6) AS q", "SELECT l_returnflag AS flag, count(*) AS n, round(avg(l_quantity), 6) AS q FROM lineitem GROUP BY 1")
cypher("scan_edge_disjunction", "MATCH (a)-[r:CUSTOMER_OF|SUPPLIER_OF]->(b:Nation) RETURN b.n_name AS name, type(r) AS t, count(*) AS n", "SELECT n_name AS name, 'CUSTOMER_OF' AS t, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT n_name, 'SUPPLIER_OF', count(*) FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
cypher("pattern_two_hops", "MATCH (c:Customer)-[:PLACED]->(o:Order)-[r:CONTAINS]->(p:Part) WHERE p.p_size = 1 RETURN c.c_custkey AS c, count(r) AS n, sum(r.l_quantity) AS q", "SELECT o_custkey AS c, count(*) AS n, sum(l_quantity) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size = 1 GROUP BY 1")
cypher("pattern_both_directions", "MATCH (n:Nation {n_nationkey: 3})--(x) RETURN labels(x)[0] AS label, count(*) AS n", "SELECT 'Region' AS label, 1 AS n UNION ALL SELECT 'Customer', 2 * count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'Supplier', 2 * count(*) FROM supplier WHERE s_nationkey = 3 HAVING count(*) > 0")
cypher("pattern_trail", "MATCH (p:Part {p_partkey: 7})<-[a:CONTAINS]-(o:Order)-[b:CONTAINS]->(q:Part) RETURN count(*) AS n", "WITH l AS (SELECT *, row_number() OVER () AS id FROM lineitem) SELECT count(*) AS n FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.id <> b.id WHERE a.l_partkey = 7")
cypher("optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.o_orderstatus = 'F' WITH c, count(o) AS k RETURN k, count(*) AS n", "SELECT k, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY 1) GROUP BY 1")
cypher("exists_subquery", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.o_totalprice > 400000 } RETURN count(c) AS n", "SELECT count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
cypher("count_subquery", "MATCH (c:Customer) RETURN c.c_custkey AS c, COUNT { (c)-[:PLACED]->() } AS k", "SELECT c_custkey AS c, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
cypher("collect_subquery", "MATCH (n:Nation) RETURN n.n_name AS name, size(COLLECT { MATCH (n)<-[:CUSTOMER_OF]-(c) WHERE c.c_acctbal > 9000 RETURN c.c_custkey }) AS k", "SELECT n_name AS name, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
cypher("pattern_comprehension", "MATCH (r:Region) RETURN r.r_name AS region, apoc.coll.sort([(r)<-[:IN_REGION]-(n) | n.n_nationkey])[0] AS first", "SELECT r_name AS region, min(n_nationkey) AS first FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
cypher("call_subquery_top", "MATCH (s:Supplier) CALL { WITH s MATCH (s)<-[:SUPPLIED_BY]-(p:Part) RETURN p.p_partkey AS part ORDER BY p.p_retailprice DESC, part LIMIT 2 } RETURN s.s_suppkey AS s, part", "SELECT s_suppkey AS s, p_partkey AS part FROM (SELECT s_suppkey, p_partkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_retailprice DESC, p_partkey) AS r FROM supplier JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey) WHERE r <= 2")
cypher("cross_product_theta", "MATCH (a:Nation), (b:Region) WHERE a.n_regionkey > b.r_regionkey RETURN b.r_name AS r, count(*) AS n", "SELECT r_name AS r, count(*) AS n FROM nation, region WHERE n_regionkey > r_regionkey GROUP BY 1")
cypher("union_distinct", "MATCH (c:Customer) RETURN c.c_nationkey AS k UNION MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
cypher("union_all", "MATCH (c:Customer) WHERE c.c_acctbal < 0 RETURN c.c_nationkey AS k UNION ALL MATCH (s:Supplier) RETURN s.s_nationkey AS k", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier")
cypher("vlp_bounded", "MATCH (t:Turn {turn: 0})-[:NEXT*1..3]->(u:Turn) RETURN u.turn AS turn, count(*) AS n", "WITH t AS (SELECT DISTINCT conv_id, turn FROM conversations), n AS (SELECT a.conv_id, a.turn FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1) SELECT k AS turn, count(*) AS n FROM t, (SELECT unnest([1, 2, 3]) AS k) x WHERE turn = 0 AND (SELECT count(*) FROM n WHERE n.conv_id = t.conv_id AND n.turn < k) = k GROUP BY 1")
trade("quantified_path", "MATCH (a:Nation {n_nationkey: 0}) ((x)-[:TRADES]->(y)){2} (b:Nation) RETURN b.n_nationkey AS b, size(x) AS k, count(*) AS n", f"WITH {TRADES} SELECT y.d::INTEGER AS b, 2::BIGINT AS k, count(*) AS n FROM e x JOIN e y ON x.d = y.s AND NOT (x.s = y.s AND x.d = y.d) WHERE x.s = 0 GROUP BY 1")
trade("path_functions", "MATCH p = (a:Nation {n_nationkey: 0})-[:TRADES]->(b)-[:TRADES]->(c) RETURN length(p) AS len, [n IN nodes(p) | n._vid][1] AS mid, c.n_nationkey AS c", f"WITH {TRADES} SELECT 2::BIGINT AS len, x.d AS mid, y.d::INTEGER AS c FROM e x JOIN e y ON x.d = y.s AND NOT (x.s = y.s AND x.d = y.d) WHERE x.s = 0")
cypher("with_recursive", "WITH RECURSIVE up(n) AS (UNWIND [1] AS n RETURN n UNION MATCH (r:up) WHERE r.n < 20 RETURN r.n + r.n % 3 + 1 AS n) MATCH (u:up) RETURN u.n AS n", "WITH RECURSIVE up(n) AS (SELECT 1::BIGINT UNION SELECT n + n % 3 + 1 FROM up WHERE n < 20) SELECT n FROM up")
cypher("order_skip_limit", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY p DESC, k SKIP 5 LIMIT 10", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k LIMIT 10 OFFSET 5")
cypher("distinct_pairs", "MATCH (o:Order) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
cypher("unwind_aggregate", "UNWIND range(1, 100) AS x WITH x WHERE x % 3 = 0 RETURN sum(x) AS s, count(*) AS n, collect(x)[1] AS second", "SELECT sum(x)::BIGINT AS s, count(*) AS n, 6::BIGINT AS second FROM range(1, 101) t(x) WHERE x % 3 = 0")

# --- expressions ------------------------------------------------------------------------------------------------
cypher("expr_strings", "MATCH (n:Nation) RETURN n.n_nationkey AS k, toLower(n.n_name) AS low, substring(n.n_name, 1, 3) AS sub, split(n.n_name, '_')[1] AS part, replace(n.n_name, 'N', 'M') AS rep, reverse(n.n_name) AS rev, size(n.n_name) AS len, lpad(n.n_name, 12, '*') AS pad, n.n_name =~ '.*_1.' AS m, n.n_name + '-' + n.n_nationkey AS cat", "SELECT n_nationkey AS k, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, string_split(n_name, '_')[2] AS part, replace(n_name, 'N', 'M') AS rep, reverse(n_name) AS rev, length(n_name) AS len, lpad(n_name, 12, '*') AS pad, regexp_full_match(n_name, '.*_1.') AS m, n_name || '-' || n_nationkey AS cat FROM nation")
cypher("expr_math", "MATCH (p:Part) RETURN p.p_partkey AS k, abs(p.p_size - 25) AS a, ceil(p.p_retailprice) AS c, floor(p.p_retailprice) AS f, round(sqrt(p.p_retailprice), 4) AS s, p.p_size % 7 AS m, p.p_size / 7 AS d, round(log10(p.p_retailprice), 5) AS l, round(p.p_size ^ 2, 2) AS sq, sign(p.p_size - 25) AS sg", "SELECT p_partkey AS k, abs(p_size - 25)::BIGINT AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_retailprice), 4) AS s, (p_size % 7)::BIGINT AS m, (p_size // 7)::BIGINT AS d, round(log10(p_retailprice), 5) AS l, round(p_size::DOUBLE ** 2, 2) AS sq, sign(p_size - 25)::BIGINT AS sg FROM part")
cypher("expr_trig_bits", "UNWIND range(0, 12) AS x RETURN x, round(sin(x), 6) AS s, round(atan2(x, 2), 6) AS a, round(haversin(x), 6) AS h, round(degrees(x), 4) AS d, bitwise_and(x, 6) AS b, bitwise_xor(x, 5) AS o, shift_left(x, 2) AS l, bitwise_not(x) AS n", "SELECT x::BIGINT AS x, round(sin(x), 6) AS s, round(atan2(x, 2), 6) AS a, round((1 - cos(x)) / 2, 6) AS h, round(degrees(x), 4) AS d, (x & 6)::BIGINT AS b, xor(x, 5)::BIGINT AS o, (x << 2)::BIGINT AS l, (~x)::BIGINT AS n FROM range(0, 13) t(x)")
cypher("expr_lists", "UNWIND range(0, 6) AS x WITH x, range(0, x) AS l RETURN x, size(l) AS n, head(l) AS h, last(l) AS la, [i IN l WHERE i % 2 = 0 | i * i] AS sq, l[1..3] AS sl, l[-1] AS neg, reduce(s = 0, i IN l | s + i) AS total, all(i IN l WHERE i < 5) AS al, any(i IN l WHERE i = 4) AS an, single(i IN l WHERE i = 2) AS si, none(i IN l WHERE i > 9) AS no, x IN [1, 3] AS isin", "WITH t AS (SELECT x::BIGINT AS x, range(0, x + 1) AS l FROM range(0, 7) r(x)) SELECT x, len(l) AS n, l[1] AS h, l[-1] AS la, list_transform(list_filter(l, lambda i: i % 2 = 0), lambda i: i * i) AS sq, l[2:3] AS sl, l[-1] AS neg, list_sum(l)::BIGINT AS total, x < 5 AS al, x >= 4 AS an, x >= 2 AS si, true AS no, x IN (1, 3) AS isin FROM t")
cypher("expr_case_coalesce", "MATCH (c:Customer) RETURN CASE c.c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code, CASE WHEN c.c_acctbal < 0 THEN 'debt' WHEN c.c_acctbal > 5000 THEN 'rich' ELSE 'ok' END AS kind, count(*) AS n", "SELECT (CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END)::BIGINT AS code, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'ok' END AS kind, count(*) AS n FROM customer GROUP BY ALL")
cypher("expr_conversion", "MATCH (n:Nation) RETURN n.n_nationkey AS k, toInteger(split(n.n_name, '_')[1]) AS i, toInteger(n.n_name) AS bad, toFloat('1.5') AS f, toString(n.n_nationkey) AS s, toBoolean('TRUE') AS b, toInteger(7.9) AS t", "SELECT n_nationkey AS k, string_split(n_name, '_')[2]::BIGINT AS i, NULL::BIGINT AS bad, 1.5::DOUBLE AS f, n_nationkey::VARCHAR AS s, true AS b, 7::BIGINT AS t FROM nation")
cypher("expr_map_projection", "MATCH (n:Nation) WITH n {.n_name, key: n.n_nationkey} AS m RETURN m.n_name AS name, m.key AS key", "SELECT n_name AS name, n_nationkey AS key FROM nation")
cypher("expr_json_property", "MATCH (e:Event) RETURN toInteger(e.props.k) % 10 AS bucket, count(*) AS n", "SELECT json_extract_string(props, '$.k')::BIGINT % 10 AS bucket, count(*) AS n FROM events GROUP BY 1")
cypher("expr_spatial", "UNWIND [[0.0, 0.0], [10.0, 20.0], [13.4, 52.5]] AS p WITH point({longitude: p[0], latitude: p[1]}) AS a, point({longitude: 2.35, latitude: 48.85}) AS b RETURN round(distance(a, b), 2) AS m, point.withinBBox(a, point({longitude: 5.0, latitude: 10.0}), point({longitude: 15.0, latitude: 60.0})) AS inside", "WITH p AS (SELECT * FROM (VALUES (0.0, 0.0), (10.0, 20.0), (13.4, 52.5)) t(x, y)) SELECT round(2 * 6371000.0 * asin(sqrt(sin(radians(48.85 - y) / 2) ** 2 + cos(radians(y)) * cos(radians(48.85)) * sin(radians(2.35 - x) / 2) ** 2)), 2) AS m, x BETWEEN 5 AND 15 AND y BETWEEN 10 AND 60 AS inside FROM p")
cypher("expr_temporal", "MATCH (o:Order) RETURN o.o_orderkey AS k, o.o_orderdate.year AS y, o.o_orderdate.month AS m, o.o_orderdate.dayOfWeek AS dow, toString(date(o.o_orderdate) + duration('P1M10D')) AS later, duration.inDays(date('1992-01-01'), date(o.o_orderdate)).days AS days", "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) AS dow, strftime(o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 10 DAY, '%Y-%m-%d') AS later, o_orderdate::DATE - DATE '1992-01-01' AS days FROM orders")
cypher("expr_valid_at", "MATCH (o:Order)-[r:CONTAINS]->() WHERE uni.temporal.validAt(o.o_orderdate, r.l_shipdate, localdatetime('1995-06-15T00:00:00')) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1995-06-15' AND (l_shipdate IS NULL OR l_shipdate > TIMESTAMP '1995-06-15')")
cypher("expr_btic", "UNWIND range(0, 5) AS x WITH x, btic(x * 10, x * 10 + 25) AS a, btic(20, 40) AS b RETURN x, btic_overlaps(a, b) AS o, btic_before(a, b) AS f, btic_during(a, b) AS d, btic_intersection(a, b).lo AS lo, btic_duration(btic_span(a, b)) AS span, btic_granularity(btic('1985-03')) AS g", "SELECT x::BIGINT AS x, x * 10 < 40 AND 20 < x * 10 + 25 AS o, x * 10 + 25 <= 20 AS f, x * 10 > 20 AND x * 10 + 25 < 40 AS d, CASE WHEN x * 10 < 40 AND 20 < x * 10 + 25 THEN greatest(x * 10, 20) END AS lo, greatest(x * 10 + 25, 40) - least(x * 10, 20) AS span, 'month' AS g FROM range(0, 6) t(x)")

# --- aggregates and windows -------------------------------------------------------------------------------------
cypher("agg_statistics", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, round(stDev(c.c_acctbal), 4) AS sd, round(stDevP(c.c_acctbal), 4) AS sdp, round(variance(c.c_acctbal), 2) AS var, min(c.c_acctbal) AS lo, max(c.c_acctbal) AS hi, count(DISTINCT c.c_nationkey) AS nations", "SELECT c_mktsegment AS s, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sdp, round(var_samp(c_acctbal), 2) AS var, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
cypher("agg_percentiles", "MATCH (p:Part) RETURN p.p_brand AS b, round(percentileCont(p.p_retailprice, 0.4), 4) AS cont, percentileDisc(p.p_size, 0.5) AS disc", "SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.4), 4) AS cont, list_sort(list(p_size))[round(0.5 * (count(*) - 1))::INTEGER + 1] AS disc FROM part GROUP BY 1")
cypher("agg_collect_distinct", "MATCH (s:Supplier) RETURN s.s_nationkey AS n, size(collect(DISTINCT s.s_acctbal > 0)) AS kinds, sum(DISTINCT s.s_suppkey % 5) AS sd", "SELECT s_nationkey AS n, count(DISTINCT s_acctbal > 0) AS kinds, sum(DISTINCT s_suppkey % 5)::BIGINT AS sd FROM supplier GROUP BY 1")
cypher("agg_empty", "MATCH (c:Customer) WHERE c.c_acctbal > 1e12 RETURN sum(c.c_acctbal) AS s, avg(c.c_acctbal) AS a, count(*) AS n, size(collect(c.c_name)) AS l", "SELECT 0.0::DOUBLE AS s, NULL::DOUBLE AS a, 0::BIGINT AS n, 0::BIGINT AS l")
cypher("window_ranking", "MATCH (c:Customer) RETURN c.c_custkey AS k, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS rn, rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_mktsegment) AS dr, ntile(4) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS nt", "SELECT c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS dr, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nt FROM customer")
cypher("window_values", "MATCH (c:Customer) RETURN c.c_custkey AS k, lag(c.c_custkey, 1, -1) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS lg, lead(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS ld, first_value(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS fv, last_value(c.c_custkey) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS lv, nth_value(c.c_custkey, 2) OVER (PARTITION BY c.c_nationkey ORDER BY c.c_custkey) AS nv", "SELECT c_custkey AS k, lag(c_custkey, 1, -1) OVER w AS lg, lead(c_custkey) OVER w AS ld, first_value(c_custkey) OVER f AS fv, last_value(c_custkey) OVER f AS lv, nth_value(c_custkey, 2) OVER f AS nv FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey), f AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
cypher("window_aggregates", "MATCH (s:Supplier) RETURN s.s_suppkey AS k, sum(s.s_suppkey) OVER (PARTITION BY s.s_nationkey ORDER BY s.s_suppkey) AS running, count(*) OVER (PARTITION BY s.s_nationkey) AS n, count(DISTINCT s.s_nationkey) OVER () AS nations, max(s.s_acctbal) OVER (PARTITION BY s.s_nationkey) AS top", "SELECT s_suppkey AS k, sum(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::BIGINT AS running, count(*) OVER (PARTITION BY s_nationkey) AS n, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS nations, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM supplier")
cypher("window_top_per_group", "MATCH (c:Customer) WITH c, row_number() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey) AS rn WHERE rn <= 3 RETURN c.c_nationkey AS n, c.c_custkey AS k, rn", "SELECT c_nationkey AS n, c_custkey AS k, rn FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
cypher("window_over_groups", "MATCH (c:Customer) RETURN c.c_mktsegment AS s, count(*) AS n, rank() OVER (ORDER BY c.c_mktsegment) AS r", "SELECT c_mktsegment AS s, count(*) AS n, rank() OVER (ORDER BY c_mktsegment) AS r FROM customer GROUP BY 1")

# --- algorithms -------------------------------------------------------------------------------------------------
AP = "['Nation'], ['TRADES']"


def iterated(rounds: int, start: str, step: str, digits: int = 8) -> str:
    """SQL of a fixed number of power-iteration rounds."""
    parts = [f"WITH {TRADES}", f"it0 AS MATERIALIZED (SELECT id, {start} AS x FROM v)"]
    for i in range(1, rounds + 1):
        parts.append(f"it{i} AS MATERIALIZED ({step.format(prev=f'it{i - 1}')})")
    return ", ".join(parts) + f" SELECT id AS nodeId, round(x, {digits}) AS score FROM it{rounds}"


trade("algo_closeness", f"CALL uni.algo.closeness({AP}, true) YIELD nodeId, score RETURN nodeId, round(score, 8) AS score", HOPS + "SELECT id AS nodeId, round(coalesce((SELECT count(*) ** 2 / (24.0 * sum(k)) FROM dist WHERE s = id AND n <> id), 0), 8) AS score FROM v")
trade("algo_harmonic", f"CALL uni.algo.harmonicCentrality({AP}) YIELD nodeId, centrality RETURN nodeId, round(centrality, 8) AS c", HOPS + "SELECT id AS nodeId, round(coalesce((SELECT sum(1.0 / k) FROM dist WHERE s = id AND n <> id), 0), 8) AS c FROM v")
trade("algo_all_pairs", f"CALL uni.algo.allPairsShortestPath({AP}) YIELD sourceNodeId, targetNodeId, distance RETURN sourceNodeId AS s, targetNodeId AS t, distance AS d", HOPS + "SELECT s, n AS t, k::DOUBLE AS d FROM dist WHERE s <> n")
trade("algo_metrics", f"CALL uni.algo.metrics({AP}) YIELD diameter, radius, center RETURN diameter, radius, size(center) AS centers", HOPS + ", ecc AS (SELECT s, max(k)::DOUBLE AS k FROM dist GROUP BY 1) SELECT max(k) AS diameter, min(k) AS radius, (SELECT count(*) FROM ecc x WHERE x.k = (SELECT min(k) FROM ecc)) AS centers FROM ecc")
trade("algo_diameter", f"CALL uni.algo.diameter({AP}) YIELD diameter, path RETURN diameter, size(path) AS n", HOPS + "SELECT max(k)::DOUBLE AS diameter, max(k)::BIGINT + 1 AS n FROM dist")
WALK = f"WITH RECURSIVE {TRADES}, r(n, c) AS (SELECT 0::BIGINT, 0.0::DOUBLE UNION SELECT e.d, r.c + e.w FROM r JOIN e ON r.n = e.s WHERE r.c + e.w <= 60) "
trade("algo_topological_order", "CALL uni.algo.topoSort(['Nation'], ['FLOWS']) YIELD nodeId, order RETURN nodeId, order AS o", f"WITH RECURSIVE {TRADES}, f AS (SELECT s, d FROM e WHERE s < d), l(n, k) AS (SELECT id, 0 FROM v UNION SELECT f.d, l.k + 1 FROM l JOIN f ON l.n = f.s) SELECT n AS nodeId, row_number() OVER (ORDER BY max(k), n) - 1 AS o FROM l GROUP BY n")
trade("algo_has_cycle", f"CALL uni.algo.hasCycle({AP}) YIELD hasCycle RETURN hasCycle", f"WITH RECURSIVE {TRADES}, r AS (SELECT s, d FROM e UNION SELECT r.s, e.d FROM r JOIN e ON r.d = e.s) SELECT count(*) > 0 AS hasCycle FROM r WHERE s = d")
trade("algo_bipartite", f"CALL uni.algo.isBipartite({AP}) YIELD isBipartite RETURN isBipartite", f"WITH RECURSIVE {TRADES}, u AS (SELECT s, d FROM e UNION SELECT d, s FROM e), r AS (SELECT id AS a, id AS b, 0 AS p FROM v UNION SELECT r.a, u.d, 1 - r.p FROM r JOIN u ON r.b = u.s) SELECT count(*) = 0 AS isBipartite FROM r WHERE a = b AND p = 1")
CORE = f"WITH RECURSIVE {TRADES}, u AS (SELECT s, d FROM e UNION SELECT d, s FROM e)"
trade("algo_bridges", f"CALL uni.algo.bridges({AP}) YIELD source, target RETURN source, target", CORE + ", b AS (SELECT s, d FROM u WHERE s < d), r AS (SELECT b.s AS x, b.d AS y, b.s AS n FROM b UNION SELECT r.x, r.y, u.d FROM r JOIN u ON r.n = u.s WHERE NOT (least(u.s, u.d) = r.x AND greatest(u.s, u.d) = r.y)) SELECT s AS source, d AS target FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.x = b.s AND r.y = b.d AND r.n = b.d)")
trade("algo_betweenness", f"CALL uni.algo.betweenness({AP}) YIELD nodeId, score RETURN nodeId, round(score, 8) AS score", HOPS + ", sig(s, n, k, c) AS (SELECT id, id, 0, 1::DOUBLE FROM v UNION ALL SELECT x.s, x.d, x.k, sum(x.c)::DOUBLE FROM (SELECT g.s, e.d, g.k + 1 AS k, g.c FROM sig g JOIN e ON g.n = e.s JOIN dist t ON t.s = g.s AND t.n = e.d AND t.k = g.k + 1) x GROUP BY ALL), z AS (SELECT s, n, any_value(k) AS k, sum(c) AS c FROM sig GROUP BY ALL) SELECT id AS nodeId, round(coalesce((SELECT sum(a.c * b.c / t.c) FROM z a JOIN z b ON b.s = a.n JOIN z t ON t.s = a.s AND t.n = b.n AND t.k = a.k + b.k WHERE a.n = v.id AND a.s <> v.id AND b.n <> v.id), 0) / (24.0 * 23.0), 8) AS score FROM v")
trade("algo_louvain", f"CALL uni.algo.louvain({AP}) YIELD nodeId, communityId RETURN nodeId, communityId")
trade("algo_max_flow", f"CALL uni.algo.maxFlow({AP}, 0, 11, 'weight') YIELD maxFlow RETURN maxFlow")
trade("algo_ford_fulkerson", f"CALL uni.algo.fordFulkerson({AP}, 0, 11, 'weight') YIELD maxFlow RETURN maxFlow")
trade("algo_astar", "CALL uni.algo.astar(0, 11, 'TRADES', 'none') YIELD cost RETURN cost", WALK + "SELECT min(c) AS cost FROM r WHERE n = 11")
trade("graph_projection", "CALL uni.graph.project('g', {nodeLabels: ['Nation'], edgeTypes: ['TRADES']}) YIELD name CALL uni.algo.degreeCentrality(['g'], null) YIELD nodeId, score RETURN nodeId, score", f"WITH {TRADES} SELECT id AS nodeId, (SELECT count(*) FROM e WHERE s = id)::DOUBLE AS score FROM v")
cypher("algo_degree_orders", "CALL uni.algo.degreeCentrality(['Customer', 'Order'], ['PLACED']) YIELD nodeId, score WITH score WHERE score > 0 RETURN score, count(*) AS n", "SELECT k::DOUBLE AS score, count(*) AS n FROM (SELECT o_custkey, count(*) AS k FROM orders GROUP BY 1) GROUP BY 1")

# --- over customers and their REFERS edges, which grow with orders -------------------------------------------------
REFERS = "e AS MATERIALIZED (SELECT a.o_custkey AS s, b.o_custkey AS d, min(a.o_orderkey % 5 + 1)::DOUBLE AS w FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1 WHERE a.o_custkey <> b.o_custkey GROUP BY ALL), v AS MATERIALIZED (SELECT c_custkey AS id FROM customer), o AS MATERIALIZED (SELECT s, count(*) AS k FROM e GROUP BY 1), u AS MATERIALIZED (SELECT s, d FROM e UNION SELECT d, s FROM e), n AS (SELECT count(*)::DOUBLE AS n FROM v)"
CUSTOMERS = "['Customer'], ['REFERS']"
FROM_0 = f"WITH RECURSIVE {REFERS}, h(n, k) AS (SELECT 0::BIGINT, 0 UNION SELECT e.d, h.k + 1 FROM h JOIN e ON h.n = e.s WHERE h.k < 25), dist AS (SELECT n, min(k)::BIGINT AS k FROM h GROUP BY n) "


def refers(name: str, text: str, sql: str | None = None, **params) -> None:
    cypher(name, text, sql, referral_graph, **params)


def rounds(n: int, start: str, step: str) -> str:
    """SQL of rounds it0 to it<n> (id, x) over the REFERS graph."""
    parts = [f"WITH {REFERS}", f"it0 AS MATERIALIZED (SELECT id, {start} AS x FROM v)"]
    return ", ".join(parts + [f"it{i} AS MATERIALIZED ({step.format(prev=f'it{i - 1}')})" for i in range(1, n + 1)])


GOT = "LEFT JOIN (SELECT e.d, {what} AS g FROM {{prev}} p JOIN e ON e.s = p.id{more} GROUP BY 1) g ON g.d = v.id"
NEAREST = rounds(20, "CASE WHEN id = 0 THEN 0.0::DOUBLE END", f"SELECT v.id, least(q.x, g.g) AS x FROM v JOIN {{prev}} q ON q.id = v.id {GOT.format(what='min(p.x + e.w)', more='')}")
refers("pattern_triadic", "MATCH (a:Customer {c_custkey: 0})-[:REFERS]->(b)-[:REFERS]->(c) WHERE NOT (a)-[:REFERS]->(c) AND a <> c RETURN c.c_name AS name, count(*) AS n", f"WITH {REFERS} SELECT c_name AS name, count(*) AS n FROM e x JOIN e y ON x.d = y.s JOIN customer ON c_custkey = y.d WHERE x.s = 0 AND y.d <> 0 AND NOT EXISTS (SELECT 1 FROM e z WHERE z.s = 0 AND z.d = y.d) GROUP BY 1")
refers("vlp_trails", "MATCH (a:Customer {c_custkey: 0})-[r:REFERS*2..3]->(b) RETURN b.c_custkey AS b, count(*) AS n", f"WITH {REFERS}, p AS (SELECT x.s, y.d FROM e x JOIN e y ON x.d = y.s AND NOT (x.s = y.s AND x.d = y.d) WHERE x.s = 0 UNION ALL SELECT x.s, z.d FROM e x JOIN e y ON x.d = y.s AND NOT (x.s = y.s AND x.d = y.d) JOIN e z ON y.d = z.s AND NOT (x.s = z.s AND x.d = z.d) AND NOT (y.s = z.s AND y.d = z.d) WHERE x.s = 0) SELECT d AS b, count(*) AS n FROM p GROUP BY 1")
NEXT = "WITH RECURSIVE t AS (SELECT DISTINCT conv_id, turn FROM conversations), e AS (SELECT a.conv_id, a.turn AS s, b.turn AS d FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT * FROM e UNION SELECT r.conv_id, r.s, e.d FROM r JOIN e ON e.conv_id = r.conv_id AND e.s = r.d) SELECT conv_id AS c, s AS a, d AS b FROM r"
cypher("vlp_reachability", "MATCH (a:Turn)-[:NEXT*]->(b:Turn) RETURN DISTINCT a.conv_id AS c, a.turn AS a, b.turn AS b", NEXT)
refers("shortest_path", "MATCH (a:Customer {c_custkey: 0}), (b:Customer) WHERE a <> b MATCH p = shortestPath((a)-[:REFERS*]->(b)) RETURN b.c_custkey AS b, length(p) AS len", FROM_0 + "SELECT n AS b, k AS len FROM dist WHERE n <> 0")
refers("all_shortest_paths", "MATCH (a:Customer {c_custkey: 0}), (b:Customer) WHERE a <> b MATCH p = allShortestPaths((a)-[:REFERS*]->(b)) RETURN b.c_custkey AS b, count(p) AS n", FROM_0 + ", w(n, k, c) AS (SELECT 0::BIGINT, 0, 1::BIGINT UNION ALL SELECT x.d, k, sum(c)::BIGINT FROM (SELECT e.d, w.k + 1 AS k, w.c FROM w JOIN e ON w.n = e.s JOIN dist t ON t.n = e.d AND t.k = w.k + 1) x GROUP BY ALL) SELECT n AS b, sum(c)::BIGINT AS n FROM w WHERE n <> 0 GROUP BY 1")
cypher("not_pattern", "MATCH (c:Customer) WHERE NOT (c)-[:PLACED]->(:Order {o_orderstatus: 'F'}) RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
refers("algo_degree", f"CALL uni.algo.degreeCentrality({CUSTOMERS}, 'BOTH') YIELD nodeId, score RETURN nodeId, score", f"WITH {REFERS}, b AS (SELECT s AS x FROM e UNION ALL SELECT d FROM e), c AS (SELECT x, count(*) AS k FROM b GROUP BY 1) SELECT id AS nodeId, coalesce(k, 0)::DOUBLE AS score FROM v LEFT JOIN c ON x = id")
refers("algo_pagerank", f"CALL uni.algo.pageRank({CUSTOMERS}, 0.85, 5) YIELD nodeId, score RETURN nodeId, round(score, 10) AS score", rounds(5, "1.0::DOUBLE / (SELECT n FROM n)", f"SELECT v.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * dangling.x / n.n + 0.85::DOUBLE * coalesce(g.g, 0) AS x FROM v {GOT.format(what='sum(p.x / o.k)', more=' JOIN o ON o.s = p.id')}, n, (SELECT coalesce(sum(p.x), 0) AS x FROM {{prev}} p WHERE p.id NOT IN (SELECT s FROM o)) dangling") + " SELECT id AS nodeId, round(x, 10) AS score FROM it5")
refers("algo_katz", f"CALL uni.algo.katzCentrality({CUSTOMERS}, 0.05, 1.0, 5) YIELD nodeId, score RETURN nodeId, round(score, 10) AS score", rounds(5, "1.0::DOUBLE", f"SELECT v.id, 1.0::DOUBLE + 0.05::DOUBLE * coalesce(g.g, 0) AS x FROM v {GOT.format(what='sum(p.x)', more='')}") + " SELECT id AS nodeId, round(x, 10) AS score FROM it5")
refers("algo_eigenvector", f"CALL uni.algo.eigenvectorCentrality({CUSTOMERS}, 5) YIELD nodeId, score RETURN nodeId, round(score, 8) AS score", rounds(5, "1 / sqrt((SELECT n FROM n))", f"SELECT id, y / sqrt(sum(y * y) OVER ()) AS x FROM (SELECT v.id, coalesce(g.g, 0) AS y FROM v {GOT.format(what='sum(p.x)', more='')})") + " SELECT id AS nodeId, round(x, 8) AS score FROM it5")
refers("algo_wcc", f"CALL uni.algo.wcc({CUSTOMERS}) YIELD nodeId, componentId RETURN nodeId, componentId", rounds(16, "id", "SELECT v.id, least(q.x, min(p.x)) AS x FROM v JOIN {prev} q ON q.id = v.id LEFT JOIN u ON u.d = v.id LEFT JOIN {prev} p ON p.id = u.s GROUP BY v.id, q.x") + " SELECT id AS nodeId, x AS componentId FROM it16")
refers("algo_scc", f"CALL uni.algo.scc({CUSTOMERS}) YIELD nodeId, componentId RETURN nodeId, componentId", f"WITH RECURSIVE {REFERS}, r AS (SELECT id AS a, id AS b FROM v UNION SELECT r.a, e.d FROM r JOIN e ON r.b = e.s) SELECT x.a AS nodeId, min(x.b) AS componentId FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1")
refers("algo_triangles", f"CALL uni.algo.triangleCount({CUSTOMERS}) YIELD nodeId, triangleCount RETURN nodeId, triangleCount", f"WITH {REFERS}, t AS (SELECT a.s AS x, count(*) AS k FROM u a JOIN u b ON a.s = b.s AND a.d < b.d JOIN u c ON c.s = a.d AND c.d = b.d GROUP BY 1) SELECT id AS nodeId, coalesce(k, 0) AS triangleCount FROM v LEFT JOIN t ON x = id")
refers("algo_label_propagation", f"CALL uni.algo.labelPropagation({CUSTOMERS}, 5) YIELD nodeId, communityId RETURN nodeId, communityId", rounds(5, "id", "SELECT v.id, coalesce(b.x, q.x) AS x FROM v JOIN {prev} q ON q.id = v.id LEFT JOIN (SELECT z.d, p.x, row_number() OVER (PARTITION BY z.d ORDER BY count(*) DESC, p.x) AS r FROM (SELECT s, d FROM e UNION ALL SELECT d, s FROM e) z JOIN {prev} p ON p.id = z.s GROUP BY z.d, p.x) b ON b.d = v.id AND b.r = 1") + " SELECT id AS nodeId, x AS communityId FROM it5")
for _name, _call in (("algo_bellman_ford", "bellmanFord"), ("algo_sssp", "sssp")):
    refers(_name, f"CALL uni.algo.{_call}({CUSTOMERS}, 0, 'weight') YIELD nodeId, distance RETURN nodeId, distance", NEAREST + " SELECT id AS nodeId, x AS distance FROM it20 WHERE x IS NOT NULL")
refers("algo_dijkstra", f"CALL uni.algo.dijkstra({CUSTOMERS}, 0, null, 'weight', 4) YIELD nodeId, distance RETURN nodeId, distance", NEAREST + " SELECT id AS nodeId, x AS distance FROM it20 WHERE x <= 4")
refers("algo_bidirectional_dijkstra", f"CALL uni.algo.bidirectionalDijkstra({CUSTOMERS}, 0, 11, 'weight') YIELD distance RETURN distance", NEAREST + " SELECT x AS distance FROM it20 WHERE id = 11 AND x IS NOT NULL")
refers("algo_node_similarity", f"CALL uni.algo.nodeSimilarity({CUSTOMERS}, 'JACCARD', 0.1, 10) YIELD node1, node2, similarity RETURN node1, node2, round(similarity, 8) AS s", f"WITH {REFERS}, p AS (SELECT a.s AS x, b.s AS y, count(*) AS c FROM e a JOIN e b ON a.d = b.d AND a.s <> b.s GROUP BY ALL), q AS (SELECT x, y, c / (o1.k + o2.k - c) AS j FROM p JOIN o o1 ON o1.s = x JOIN o o2 ON o2.s = y) SELECT x AS node1, y AS node2, round(j, 8) AS s FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY j DESC, y) AS r FROM q WHERE j >= 0.1) WHERE r <= 10")
refers("algo_reachability", "CALL uni.algo.reachability(0, {edgeTypes: ['REFERS']}) YIELD nodeId, distance RETURN nodeId, distance", FROM_0 + "SELECT n AS nodeId, k AS distance FROM dist")
refers("algo_expand", "CALL uni.path.expand(0, {edgeTypes: ['REFERS'], minLevel: 1, maxLevel: 2}) YIELD nodeId, level RETURN nodeId, level", FROM_0 + "SELECT n AS nodeId, k AS level FROM dist WHERE k BETWEEN 1 AND 2")
refers("algo_shortest_path", "CALL uni.algo.shortestPath(0, 11, 'REFERS') YIELD length, nodeIds RETURN length, size(nodeIds) AS n", FROM_0 + "SELECT k AS length, k + 1 AS n FROM dist WHERE n = 11")
CLIQUES = f"WITH {REFERS}, t AS MATERIALIZED (SELECT a.s AS a, a.d AS b, b.d AS c FROM u a JOIN u b ON a.s = b.s AND a.d < b.d JOIN u c ON c.s = a.d AND c.d = b.d WHERE a.s < a.d), f AS MATERIALIZED (SELECT x.a, x.b, x.c, y.c AS d FROM t x JOIN t y ON x.a = y.a AND x.b = y.b AND x.c < y.c JOIN u ON u.s = x.c AND u.d = y.c), g AS MATERIALIZED (SELECT x.a, x.b, x.c, x.d, y.d AS e FROM f x JOIN f y ON x.a = y.a AND x.b = y.b AND x.c = y.c AND x.d < y.d JOIN u ON u.s = x.d AND u.d = y.d), f3 AS (SELECT a, b, c FROM f UNION SELECT a, b, d FROM f UNION SELECT a, c, d FROM f UNION SELECT b, c, d FROM f), g4 AS (SELECT a, b, c, d FROM g UNION SELECT a, b, c, e FROM g UNION SELECT a, b, d, e FROM g UNION SELECT a, c, d, e FROM g UNION SELECT b, c, d, e FROM g)"
refers("algo_maximal_cliques", f"CALL uni.algo.maximalCliques({CUSTOMERS}, 3) YIELD clique RETURN size(clique) AS n, count(*) AS cliques", CLIQUES + " SELECT * FROM (SELECT 3::BIGINT AS n, count(*) AS cliques FROM (FROM t EXCEPT FROM f3) UNION ALL SELECT 4, count(*) FROM (FROM f EXCEPT FROM g4) UNION ALL SELECT 5, count(*) FROM g) WHERE cliques > 0")

# --- on the fixed graph of nations, whose answers SQL can enumerate -----------------------------------------------
trade("algo_kcore", f"CALL uni.algo.kCore({AP}) YIELD nodeId, coreNumber RETURN nodeId, coreNumber", f"{CORE.replace('WITH RECURSIVE', 'WITH')}, it0 AS MATERIALIZED (SELECT id, (SELECT count(*) FROM u WHERE s = id) AS x FROM v), " + ", ".join(f"it{i} AS MATERIALIZED (SELECT v.id, coalesce(max(least(x, r)), 0) AS x FROM v LEFT JOIN (SELECT u.s, p.x, row_number() OVER (PARTITION BY u.s ORDER BY p.x DESC) AS r FROM u JOIN it{i - 1} p ON p.id = u.d) q ON q.s = v.id GROUP BY 1)" for i in range(1, 13)) + " SELECT id AS nodeId, x::BIGINT AS coreNumber FROM it12")
cypher("algo_articulation_points", "CALL uni.algo.articulationPoints(['Nation', 'Region'], ['IN_REGION']) YIELD node RETURN node", "SELECT 1::BIGINT * 1099511627776 + n_regionkey AS node FROM nation GROUP BY n_regionkey HAVING count(*) > 1")
trade("algo_mst", f"CALL uni.algo.mst({AP}, 'weight') YIELD weight RETURN count(*) AS n, sum(weight) AS total", f"{CORE}, y AS (SELECT s, d, w FROM e UNION SELECT d, s, w FROM e), t AS (SELECT unnest(range(0, 6)) AS t), r AS (SELECT t, id AS a, id AS b FROM v, t UNION SELECT r.t, r.a, y.d FROM r JOIN y ON r.b = y.s AND y.w <= r.t), c AS (SELECT t, count(DISTINCT m) AS c FROM (SELECT t, a, min(b) AS m FROM r GROUP BY ALL) GROUP BY 1) SELECT sum(p.c - q.c)::BIGINT AS n, sum(q.t * (p.c - q.c))::DOUBLE AS total FROM c p JOIN c q ON q.t = p.t + 1")
SIMPLE = f"WITH RECURSIVE {TRADES}, p(path, n, c) AS (SELECT [0::BIGINT], 0::BIGINT, 0.0::DOUBLE UNION ALL SELECT list_append(p.path, e.d), e.d, p.c + e.w FROM p JOIN e ON p.n = e.s WHERE p.n <> 11 AND NOT list_contains(p.path, e.d)) "
trade("algo_k_shortest", f"CALL uni.algo.kShortestPaths({AP}, 0, 11, 3, 'weight') YIELD cost, rank RETURN rank, cost", SIMPLE + "SELECT row_number() OVER (ORDER BY c) AS rank, c AS cost FROM p WHERE n = 11 ORDER BY c LIMIT 3")
trade("algo_simple_paths", "CALL uni.algo.allSimplePaths(0, 11, 'TRADES', 6) YIELD path RETURN reduce(s = '', n IN path | s + ' ' + toString(n)) AS path", SIMPLE + "SELECT ' ' || array_to_string(path, ' ') AS path FROM p WHERE n = 11 AND len(path) <= 7")
trade("algo_circuits", f"CALL uni.algo.elementaryCircuits({AP}, 1000) YIELD cycle RETURN size(cycle) AS len, count(*) AS n", f"WITH RECURSIVE {TRADES}, p(path, n) AS (SELECT [id], id FROM v UNION ALL SELECT list_append(p.path, e.d), e.d FROM p JOIN e ON p.n = e.s WHERE e.d > p.path[1] AND NOT list_contains(p.path, e.d)) SELECT len(path) + 1 AS len, count(*) AS n FROM p JOIN e ON e.s = p.n AND e.d = p.path[1] GROUP BY 1")


def coloring_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Edges whose ends have one colour, and the vertices that have a colour."""
    s = Session(trade_graph(spark, folder))
    found = s.query(f"CALL uni.algo.graphColoring({AP}) YIELD nodeId, color RETURN nodeId, color")
    edges = s.query("MATCH (a:Nation)-[:TRADES]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b")
    a, b = found.select(F.col("nodeId").alias("a"), F.col("color").alias("ca")), found.select(F.col("nodeId").alias("b"), F.col("color").alias("cb"))
    equal = edges.join(a, "a").join(b, "b").agg(F.count_if(F.col("ca") == F.col("cb")).alias("equal"), F.count("*").alias("edges"))
    return equal.crossJoin(found.agg(F.countDistinct("nodeId").alias("n")))


plain("algo_coloring_valid", coloring_valid, f"WITH {TRADES} SELECT 0::BIGINT AS equal, count(*) AS edges, (SELECT count(*) FROM v) AS n FROM e")


def random_walk_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Walks by start, and their steps that are no edge."""
    s = Session(trade_graph(spark, folder))
    walks = s.query(f"CALL uni.algo.randomWalk({AP}, 4, 2) YIELD path RETURN path").select("path", F.monotonically_increasing_id().alias("walk"))
    edges = s.query("MATCH (a:Nation)-[:TRADES]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b").distinct()
    steps = walks.select("walk", F.explode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("a"), F.slice("path", F.lit(2), F.size("path") - 1).alias("b"))).alias("x")).select("x.a", "x.b")
    strange = steps.join(edges, ["a", "b"], "left_anti").agg(F.count("*").alias("strange"))
    starts = walks.groupBy(F.col("path")[0].alias("start")).agg(F.count("*").alias("walks"))
    return starts.crossJoin(strange)


plain("algo_random_walk", random_walk_steps, f"WITH {TRADES} SELECT id AS start, 2::BIGINT AS walks, 0::BIGINT AS strange FROM v")


def matching(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a matching that are edges, and the distinct vertices they hold."""
    s = Session(table_graph(spark, folder))
    pairs = s.query("CALL uni.algo.maxMatching(['Nation', 'Region'], ['IN_REGION']) YIELD node1, node2 RETURN node1, node2")
    edges = s.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN id(n) AS x, id(r) AS y")
    held = pairs.join(edges, ((F.col("node1") == F.col("x")) & (F.col("node2") == F.col("y"))) | ((F.col("node1") == F.col("y")) & (F.col("node2") == F.col("x"))))
    return held.agg(F.count("*").alias("pairs"), F.countDistinct("x").alias("nations"), F.countDistinct("y").alias("regions"))


plain("algo_matching", matching, "SELECT count(DISTINCT n_regionkey) AS pairs, count(DISTINCT n_regionkey) AS nations, count(DISTINCT n_regionkey) AS regions FROM nation")

# --- search -----------------------------------------------------------------------------------------------------
QV = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_Q = "[" + ", ".join(map(str, QV)) + "]::DOUBLE[]"


def dist_sql(metric: str) -> str:
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    e = "embedding::DOUBLE[]"
    return {"cosine": f"1 - {dot(e, _Q)} / (sqrt({dot(e, e)}) * sqrt({dot(_Q, _Q)}))", "l2": f"list_sum(list_transform(list_zip({e}, {_Q}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))", "dot": f"-({dot(e, _Q)})", "l1": f"list_sum(list_transform(list_zip({e}, {_Q}), lambda z: abs(z[1] - z[2])))"}[metric]


for _metric in ("cosine", "l2", "dot", "l1"):
    cypher(f"vector_query_{_metric}", f"CALL uni.vector.query('Vec', 'embedding', $q, 10, null, null, {{metric: '{_metric}'}}) YIELD vid, distance, node RETURN node.vec_id AS id, round(distance, 6) AS d", f"SELECT vec_id AS id, round({dist_sql(_metric)}, 6) AS d FROM embeddings ORDER BY {dist_sql(_metric)}, vec_id LIMIT 10", q=QV)
cypher("vector_query_filtered", "CALL uni.vector.query('Vec', 'embedding', $q, 5, 'label = 3', 1.2) YIELD node, distance, score RETURN node.vec_id AS id, round(score, 6) AS s", f"SELECT vec_id AS id, round((2 - ({dist_sql('cosine')})) / 2, 6) AS s FROM embeddings WHERE label = 3 AND {dist_sql('cosine')} <= 1.2 ORDER BY {dist_sql('cosine')}, vec_id LIMIT 5", q=QV)
cypher("vector_similarity_rows", "MATCH (v:Vec) RETURN v.vec_id AS id, round(vector_similarity(v.embedding, $q), 6) AS s, round(vector_distance(v.embedding, $q, 'l2'), 6) AS d", f"SELECT vec_id AS id, round(1 - ({dist_sql('cosine')}), 6) AS s, round({dist_sql('l2')}, 6) AS d FROM embeddings", q=QV)
TERMS = "regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '([\\p{L}\\p{N}]+)')"
BM25 = f"WITH t AS (SELECT doc_id, list_filter({TERMS}, lambda x: length(x) <= 40) AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t), h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM t) WHERE term IN ('license', 'apache', 'version') GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM h GROUP BY 1), sc AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM h JOIN df USING (term), st GROUP BY 1)"
cypher("fts_query", "CALL uni.fts.query('Document', 'text', 'Apache License version', 10) YIELD node, score RETURN node.doc_id AS id, round(score, 6) AS s", BM25 + " SELECT doc_id AS id, round(score / (SELECT max(score) FROM sc), 6) AS s FROM sc ORDER BY round(score / (SELECT max(score) FROM sc), 9) DESC, doc_id LIMIT 10")
cypher("fts_threshold", "CALL uni.fts.query('Document', 'text', 'Apache License version', null, 0.8) YIELD score RETURN count(*) AS n", BM25 + " SELECT count(*) AS n FROM sc WHERE round(score / (SELECT max(score) FROM sc), 9) >= 0.8")


def sparse_graph(spark: SparkSession, folder: str) -> Graph:
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    kept = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.element_at("embedding", i + 1) > 0.1)
    return Graph(spark).add_nodes("Sparse", v.select(F.col("vec_id").alias("_vid"), "vec_id", F.struct(kept.alias("indices"), F.transform(kept, lambda i: F.element_at("embedding", i + 1)).alias("values")).alias("terms")))


cypher("sparse_query", "CALL uni.sparse.query('Sparse', 'terms', {indices: [1, 5, 9, 33], values: [1.0, 0.5, 2.0, 1.5]}, 10) YIELD vid, score RETURN vid, round(score, 6) AS s", "WITH q AS (SELECT unnest([2, 6, 10, 34]) AS i, unnest([1.0, 0.5, 2.0, 1.5]) AS w), s AS (SELECT vec_id AS vid, sum(embedding[i]::DOUBLE * w) AS s FROM embeddings, q WHERE embedding[i] > 0.1::FLOAT GROUP BY 1) SELECT vid, round(s, 6) AS s FROM s ORDER BY s.s DESC, vid LIMIT 10", sparse_graph)


def hybrid_graph(spark: SparkSession, folder: str) -> Graph:
    d = spark.read.parquet(f"{folder}/documents.parquet")
    v = spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("vec_id", "doc_id")
    return Graph(spark).add_nodes("Doc", d.join(v, "doc_id").select(F.col("doc_id").alias("_vid"), "doc_id", "text", "embedding"))


HYB = f"docs AS (SELECT doc_id, text, {dist_sql('cosine')} AS dist FROM documents JOIN embeddings ON doc_id = vec_id)"
cypher("hybrid_rrf", "CALL uni.search('Doc', {vector: 'embedding', fts: 'text'}, 'Apache License version', $q, 5) YIELD vid, score RETURN vid, round(score, 8) AS s", BM25.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))").replace("WITH t AS", f"WITH {HYB}, t AS") + ", a AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY dist, doc_id)) AS p FROM docs QUALIFY row_number() OVER (ORDER BY dist, doc_id) <= 10), b AS (SELECT doc_id, 1.0 / (60 + row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM sc), 9) DESC, doc_id)) AS p FROM sc QUALIFY row_number() OVER (ORDER BY round(score / (SELECT max(score) FROM sc), 9) DESC, doc_id) <= 10) SELECT doc_id AS vid, round(sum(p), 8) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1 ORDER BY sum(p) DESC, doc_id LIMIT 5", hybrid_graph, q=QV)
ARMS = BM25.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))").replace("WITH t AS", f"WITH {HYB}, t AS") + ", a AS (SELECT doc_id, dist, (2 - dist) / 2 AS s FROM docs ORDER BY dist, doc_id LIMIT 10), b AS (SELECT doc_id, round(score / (SELECT max(score) FROM sc), 9) AS s FROM sc ORDER BY s DESC, doc_id LIMIT 10), "
BEST = "SELECT doc_id AS vid, round(sum(p), 8) AS s FROM p GROUP BY 1 ORDER BY sum(p) DESC, doc_id LIMIT 5"
cypher("hybrid_weighted", "CALL uni.search('Doc', {vector: 'embedding', fts: 'text'}, 'Apache License version', $q, 5, null, {method: 'weighted', alpha: 0.3}) YIELD vid, score RETURN vid, round(score, 8) AS s", ARMS + "p AS (SELECT doc_id, 0.3::DOUBLE * coalesce(1 - (dist - (SELECT min(dist) FROM a)) / nullif((SELECT max(dist) - min(dist) FROM a), 0), 1) AS p FROM a UNION ALL SELECT doc_id, 0.7::DOUBLE * s / (SELECT max(s) FROM b) FROM b) " + BEST, hybrid_graph, q=QV)
cypher("hybrid_dbsf", "CALL uni.search('Doc', {vector: 'embedding', fts: 'text'}, 'Apache License version', $q, 5, null, {method: 'dbsf'}) YIELD vid, score RETURN vid, round(score, 8) AS s", ARMS + "p AS (SELECT doc_id, 0.5::DOUBLE * coalesce((s - (SELECT avg(s) FROM a)) / nullif((SELECT stddev_pop(s) FROM a), 0), 0) AS p FROM a UNION ALL SELECT doc_id, 0.5::DOUBLE * coalesce((s - (SELECT avg(s) FROM b)) / nullif((SELECT stddev_pop(s) FROM b), 0), 0) FROM b) " + BEST, hybrid_graph, q=QV)
cypher("nlp_words", "CALL uni.nlp.words('Turn', 'text') YIELD vid, position, word RETURN count(*) AS n, count(DISTINCT word) AS words", "WITH t AS (SELECT any_value(text) AS text FROM conversations GROUP BY conv_id, turn), w AS (SELECT unnest(regexp_extract_all(text, '([\\p{L}\\p{N}]+)')) AS w FROM t) SELECT count(*) AS n, count(DISTINCT w) AS words FROM w")

# --- rules ------------------------------------------------------------------------------------------------------
rules("rule_reach", "CREATE RULE reach AS MATCH (a:Turn)-[:NEXT]->(b:Turn) YIELD KEY a, KEY b\nCREATE RULE reach AS MATCH (a:Turn)-[:NEXT]->(m:Turn) WHERE m IS reach TO b YIELD KEY a, KEY b\nQUERY reach RETURN a.conv_id AS c, a.turn AS a, b.turn AS b", NEXT)
rules("rule_negation", "CREATE RULE served AS MATCH (c:Customer)-[:PLACED]->(:Order {o_orderstatus: 'F'}) YIELD KEY c\nCREATE RULE idle AS MATCH (c:Customer) WHERE c IS NOT served YIELD KEY c\nQUERY idle RETURN c.c_custkey AS c", "SELECT c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
rules("rule_noisy_or", "CREATE RULE risk AS MATCH (a:Customer)-[e:REFERS]->(b:Customer) FOLD p = MNOR(e.weight / 10.0) YIELD KEY b, p AS PROB\nQUERY risk RETURN b.c_custkey AS b, round(p, 8) AS p", f"WITH {REFERS} SELECT d AS b, round(1 - product(1 - w / 10), 8) AS p FROM e GROUP BY 1", referral_graph)
rules("rule_product", "CREATE RULE all_ok AS MATCH (a:Customer)-[e:REFERS]->(b:Customer) FOLD p = MPROD(e.weight / 10.0) YIELD KEY a, p\nQUERY all_ok RETURN a.c_custkey AS a, round(p, 12) AS p", f"WITH {REFERS} SELECT s AS a, round(product(w / 10), 12) AS p FROM e GROUP BY 1", referral_graph)
rules("rule_recursive_max", "CREATE RULE far AS MATCH (a:Customer)-[e:FOLLOWS]->(b:Customer) FOLD m = MMAX(e.weight) YIELD KEY b, m\nCREATE RULE far AS MATCH (a:Customer)-[e:FOLLOWS]->(b:Customer) WHERE a IS far FOLD m = MMAX(m) YIELD KEY b, m\nQUERY far RETURN b.c_custkey AS b, m", f"WITH RECURSIVE {REFERS}, f AS (SELECT * FROM e WHERE s < d), r(n, w) AS (SELECT d, w FROM f UNION SELECT f.d, r.w FROM r JOIN f ON r.n = f.s) SELECT n AS b, max(w) AS m FROM r GROUP BY 1", referral_graph)
rules("rule_probability", "CREATE RULE link AS MATCH (a:Customer)-[e:REFERS]->(b:Customer) YIELD KEY a, KEY b, e.weight / 10.0 AS PROB\nCREATE RULE two AS MATCH (a:Customer)-[e:REFERS]->(m:Customer) WHERE m IS link TO b FOLD p = MNOR(e.weight / 10.0) YIELD KEY a, KEY b, p AS PROB\nQUERY two RETURN a.c_custkey AS a, b.c_custkey AS b, round(p, 8) AS p", f"WITH {REFERS} SELECT x.s AS a, y.d AS b, round(1 - product(1 - x.w / 10 * (y.w / 10)), 8) AS p FROM e x JOIN e y ON x.d = y.s GROUP BY ALL", referral_graph)
rules("rule_fold_having", "CREATE RULE spend AS MATCH (c:Customer)-[:PLACED]->(o:Order) FOLD total = SUM(o.o_totalprice), n = COUNT(*) WHERE n >= 5 YIELD KEY c, total, n\nQUERY spend RETURN c.c_custkey AS c, round(total, 2) AS total, n", "SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 5")
rules("rule_along_best", "CREATE RULE dist AS MATCH (a:Nation)-[e:TRADES]->(b:Nation) ALONG d = prev.d + e.weight BEST BY d ASC YIELD KEY a, KEY b, d\nCREATE RULE dist AS MATCH (a:Nation)-[e:TRADES]->(m:Nation) WHERE m IS dist TO b ALONG d = prev.d + e.weight BEST BY d ASC YIELD KEY a, KEY b, d\nQUERY dist WHERE a.n_nationkey = 0 RETURN b.n_nationkey AS b, d", f"WITH RECURSIVE {TRADES}, r(n, c) AS (SELECT d, w FROM e WHERE s = 0 UNION SELECT e.d, r.c + e.w FROM r JOIN e ON r.n = e.s WHERE r.c + e.w <= 60) SELECT n::INTEGER AS b, min(c) AS d FROM r GROUP BY 1", trade_graph)
rules("rule_priority", "CREATE RULE tier PRIORITY 1 AS MATCH (c:Customer) YIELD KEY c, 'standard' AS t\nCREATE RULE tier PRIORITY 2 AS MATCH (c:Customer) WHERE c.c_acctbal > 5000 YIELD KEY c, 'gold' AS t\nQUERY tier RETURN t, count(*) AS n", "SELECT CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'standard' END AS t, count(*) AS n FROM customer GROUP BY 1")
rules("rule_assume", "CREATE RULE busy AS MATCH (a:Nation)-[:TRADES]->(b:Nation) YIELD KEY a\nASSUME { MATCH (a:Nation {n_nationkey: 0})-[r:TRADES]->() DELETE r } THEN { QUERY busy RETURN count(*) AS n }\nQUERY busy RETURN count(*) AS n", f"WITH {TRADES} SELECT count(DISTINCT s) AS n FROM e", trade_graph)
rules("rule_derive", "CREATE RULE pair AS MATCH (a:Nation)-[:TRADES]->(m:Nation)-[:TRADES]->(b:Nation) WHERE a <> b DERIVE (a)-[:PAIR]->(b)\nCREATE RULE paired AS MATCH (a:Nation)-[:PAIR]->(b:Nation) YIELD KEY a, KEY b\nDERIVE pair\nQUERY paired RETURN a.n_nationkey AS a, b.n_nationkey AS b", f"WITH {TRADES} SELECT DISTINCT x.s::INTEGER AS a, y.d::INTEGER AS b FROM e x JOIN e y ON x.d = y.s WHERE x.s <> y.d", trade_graph)
rules("rule_explain", "CREATE RULE hop AS MATCH (a:Nation)-[:TRADES]->(b:Nation) YIELD KEY a, KEY b\nEXPLAIN RULE hop WHERE a.n_nationkey = 0", None, trade_graph)
rules("rule_abduce", "CREATE RULE hop AS MATCH (a:Nation)-[:FLOWS]->(b:Nation) WHERE b.n_nationkey = 24 YIELD KEY a, KEY b\nABDUCE NOT hop WHERE a.n_nationkey = 17", None, trade_graph)


# --- writes, files, snapshots -----------------------------------------------------------------------------------
def write_create_merge(spark: SparkSession, folder: str) -> DataFrame:
    s = Session(trade_graph(spark, folder))
    s.query("MATCH (n:Nation) WHERE n.n_nationkey < 5 CREATE (n)-[:TAGGED {k: n.n_nationkey}]->(:Tag {name: n.n_name})")
    s.query("MERGE (t:Tag {name: 'NATION_1'}) ON MATCH SET t.seen = 1 ON CREATE SET t.seen = 2")
    s.query("MERGE (t:Tag {name: 'NEW'}) ON CREATE SET t.seen = 2")
    s.query("MATCH (t:Tag {name: 'NATION_2'}) DETACH DELETE t")
    return s.query("MATCH (t:Tag) OPTIONAL MATCH (t)<-[r:TAGGED]-(n) RETURN t.name AS name, t.seen AS seen, r.k AS k")


plain("write_create_merge", write_create_merge, "SELECT n_name AS name, CASE WHEN n_name = 'NATION_1' THEN 1::BIGINT END AS seen, n_nationkey AS k FROM nation WHERE n_nationkey < 5 AND n_name <> 'NATION_2' UNION ALL SELECT 'NEW', 2, NULL")


def write_set_remove(spark: SparkSession, folder: str) -> DataFrame:
    s = Session(trade_graph(spark, folder))
    s.query("MATCH (n:Nation) WHERE n.n_nationkey % 2 = 0 SET n.even = true, n += {size: n.n_nationkey * 2}")
    s.query("MATCH (n:Nation) WHERE n.n_nationkey = 4 REMOVE n.even")
    s.query("MATCH (n:Nation {n_nationkey: 6}) SET n:Special")
    return s.query("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.even AS even, n.size AS size, n:Special AS special")


plain("write_set_remove", write_set_remove, "SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey <> 4 THEN true END AS even, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey::BIGINT * 2 END AS size, n_nationkey = 6 AS special FROM nation")


def copy_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from ..storage import shared_dir

    s = Session(trade_graph(spark, folder))
    import uuid

    path = f"{shared_dir(spark)}/copy-{uuid.uuid4().hex}"
    s.query(f"COPY Nation TO '{path}' FORMAT csv")
    s.query("CREATE LABEL Copied (n_name STRING, n_regionkey INT32)")
    s.query(f"COPY Copied FROM '{path}' FORMAT csv")
    return s.query("MATCH (n:Copied) RETURN n.n_name AS name, n.n_regionkey AS r")


plain("copy_round_trip", copy_round_trip, "SELECT n_name AS name, n_regionkey AS r FROM nation")


def time_travel(spark: SparkSession, folder: str) -> DataFrame:
    s = Session(trade_graph(spark, folder))
    s.snapshot("before")
    s.query("MATCH (n:Nation) WHERE n.n_nationkey > 9 DETACH DELETE n")
    now = s.query("MATCH (n:Nation) RETURN count(*) AS now")
    return now.crossJoin(s.query("MATCH (n:Nation) RETURN count(*) AS before VERSION AS OF 'before'"))


plain("time_travel", time_travel, "SELECT count(*) FILTER (n_nationkey <= 9) AS now, count(*) AS before FROM nation")


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """A trigger sees what a commit changed."""
    from ..streaming.changes import Trigger

    s = Session(trade_graph(spark, folder))
    seen: list[DataFrame] = []
    s.triggers.append(Trigger("log", seen.append, labels={"Nation"}))
    s.query("MATCH (n:Nation) WHERE n.n_nationkey < 3 SET n.mark = 1")
    return seen[0].groupBy("event_kind", "label").agg(F.count("*").alias("n"))


plain("change_events", change_events, "SELECT 2 AS event_kind, 'Nation' AS label, count(*) AS n FROM nation WHERE n_nationkey < 3")
trade("schema_labels", "CALL uni.schema.labels() YIELD label, propertyCount RETURN label, propertyCount", "SELECT 'Nation' AS label, 3::BIGINT AS propertyCount")
trade("verify_endpoints", "CALL uni.admin.verifyEdgeEndpoints() YIELD edgeType, endpoint, violations RETURN edgeType, endpoint, violations", "SELECT t AS edgeType, p AS endpoint, 0::BIGINT AS violations FROM (SELECT unnest(['TRADES', 'FLOWS']) AS t), (SELECT unnest(['source', 'target']) AS p)")


def declared_function(spark: SparkSession, folder: str) -> DataFrame:
    s = Session(trade_graph(spark, folder))
    s.declare_function("twice", ["x"], "x * 2 + 1")
    s.register_udf("initial", lambda x: x[:3] if x is not None else None, "string")
    return s.query("MATCH (n:Nation) RETURN twice(n.n_nationkey) AS t, initial(n.n_name) AS i")


plain("declared_function", declared_function, "SELECT n_nationkey::BIGINT * 2 + 1 AS t, substr(n_name, 1, 3) AS i FROM nation")


def event_windows(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming.changes import tumbling

    e = spark.read.parquet(f"{folder}/events.parquet")
    return tumbling(e, "1 day", keys=["event_type"]).select(F.col("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


plain("event_windows", event_windows, "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")


def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    from ..streaming.changes import sessions

    e = spark.read.parquet(f"{folder}/events.parquet")
    return sessions(e, "6 hours", "user_id").groupBy("n").agg(F.count("*").alias("sessions"))


plain("event_sessions", event_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1")


def crdt_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Counters by user: replicas are event types, states their counts per day; merged by maximum and added."""
    from ..operators.crdt import gcounter_merge

    e = spark.read.parquet(f"{folder}/events.parquet").groupBy(F.col("user_id").alias("key"), F.col("event_type").alias("actor"), F.to_date("ts").alias("d")).agg(F.count("*").alias("count"))
    return gcounter_merge(e).select("key", "value")


plain("crdt_counter", crdt_merge, "SELECT user_id AS key, sum(m)::BIGINT AS value FROM (SELECT user_id, event_type, max(c) AS m FROM (SELECT user_id, event_type, ts::DATE AS d, count(*) AS c FROM events GROUP BY ALL) GROUP BY ALL) GROUP BY 1")
