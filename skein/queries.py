"""Queries over the sample graph, one or more per operator, with their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.graph import Graph
from skein.sources.tables import sample_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CYPHER: dict[str, str] = {}
FLAGSHIP = "nation_revenue"


def _tidy(df: DataFrame) -> DataFrame:
    """Columns without the types that a comparison across engines trips over."""
    return df.select(*(F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f"`{f.name}`") for f in df.schema))


def query(name: str, text: str, sql: str | None, **params: Any) -> None:
    CYPHER[name] = text
    QUERIES[name] = lambda spark, sf_dir: _tidy(sample_graph(spark, sf_dir).query(text, params))
    if sql is not None:
        ORACLE_SQL[name] = sql


def custom(name: str, sql: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return register


NEXT = "nxt AS (SELECT event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, user_id, value FROM events)"
SAME = "same AS (SELECT a.s_suppkey AS s, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)"


def walk(low: int, high: int, extra: str = "") -> str:
    """Paths of the NEXT chain from ``low`` to ``high`` steps."""
    return f"WITH RECURSIVE {NEXT}, e AS (SELECT s, t FROM nxt WHERE t IS NOT NULL), w(a, b, n) AS (SELECT event_id, event_id, 0 FROM events {extra} UNION ALL SELECT w.a, e.t, w.n + 1 FROM w JOIN e ON w.b = e.s WHERE w.n < {high})"


query(
    FLAGSHIP,
    """MATCH (c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(p:Part)
       MATCH (c)-[:IN_NATION]->(n:Nation)
       WHERE o.totalprice > $min
       RETURN n.name AS nation, count(*) AS items, round(sum(l.extendedprice)) AS revenue
       ORDER BY items DESC, nation LIMIT 10""",
    """SELECT n_name AS nation, count(*) AS items, round(sum(l_extendedprice)) AS revenue FROM customer JOIN orders ON o_custkey = c_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 250000 GROUP BY n_name ORDER BY items DESC, nation LIMIT 10""",
    min=250000.0,
)

# --- scans
query("scan_label", "MATCH (n:Nation) RETURN n.nationkey AS k, n.name AS name", "SELECT n_nationkey::BIGINT AS k, n_name AS name FROM nation")
query(
    "scan_all_labels", "MATCH (n) RETURN labels(n)[0] AS label, count(*) AS c",
    " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS c FROM {t}" for label, t in (("Region", "region"), ("Nation", "nation"), ("Customer", "customer"), ("Supplier", "supplier"), ("Part", "part"), ("Order", "orders"), ("Event", "events"), ("User", "(SELECT DISTINCT user_id FROM events)"))),
)
query("scan_unknown_label", "MATCH (n:Nowhere) RETURN count(n) AS c", "SELECT 0::BIGINT AS c")
query("filter_props", "MATCH (p:Part {brand: 'Brand#2'}) WHERE p.size > 10 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#2' AND p_size > 10")
query("lookup_batch", "UNWIND range(1, 1000) AS id MATCH (c:Customer {custkey: id}) RETURN id, c.name AS name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey BETWEEN 1 AND 1000")

# --- one and more hops
query("expand_out", "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.custkey AS k, count(o) AS c, max(o.totalprice) AS m", "SELECT o_custkey AS k, count(*) AS c, max(o_totalprice) AS m FROM orders GROUP BY 1")
query("expand_in", "MATCH (o:Order)<-[:PLACED]-(c:Customer) WHERE o.totalprice > 400000 RETURN o.orderkey AS o, c.name AS name", "SELECT o_orderkey AS o, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 400000")
query("expand_both", "MATCH (s:Supplier)-[:SAME_NATION]-(t:Supplier) RETURN s.suppkey AS a, count(*) AS c", f"WITH {SAME} SELECT s AS a, count(*) AS c FROM (SELECT s, t FROM same UNION ALL SELECT t, s FROM same) GROUP BY 1")
query("expand_types", "MATCH (x)-[r:IN_NATION|IN_REGION]->(y) RETURN type(r) AS t, count(*) AS c", "SELECT 'IN_NATION' AS t, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS c UNION ALL SELECT 'IN_REGION', count(*) FROM nation")
query("expand_untyped", "MATCH (n:Nation)-->(x) RETURN labels(x) AS l, count(*) AS c", "SELECT ['Region'] AS l, count(*) AS c FROM nation")
query("rel_props", "MATCH (:Order)-[l:CONTAINS]->(:Part) WHERE l.discount > 0.05 RETURN count(l) AS c, sum(l.quantity) AS q", "SELECT count(*) AS c, sum(l_quantity) AS q FROM lineitem WHERE l_discount > 0.05")
query("rel_inline_props", "MATCH (:Order)-[l:CONTAINS {returnflag: 'R'}]->(p:Part) RETURN p.brand AS b, count(*) AS c", "SELECT p_brand AS b, count(*) AS c FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1")
query("rel_unique", "MATCH (o:Order)-[a:CONTAINS]->(p:Part)<-[b:CONTAINS]-(o2:Order) RETURN count(*) AS c", "SELECT sum(n * (n - 1))::BIGINT AS c FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)")
query(
    "two_hop", "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer) RETURN r.name AS r, count(*) AS c, sum(c.acctbal) > 0 AS positive",
    "SELECT r_name AS r, count(*) AS c, sum(c_acctbal) > 0 AS positive FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1",
)
query(
    "multi_pattern", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS n, count(*) AS c",
    "SELECT n_name AS n, count(*) AS c FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
query("cross_product", "MATCH (r:Region), (n:Nation) WHERE n.regionkey = r.regionkey RETURN r.name AS r, count(*) AS c", "SELECT r_name AS r, count(*) AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
query(
    "optional_match", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o) WHERE o.totalprice > 450000 RETURN c.custkey AS k, count(o) AS c",
    "SELECT c_custkey AS k, count(o_orderkey) AS c FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 450000 GROUP BY 1",
)
query(
    "optional_outer", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 100 RETURN n.name AS n, count(DISTINCT c) AS c, count(o) AS o",
    "SELECT n_name AS n, count(DISTINCT c_custkey) AS c, count(o_orderkey) AS o FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 100 GROUP BY 1",
)

# --- paths
query("var_bounded", "MATCH (a:Event)-[:NEXT*1..5]->(b:Event) RETURN count(*) AS c", walk(1, 5) + " SELECT count(*) AS c FROM w WHERE n >= 1")
query("var_exact", "MATCH (a:Event)-[:NEXT*3]->(b:Event) RETURN a.event_id AS a, b.event_id AS b", walk(3, 3) + " SELECT a, b FROM w WHERE n = 3")
query("var_inline_props", "MATCH (a:Event)-[:NEXT*1..3 {value: 1.0}]->(b:Event) RETURN count(*) AS c", f"WITH RECURSIVE {NEXT}, e AS (SELECT s, t FROM nxt WHERE t IS NOT NULL AND value = 1.0), w(b, n) AS (SELECT event_id, 0 FROM events UNION ALL SELECT e.t, w.n + 1 FROM w JOIN e ON w.b = e.s WHERE w.n < 3) SELECT count(*) AS c FROM w WHERE n >= 1")
query("var_unbounded", "MATCH (r:Region)<-[:IN_REGION|IN_NATION*]-(x) RETURN r.name AS r, labels(x)[0] AS l, count(*) AS c",
      "SELECT r_name AS r, l, count(*) AS c FROM (SELECT r_name, 'Nation' AS l FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'Customer' FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT r_name, 'Supplier' FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey) GROUP BY 1, 2")
query("named_path", "MATCH p = (a:Event)-[:NEXT*1..3]->(b) RETURN length(p) AS len, count(*) AS c", walk(1, 3) + " SELECT n::BIGINT AS len, count(*) AS c FROM w WHERE n >= 1 GROUP BY 1")
query("var_zero", "MATCH (a:Event)-[:NEXT*0..2]->(b:Event) RETURN count(*) AS c", walk(0, 2) + " SELECT count(*) AS c FROM w")
query("var_both", "MATCH (a:Event)-[:NEXT*1..2]-(b:Event) RETURN a.event_id AS a, count(*) AS c",
      f"WITH {NEXT}, e AS (SELECT s, t, s AS id FROM nxt WHERE t IS NOT NULL), u AS (SELECT s, t, id FROM e UNION ALL SELECT t, s, id FROM e), p AS (SELECT x.s AS a FROM u x UNION ALL SELECT x.s FROM u x JOIN u y ON x.t = y.s AND x.id <> y.id) SELECT a, count(*) AS c FROM p GROUP BY 1")
query("var_rel_list", "MATCH (a:Event)-[r:NEXT*2]->(b) RETURN size(r) AS n, reduce(s = 0.0, x IN r | s + x.value) > 50 AS big, count(*) AS c",
      f"WITH {NEXT} SELECT 2::BIGINT AS n, 0.0 + x.value + y.value > 50 AS big, count(*) AS c FROM nxt x JOIN nxt y ON y.s = x.t WHERE x.t IS NOT NULL AND y.t IS NOT NULL GROUP BY 2")
query("path_nodes", "MATCH p = (a:Event)-[:NEXT*2]->(b) RETURN [x IN nodes(p) | x.event_id] AS ids", f"WITH {NEXT} SELECT [x.s, y.s, y.t] AS ids FROM nxt x JOIN nxt y ON y.s = x.t WHERE y.t IS NOT NULL")
query("path_rels", "MATCH p = (c:Customer)-[:PLACED]->(o:Order)-[:SUPPLIED_BY]->(s:Supplier) WHERE o.totalprice > 450000 RETURN [r IN relationships(p) | type(r)] AS types, length(p) AS n, count(*) AS c", "SELECT ['PLACED', 'SUPPLIED_BY'] AS types, 2::BIGINT AS n, count(*) AS c FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 450000")
query("shortest", "MATCH p = shortestPath((a:Supplier)-[:SAME_NATION*]-(b:Supplier)) WHERE a.suppkey < b.suppkey RETURN a.suppkey AS a, b.suppkey AS b, length(p) AS n", f"WITH {SAME} SELECT s AS a, t AS b, 1::BIGINT AS n FROM same")
query("shortest_chain", "MATCH (a:Event {event_id: 10}), (b:Event) WHERE b.user_id = a.user_id MATCH p = shortestPath((a)-[:NEXT*1..20]->(b)) RETURN b.event_id AS b, length(p) AS n",
      f"WITH {NEXT}, r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT y.event_id AS b, (y.k - x.k)::BIGINT AS n FROM r x JOIN r y USING (user_id) WHERE x.event_id = 10 AND y.k - x.k BETWEEN 1 AND 20")
query("all_shortest", "MATCH (a:Nation {nationkey: 1}), (b:Nation {nationkey: 2}) MATCH p = allShortestPaths((a)-[:IN_NATION|IN_REGION*..4]-(b)) RETURN length(p) AS n, count(*) AS c",
      "SELECT CASE WHEN a.n_regionkey = b.n_regionkey THEN 2 END::BIGINT AS n, count(*) AS c FROM nation a, nation b WHERE a.n_nationkey = 1 AND b.n_nationkey = 2 AND a.n_regionkey = b.n_regionkey GROUP BY 1")

# --- subqueries
query("exists_semi", "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
query("exists_anti", "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 } RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
query("exists_or", "MATCH (c:Customer) WHERE c.custkey < 10 OR EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > c.acctbal * 60 } RETURN count(*) AS c", "SELECT count(*) AS c FROM customer WHERE c_custkey < 10 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 60)")
query("pattern_pred", "MATCH (c:Customer) WHERE (c)-[:PLACED]->() RETURN count(*) AS c", "SELECT count(DISTINCT o_custkey) AS c FROM orders")
query("pattern_comp", "MATCH (c:Customer) RETURN c.custkey AS k, size([(c)-[:PLACED]->(o) WHERE o.totalprice > 100000 | o.orderkey]) AS n", "SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000 GROUP BY 1")
query("call_subquery", "MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:IN_NATION]->(n) WHERE c.acctbal > 9000 RETURN count(c) AS k } RETURN n.name AS name, k", "SELECT n_name AS name, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1")
query("call_top", "MATCH (n:Nation) CALL { WITH n MATCH (c:Customer)-[:IN_NATION]->(n) RETURN c.custkey AS k ORDER BY k DESC LIMIT 2 } RETURN n.name AS name, k", "SELECT n_name AS name, c_custkey AS k FROM nation JOIN customer ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey DESC) <= 2")
query("proc_labels", "CALL db.labels() YIELD label RETURN label", "SELECT unnest(['Customer', 'Event', 'Nation', 'Order', 'Part', 'Region', 'Supplier', 'User']) AS label")
query("proc_mock", "MATCH (r:Region) CALL test.add(r.regionkey) YIELD out RETURN r.name AS r, out", "SELECT r_name AS r, 'row ' || r_regionkey AS out FROM region WHERE r_regionkey < 3",
      __procedures={"test.add": {"args": ["x"], "arg_types": ["INTEGER"], "yields": ["out"], "data": [{"x": i, "out": f"row {i}"} for i in range(3)]}})

# --- aggregation
query("agg_basic", "MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS c, round(sum(o.totalprice)) AS total, round(avg(o.totalprice)) AS mean, min(o.orderkey) AS low, max(o.orderkey) AS high",
      "SELECT o_orderstatus AS s, count(*) AS c, round(sum(o_totalprice)) AS total, round(avg(o_totalprice)) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
query("agg_distinct", "MATCH (p:Part) RETURN count(DISTINCT p.brand) AS b, sum(DISTINCT p.size) AS s, avg(DISTINCT p.size) AS a, min(DISTINCT p.size) AS m", "SELECT count(DISTINCT p_brand) AS b, sum(DISTINCT p_size)::BIGINT AS s, avg(DISTINCT p_size) AS a, min(p_size)::BIGINT AS m FROM part")
query("agg_empty", "MATCH (p:Part) WHERE p.size > 1000 RETURN count(*) AS c, sum(p.size) AS s, avg(p.size) AS a, collect(p.size) AS l, stDev(p.size) AS d", "SELECT 0::BIGINT AS c, 0::BIGINT AS s, NULL::DOUBLE AS a, []::BIGINT[] AS l, 0.0::DOUBLE AS d")
query("agg_stats", "MATCH (p:Part) RETURN p.brand AS b, round(stDev(p.size) * 1000) AS sd, round(stDevP(p.size) * 1000) AS sp, percentileCont(p.size, 0.3) AS pc, percentileDisc(p.size, 0.3) AS pd",
      "SELECT p_brand AS b, round(stddev_samp(p_size) * 1000) AS sd, round(stddev_pop(p_size) * 1000) AS sp, quantile_cont(p_size::DOUBLE, 0.3) AS pc, quantile_disc(p_size::DOUBLE, 0.3) AS pd FROM part GROUP BY 1")
query("agg_collect", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, c.custkey AS k ORDER BY k RETURN n.name AS n, size(collect(k)) AS s, size(collect(DISTINCT k % 7)) AS d", "SELECT n_name AS n, count(*) AS s, count(DISTINCT c_custkey % 7) AS d FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
query("agg_implicit_key", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS n, count(*) + size(n.name) AS v", "SELECT n_name AS n, count(*) + length(n_name) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
query("with_having", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WITH n, count(DISTINCT c) AS k WHERE k > 50 RETURN n.name AS n, k", "SELECT n_name AS n, count(DISTINCT c_custkey) AS k FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(DISTINCT c_custkey) > 50")

# --- rows
query("unwind", "UNWIND range(1, 5) AS i RETURN i, i * i AS sq", "SELECT i, i * i AS sq FROM (SELECT unnest(range(1, 6)) AS i)")
query("union_all", "MATCH (r:Region) RETURN r.name AS n UNION ALL MATCH (x:Nation) WHERE x.nationkey < 3 RETURN x.name AS n", "SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 3")
query("union", "MATCH (c:Customer) RETURN c.mktsegment AS s UNION MATCH (o:Order) RETURN o.orderpriority AS s", "SELECT c_mktsegment AS s FROM customer UNION SELECT o_orderpriority FROM orders")
query("order_skip_limit", "MATCH (o:Order) RETURN o.orderkey AS k, o.totalprice AS p ORDER BY p DESC, k SKIP 3 LIMIT 5", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY p DESC, k OFFSET 3 LIMIT 5")
query("with_limit_where", "MATCH (o:Order) WITH o ORDER BY o.orderkey LIMIT 100 WHERE o.totalprice > 200000 RETURN o.orderkey AS k", "SELECT o_orderkey AS k FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) WHERE o_totalprice > 200000")
query("distinct_rows", "MATCH (o:Order) RETURN DISTINCT o.orderstatus AS s", "SELECT DISTINCT o_orderstatus AS s FROM orders")

# --- expressions
query("case_forms", "MATCH (p:Part) RETURN p.partkey AS k, CASE p.brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 0 END AS a, CASE WHEN p.size > 40 THEN 'big' WHEN p.size > 20 THEN 'mid' END AS b",
      "SELECT p_partkey AS k, CASE p_brand WHEN 'Brand#1' THEN 1 WHEN 'Brand#2' THEN 2 ELSE 0 END::BIGINT AS a, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' END AS b FROM part")
query("list_ops", "UNWIND range(1, 6) AS i WITH i, range(1, i) AS l RETURN i, l[0] AS first, l[-1] AS last, l[9] AS gone, l[1..3] AS mid, [x IN l WHERE x % 2 = 0 | x * 10] AS even, head(l) AS h, last(l) AS t, tail(l) AS r, reverse(l) AS rev, l + 7 AS more, 3 IN l AS has",
      "SELECT i, 1::BIGINT AS first, i AS last, NULL::BIGINT AS gone, l[2:3] AS mid, list_transform(list_filter(l, lambda x: x % 2 = 0), lambda x: x * 10) AS even, 1::BIGINT AS h, i AS t, l[2:] AS r, list_reverse(l) AS rev, list_append(l, 7) AS more, i >= 3 AS has FROM (SELECT i, range(1, i + 1) AS l FROM (SELECT unnest(range(1, 7)) AS i))")
query("list_quant", "MATCH (p:Part) WITH p, split(p.name, ' ') AS w RETURN p.partkey AS k, any(x IN w WHERE x CONTAINS 'e') AS a, all(x IN w WHERE size(x) > 3) AS b, none(x IN w WHERE x = 'red') AS c, single(x IN w WHERE x STARTS WITH 'p') AS d",
      "SELECT p_partkey AS k, len(list_filter(w, lambda x: contains(x, 'e'))) > 0 AS a, len(list_filter(w, lambda x: length(x) <= 3)) = 0 AS b, len(list_filter(w, lambda x: x = 'red')) = 0 AS c, len(list_filter(w, lambda x: starts_with(x, 'p'))) = 1 AS d FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
query("string_fns", "MATCH (c:Customer) RETURN c.custkey AS k, toUpper(c.name) AS u, toLower(c.name) AS l, substring(c.name, 3, 4) AS s, left(c.name, 4) AS a, right(c.name, 2) AS z, replace(c.name, '0', 'o') AS r, reverse(c.mktsegment) AS v, size(c.name) AS n, trim('  ' + c.mktsegment + ' ') AS t, split(c.name, '#')[1] AS p",
      "SELECT c_custkey AS k, upper(c_name) AS u, lower(c_name) AS l, substr(c_name, 4, 4) AS s, left(c_name, 4) AS a, right(c_name, 2) AS z, replace(c_name, '0', 'o') AS r, reverse(c_mktsegment) AS v, length(c_name) AS n, c_mktsegment AS t, split_part(c_name, '#', 2) AS p FROM customer")
query("string_preds", "MATCH (p:Part) WHERE p.name STARTS WITH 'p' OR p.name ENDS WITH '7' OR p.type CONTAINS 'STEEL' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE starts_with(p_name, 'p') OR ends_with(p_name, '7') OR contains(p_type, 'STEEL')")
query("regex", "MATCH (c:Customer) WHERE c.name =~ '0[1-3]+$' RETURN c.custkey AS k", "SELECT c_custkey AS k FROM customer WHERE regexp_matches(c_name, '0[1-3]+$')")
query("math_fns", "MATCH (p:Part) RETURN p.partkey AS k, abs(-p.size) AS a, sign(p.size - 25) AS s, ceil(p.retailprice) AS c, floor(p.retailprice) AS f, round(p.retailprice) AS r, round(sqrt(p.size) * 1000) AS q, round(log10(p.size) * 1000) AS l, round(exp(1) * 1000) AS e, round(sin(p.size) * 1000) AS i",
      "SELECT p_partkey AS k, p_size::BIGINT AS a, sign(p_size - 25)::BIGINT AS s, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(p_retailprice) AS r, round(sqrt(p_size) * 1000) AS q, round(log10(p_size) * 1000) AS l, 2718.0::DOUBLE AS e, round(sin(p_size) * 1000) AS i FROM part")
query("int_arith", "UNWIND [-7, 7, 0] AS a UNWIND [2, -2, 0] AS b RETURN a, b, a / b AS q, a % b AS m, a - b AS d, a * b AS p, 2 ^ b AS w", "SELECT a, b, CASE WHEN b <> 0 THEN a // b END AS q, CASE WHEN b <> 0 THEN a % b END AS m, a - b AS d, a * b AS p, 2.0::DOUBLE ** b AS w FROM (SELECT unnest([-7, 7, 0]::BIGINT[]) AS a), (SELECT unnest([2, -2, 0]::BIGINT[]) AS b)")
query("convert_fns", "UNWIND ['12', '12.7', 'x', '-3', 'true'] AS s RETURN s, toInteger(s) AS i, toFloat(s) AS f, toBoolean(s) AS b, toString(1.5) AS t, toInteger(3.9) AS n", "SELECT s, trunc(TRY_CAST(s AS DOUBLE))::BIGINT AS i, TRY_CAST(s AS DOUBLE) AS f, CASE s WHEN 'true' THEN true END AS b, '1.5' AS t, 3::BIGINT AS n FROM (SELECT unnest(['12', '12.7', 'x', '-3', 'true']) AS s)")
query("null_logic", "UNWIND [true, false, null] AS a UNWIND [true, false, null] AS b RETURN a, b, a AND b AS c, a OR b AS d, a XOR b AS x, NOT a AS n, a = b AS e, a IS NULL AS i", "SELECT a, b, a AND b AS c, a OR b AS d, a <> b AS x, NOT a AS n, a = b AS e, a IS NULL AS i FROM (SELECT unnest([true, false, NULL]) AS a), (SELECT unnest([true, false, NULL]) AS b)")
query("null_fns", "MATCH (c:Customer) RETURN c.custkey AS k, coalesce(c.nothing, c.name) AS n, c.nothing IS NULL AS g, c.nothing = 1 AS e", "SELECT c_custkey AS k, c_name AS n, true AS g, NULL::BOOLEAN AS e FROM customer")
query("date_parts", "MATCH (o:Order) RETURN o.orderkey AS k, o.orderdate.year AS y, o.orderdate.month AS m, o.orderdate.day AS d, o.orderdate.quarter AS q, o.orderdate.week AS w, o.orderdate.dayOfWeek AS wd, o.orderdate.ordinalDay AS od",
      "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, week(o_orderdate) AS w, isodow(o_orderdate) AS wd, dayofyear(o_orderdate) AS od FROM orders")
query("date_trunc", "MATCH (o:Order) RETURN toString(date.truncate('month', o.orderdate)) AS m, count(*) AS c", "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, count(*) AS c FROM orders GROUP BY 1")
query("date_arith", "MATCH (o:Order) RETURN o.orderkey AS k, toString(date(o.orderdate) + duration('P1M2D')) AS d, duration.inDays(date('1990-01-01'), date(o.orderdate)).days AS n", "SELECT o_orderkey AS k, strftime(o_orderdate::DATE + INTERVAL 1 MONTH + INTERVAL 2 DAY, '%Y-%m-%d') AS d, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS n FROM orders")
query("durations", "UNWIND ['P1Y2M3DT4H5M6S', 'PT90M', 'P2W'] AS s WITH s, duration(s) AS d RETURN s, d.months AS m, d.days AS n, d.seconds AS c, toString(d + duration('P1D')) AS t", "SELECT * FROM (VALUES ('P1Y2M3DT4H5M6S', 14::BIGINT, 3::BIGINT, 14706::BIGINT, 'P1Y2M4DT4H5M6S'), ('PT90M', 0, 0, 5400, 'P1DT1H30M'), ('P2W', 0, 14, 0, 'P15D')) AS v(s, m, n, c, t)")
query("entity_fns", "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 450000 RETURN o.orderkey AS k, id(startNode(r)) = id(c) AS s, endNode(r).orderkey AS e, type(r) AS t, labels(c) AS l, keys(r) AS ks, size(keys(c)) AS n, exists(c.name) AS x",
      "SELECT o_orderkey AS k, true AS s, o_orderkey AS e, 'PLACED' AS t, ['Customer'] AS l, ['date'] AS ks, 5::BIGINT AS n, true AS x FROM orders WHERE o_totalprice > 450000")
query("maps", "MATCH (n:Nation) WITH {name: n.name, key: n.nationkey} AS m RETURN m.name AS a, m['key'] AS b, m.gone AS c, keys(m) AS k", "SELECT n_name AS a, n_nationkey::BIGINT AS b, NULL::VARCHAR AS c, ['name', 'key'] AS k FROM nation")
query("label_pred", "MATCH (x)-[:IN_NATION]->(n:Nation) WHERE x:Supplier RETURN count(*) AS c", "SELECT count(*) AS c FROM supplier")


# --- writing
def _written(spark: SparkSession, sf_dir: str, *steps: str) -> DataFrame:
    g = sample_graph(spark, sf_dir)
    for text in steps[:-1]:
        g.query(text).count()
    return _tidy(g.query(steps[-1]))


@custom("crud_create", "SELECT n_name AS n, n_nationkey * 2 AS v, count(*) AS c FROM nation WHERE n_nationkey < 10 GROUP BY 1, 2")
def crud_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "MATCH (n:Nation) WHERE n.nationkey < 10 CREATE (n)-[:HAS {v: n.nationkey * 2}]->(t:Tag {name: n.name})", "MATCH (n:Nation)-[h:HAS]->(t:Tag) RETURN t.name AS n, h.v AS v, count(*) AS c")


@custom("crud_set", "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey < 2 THEN 'low' ELSE r_name END AS n, CASE WHEN r_regionkey < 2 THEN r_regionkey + 1 END::BIGINT AS x FROM region")
def crud_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "MATCH (r:Region) WHERE r.regionkey < 2 SET r.name = 'low', r.x = r.regionkey + 1", "MATCH (r:Region) RETURN r.regionkey AS k, r.name AS n, r.x AS x")


@custom("crud_delete", "SELECT count(*) AS c FROM nation WHERE n_nationkey >= 5")
def crud_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "MATCH (n:Nation) WHERE n.nationkey < 5 DETACH DELETE n", "MATCH (n:Nation)-[:IN_REGION]->(r) RETURN count(*) AS c")


@custom("merge", "SELECT c_mktsegment AS s, CASE WHEN c_mktsegment = 'BUILDING' OR count(*) > 1 THEN 'old' ELSE 'new' END AS how FROM customer GROUP BY 1")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "CREATE (:Segment {name: 'BUILDING'})", "MATCH (c:Customer) MERGE (s:Segment {name: c.mktsegment}) ON CREATE SET s.how = 'new' ON MATCH SET s.how = 'old'", "MATCH (s:Segment) RETURN s.name AS s, s.how AS how")


@custom("foreach_remove", "SELECT i AS v, NULL::BIGINT AS w, i = 2 AS odd FROM (SELECT unnest([1, 2, 3]::BIGINT[]) AS i)")
def foreach_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "FOREACH (i IN [1, 2, 3] | CREATE (:Made {v: i, w: i}))", "MATCH (m:Made) REMOVE m.w", "MATCH (m:Made {v: 2}) SET m:Odd", "MATCH (m:Made) RETURN m.v AS v, m.w AS w, m:Odd AS odd")


# --- the imperative interface
@custom("api_neighbours", "SELECT count(*) AS c FROM orders WHERE o_custkey = 7")
def api_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sample_graph(spark, sf_dir)
    node = g.find_nodes("Customer", {"custkey": 7}).first()["node_id"]
    return g.neighbours(node, "out", "PLACED").agg(F.count(F.lit(1)).alias("c"))


@custom("api_stats", "SELECT 'Nation' AS name, count(*) AS live_rows FROM nation UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem")
def api_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_graph(spark, sf_dir).am_stats().where(F.col("name").isin("Nation", "Order", "PLACED", "CONTAINS")).select("name", "live_rows")


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return sample_graph(spark, sf_dir)


# --- views
@custom("view_full", "SELECT n_name AS n, count(c_custkey) + CASE WHEN n_nationkey = 1 THEN 1 ELSE 0 END AS c FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def view_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.views import Views

    g = sample_graph(spark, sf_dir)
    views = Views(g)
    views.create("per_nation", "MATCH (c)-[:IN_NATION]->(n:Nation) WHERE c:Customer OR c:Guest RETURN n.name AS n, count(c) AS c")
    g.query("MATCH (n:Nation {nationkey: 1}) CREATE (:Guest {name: 'g'})-[:IN_NATION]->(n)")
    views.refresh()
    return _tidy(views.read("per_nation"))


@custom("view_delta", "SELECT r_name AS n, CASE WHEN r_regionkey = 2 THEN 20 ELSE r_regionkey END::BIGINT AS k FROM region WHERE r_regionkey BETWEEN 1 AND 3 UNION ALL SELECT 'new', 9")
def view_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.views import Views

    g = sample_graph(spark, sf_dir)
    views = Views(g)
    views.create("regions", "MATCH (r:Region) WHERE r.regionkey >= 1 RETURN r.name AS n, r.regionkey AS k")
    g.query("MATCH (r:Region {regionkey: 2}) SET r.regionkey = 20")
    views.refresh()
    g.query("MATCH (r:Region {regionkey: 4}) DETACH DELETE r")
    g.query("CREATE (:Region {name: 'new', regionkey: 9})")
    views.refresh()
    return _tidy(views.read("regions"))


@custom("change_feed", "SELECT * FROM (VALUES ('NodeUpdate', 2::BIGINT), ('NodeInsert', 1::BIGINT), ('EdgeInsert', 1::BIGINT), ('Begin', 2::BIGINT), ('Commit', 2::BIGINT)) AS v(op, c)")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.sources.storage import shared_dir
    from skein.streaming.changes import ChangeFeed

    g = sample_graph(spark, sf_dir)
    feed = ChangeFeed(g, shared_dir(spark))
    g.query("MATCH (r:Region) WHERE r.regionkey < 2 SET r.seen = true")
    g.query("MATCH (r:Region {regionkey: 3}) CREATE (r)-[:NEAR]->(:Place {v: 1})")
    return feed.read().groupBy("op").agg(F.count(F.lit(1)).alias("c"))


from skein import more_queries  # noqa: E402, F401  registers its queries
