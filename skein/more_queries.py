"""Queries for what the others leave out: rules that raise, schema statements, storage, the imperative interface, temporal values, views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import GraphError
from skein.queries import _tidy, _written, custom, query
from skein.sources.graph import Graph
from skein.sources.storage import shared_dir
from skein.sources.tables import sample_graph

# --- scans and hops
query("scan_two_labels", "MATCH (n:Customer:Supplier) RETURN count(*) AS c", "SELECT 0::BIGINT AS c")
query("expand_unknown_end", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(x:Nowhere) RETURN c.custkey AS k, x IS NULL AS gone, count(x) AS c", "SELECT c_custkey AS k, true AS gone, 0::BIGINT AS c FROM customer")
query("expand_null_source", "MATCH (n:Nation) OPTIONAL MATCH (n)-[:NOTHING]->(x) OPTIONAL MATCH (x)-[:PLACED]->(o) RETURN n.nationkey AS k, count(o) AS c", "SELECT n_nationkey::BIGINT AS k, 0::BIGINT AS c FROM nation")
query("bound_rel_list", "MATCH (a:Customer)-[r:PLACED|SUPPLIED_BY*2]->(b:Supplier) WITH r, a LIMIT 100 MATCH (x:Customer)-[r*]->(y) WHERE x = a RETURN count(*) AS c", "SELECT 100::BIGINT AS c")
query("path_ends", "MATCH p = (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 450000 RETURN o.orderkey AS k, id(startNode(relationships(p)[0])) = id(c) AS s, nodes(p)[1].orderkey AS e, nodes(p)[0].name AS n", "SELECT o_orderkey AS k, true AS s, o_orderkey AS e, c_name AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 450000")
query("path_quantified", "MATCH p = (a:Event)-[:NEXT*2]->() RETURN all(x IN nodes(p) WHERE x.value > 20) AS high, count(*) AS c",
      "WITH nxt AS (SELECT event_id AS s, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value AS v, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS u FROM events) SELECT v > 20 AND w > 20 AND x > 20 AS high, count(*) AS c FROM nxt WHERE u IS NOT NULL GROUP BY 1")
query("return_star", "MATCH (r:Region) WITH r.name AS name, r.regionkey AS key RETURN *", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
query("column_names", "MATCH (r:Region) WITH r.regionkey AS k RETURN k, k + 1, size('abc')", "SELECT r_regionkey::BIGINT AS k, r_regionkey::BIGINT + 1 AS \"k + 1\", 3::BIGINT AS \"size('abc')\" FROM region")
query("empty_rows", "MATCH (r:Region) WHERE false RETURN r.name AS n", "SELECT r_name AS n FROM region WHERE false")
query("echo_proc", "MATCH (r:Region) CALL test.my.proc(r.regionkey * 2) YIELD out RETURN r.name AS n, out", "SELECT r_name AS n, r_regionkey::BIGINT * 2 AS out FROM region")

# --- expressions
query("chained_comparison", "MATCH (p:Part) WHERE 10 < p.size <= 20 RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 10 AND p_size <= 20")
query("mixed_comparison", "UNWIND [1, 2] AS i RETURN i, i < 'a' AS a, i = 'a' AS b, 1 < 1.5 AS c", "SELECT i, NULL::BOOLEAN AS a, false AS b, true AS c FROM (SELECT unnest([1, 2]::BIGINT[]) AS i)")
query("mixed_values", "WITH [10, 'b', 9, true, 2.5, 'a'] AS l UNWIND l AS x WITH x, l ORDER BY x RETURN max(x) AS m, min(x) AS n, toString(collect(x)[0]) AS first, size(collect(x)) AS c, any(y IN collect(x) WHERE y = '10') AS text, any(y IN collect(x) WHERE y = 10) AS number", "SELECT '10' AS m, 'a' AS n, 'a' AS first, 6::BIGINT AS c, false AS text, true AS number")
query("mixed_lists", "UNWIND [1, 2] AS i RETURN i, [i, 'a'] = ['1', 'a'] AS t, [i, 'a'] = [1.0, 'a'] AS n, 'a' IN [i, 'a'] AS has, [x IN [i, 'a', true] WHERE x > 1] AS more, [i, 'a'] AS l", "SELECT i, false AS t, i = 1 AS n, true AS has, CASE WHEN i = 2 THEN ['2'] ELSE []::VARCHAR[] END AS more, [i::VARCHAR, 'a'] AS l FROM (SELECT unnest([1, 2]::BIGINT[]) AS i)")
query("angles", "UNWIND [0, 90, 180] AS d RETURN d, round(toRadians(d) * 1000) AS r, round(toDegrees(toRadians(d))) AS b", "SELECT d, round(radians(d) * 1000) AS r, d::DOUBLE AS b FROM (SELECT unnest([0, 90, 180]::BIGINT[]) AS d)")
query("random_fns", "MATCH (p:Part) WITH rand() AS r, randomUUID() AS u RETURN min(r) >= 0 AND max(r) < 1 AS inside, count(DISTINCT u) = count(*) AS apart, min(size(u)) AS n", "SELECT true AS inside, true AS apart, 36::BIGINT AS n")
query("float_text", "UNWIND [1.0, 0.5, 1e20, -2.5e21, 1e-20, 123456789.25] AS x RETURN x, toString(x) AS t", "SELECT * FROM (VALUES (1.0::DOUBLE, '1.0'), (0.5, '0.5'), (1e20, '100000000000000000000.0'), (-2.5e21, '-2500000000000000000000.0'), (1e-20, '0.00000000000000000001'), (123456789.25, '123456789.25')) AS v(x, t)")

# --- temporal values
query("zoned", """UNWIND ['2020-01-01T10:00+02:00', '2020-07-01T10:00:30.5Z', '2020-01-01T00:00-11:30'] AS s WITH s, datetime(s) AS d
      RETURN s, toString(d) AS t, d.offset AS o, d.hour AS h, d.epochSeconds AS e, toString(d + duration('P1MT30M')) AS p, toString(datetime.truncate('day', d)) AS day, toString(date(d)) AS dd""",
      """SELECT * FROM (VALUES ('2020-01-01T10:00+02:00', '2020-01-01T10:00+02:00', '+02:00', 10::BIGINT, 1577865600::BIGINT, '2020-02-01T10:30+02:00', '2020-01-01T00:00+02:00', '2020-01-01'),
      ('2020-07-01T10:00:30.5Z', '2020-07-01T10:00:30.5Z', 'Z', 10, 1593597630, '2020-08-01T10:30:30.5Z', '2020-07-01T00:00Z', '2020-07-01'), ('2020-01-01T00:00-11:30', '2020-01-01T00:00-11:30', '-11:30', 0, 1577878200, '2020-02-01T00:30-11:30', '2020-01-01T00:00-11:30', '2020-01-01')) AS v(s, t, o, h, e, p, day, dd)""")  # fmt: skip
query("zone_names", "WITH datetime({year: 2020, month: 7, day: 1, hour: 12, timezone: 'Europe/Stockholm'}) AS d RETURN toString(d) AS t, d.timezone AS z, d.offset AS o, toString(d + duration('P6M')) AS w, d > datetime('2020-07-01T11:00Z') AS later, datetime('2020-01-01T10:00+02:00') = datetime('2020-01-01T08:00Z') AS same",
      "SELECT '2020-07-01T12:00+02:00[Europe/Stockholm]' AS t, 'Europe/Stockholm' AS z, '+02:00' AS o, '2021-01-01T12:00+01:00[Europe/Stockholm]' AS w, false AS later, true AS same")
query("temporal_maps", "RETURN toString(date({year: 2020, week: 10, dayOfWeek: 3})) AS a, toString(date({year: 2020, ordinalDay: 60})) AS b, toString(localtime({hour: 4, minute: 5, second: 6, millisecond: 7})) AS c, toString(time({hour: 4, timezone: '+01:00'})) AS d, toString(localdatetime({year: 2020, quarter: 2, dayOfQuarter: 3, hour: 5})) AS e",
      "SELECT '2020-03-04' AS a, '2020-02-29' AS b, '04:05:06.007' AS c, '04:00+01:00' AS d, '2020-04-03T05:00' AS e")
query("temporal_texts", "RETURN toString(localtime('101112.5')) AS a, toString(time('10:11+0130')) AS b, toString(localdatetime('2020-W10-3T10')) AS c, toString(datetime.fromepoch(0, 5000)) AS d, toString(datetime.fromepochmillis(1500)) AS e", "SELECT '10:11:12.5' AS a, '10:11+01:30' AS b, '2020-03-04T10:00' AS c, '1970-01-01T00:00:00.000005Z' AS d, '1970-01-01T00:00:01.5Z' AS e")
query("temporal_now", "RETURN date() = date.transaction() AS a, datetime() >= datetime('2020-01-01T00:00Z') AS b, localtime() IS NOT NULL AS c", "SELECT true AS a, true AS b, true AS c")
query("temporal_order", "UNWIND ['2020-01-02', '2019-12-31', '2020-01-01'] AS s WITH date(s) AS d ORDER BY d RETURN collect(toString(d)) AS l, min(d) < max(d) AS b", "SELECT ['2019-12-31', '2020-01-01', '2020-01-02'] AS l, true AS b")
query("temporal_between", "WITH date('2019-01-31') AS a, localdatetime('2020-03-01T12:30') AS b RETURN toString(duration.between(a, b)) AS d, toString(duration.inMonths(a, b)) AS m, toString(duration.inSeconds(a, b)) AS s, toString(duration('P1M') * 2) AS t, toString(date.truncate('quarter', b)) AS q",
      "SELECT 'P1Y1M1DT12H30M' AS d, 'P1Y1M' AS m, 'PT9492H30M' AS s, 'P2M' AS t, '2020-01-01' AS q")


# --- rules that raise
_BAD = {
    "undefined": ("RETURN nothing", "UndefinedVariable"),
    "bound_again": ("MATCH (a:Region) CREATE (a:Region)", "VariableAlreadyBound"),
    "kind_conflict": ("MATCH (a:Nation)-[a]->() RETURN a", "VariableTypeConflict"),
    "rel_twice": ("MATCH (a)-[r]->()-[r]->(b) RETURN a", "RelationshipUniquenessViolation"),
    "no_alias": ("MATCH (r:Region) WITH r.name RETURN 1", "NoExpressionAlias"),
    "column_twice": ("MATCH (r:Region) RETURN r.name AS n, r.regionkey AS n", "ColumnNameConflict"),
    "star_of_nothing": ("RETURN *", "NoVariablesInScope"),
    "hidden_order": ("MATCH (r:Region) RETURN DISTINCT r.name AS n ORDER BY r.regionkey", "UndefinedVariable"),
    "size_of_number": ("RETURN size(1)", "InvalidArgumentType"),
    "labels_of_text": ("RETURN labels('x')", "InvalidArgumentType"),
    "union_columns": ("RETURN 1 AS a UNION RETURN 2 AS b", "DifferentColumnsInUnion"),
    "undirected_create": ("CREATE (:A)-[:R]-(:B)", "RequiresDirectedRelationship"),
    "untyped_create": ("CREATE (:A)-[]->(:B)", "NoSingleRelationshipType"),
    "delete_number": ("DELETE 1", "InvalidArgumentType"),
    "where_node": ("MATCH (r:Region) WHERE r RETURN r.name AS n", "InvalidArgumentType"),
    "nested_aggregate": ("MATCH (r:Region) RETURN count(count(*)) AS c", "NestedAggregation"),
    "aggregate_in_where": ("MATCH (r:Region) WHERE count(r) > 1 RETURN r.name AS n", "InvalidAggregation"),
    "pattern_as_value": ("MATCH (r:Region) RETURN (r)-->() AS p", "UnexpectedSyntax"),
    "unknown_function": ("RETURN nope(1) AS x", "UnknownFunction"),
    "unknown_procedure": ("CALL no.such() YIELD x RETURN x", "ProcedureNotFound"),
    "negative_limit": ("RETURN 1 AS x LIMIT -1", "NegativeIntegerArgument"),
    "share_out_of_range": ("MATCH (r:Region) RETURN percentileCont(r.nothing, 1.5) AS p", "NumberOutOfRange"),
    "merge_null": ("MERGE (x:Y {v: null})", "MergeReadOwnWrites"),
    "nested_property": ("CREATE (:A {v: {b: 1}})", "InvalidPropertyType"),
    "connected_delete": ("MATCH (n:Nation {nationkey: 1}) DELETE n", "DeleteConnectedNode"),
    "bad_date": ("RETURN date('2020-13-01') AS d", "InvalidDate"),
    "parse": ("MATCH (r RETURN r", "UnexpectedSyntax"),
}


@custom("rules", "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{code}')" for name, (_, code) in _BAD.items()) + ") AS v(name, code)")
def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sample_graph(spark, sf_dir)
    rows = []
    for name, (text, _) in _BAD.items():
        try:
            g.query(text).count()
            rows.append((name, "none"))
        except GraphError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "name string, code string")


# --- writing
@custom("set_forms", "SELECT r_regionkey::BIGINT AS k, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_name END AS n, CASE r_regionkey WHEN 0 THEN 5 WHEN 1 THEN 6 END::BIGINT AS x, CASE WHEN r_regionkey = 1 THEN 'y' END AS y FROM region")
def set_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "MATCH (r:Region {regionkey: 0}) SET r = {regionkey: 0, x: 5}", "MATCH (r:Region {regionkey: 1}) SET r += {x: 6, y: 'y'}", "MATCH (r:Region) RETURN r.regionkey AS k, r.name AS n, r.x AS x, r.y AS y")


@custom("merge_rows", "SELECT * FROM (VALUES (1::BIGINT, 2::BIGINT), (2, 1)) AS v(v, c)")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "UNWIND [1, 1, 2] AS i MERGE (n:M {v: i}) ON CREATE SET n.c = 1 ON MATCH SET n.c = 2", "MATCH (n:M) RETURN n.v AS v, n.c AS c")


@custom("merge_rel", "SELECT r_name AS n, (count(*) > 0)::INT::BIGINT AS c FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def merge_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written(spark, sf_dir, "MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (r)-[:HAS]->(t:Tag {name: r.name})", "MATCH (r:Region)-[h:HAS]->(t:Tag) RETURN t.name AS n, count(h) AS c")


@custom("constraints", "SELECT * FROM (VALUES ('created', 1::BIGINT), ('rejected', 1), ('dropped', 0), ('nodes', 1)) AS v(what, c)")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark)
    g.query("CREATE (:U {v: 1})").count()
    g.query("CREATE CONSTRAINT ON (u:U) ASSERT u.v IS UNIQUE").count()
    rows = [("created", g.show_constraints().count())]
    try:
        g.query("CREATE (:U {v: 1})").count()
        rows.append(("rejected", 0))
    except GraphError:
        rows.append(("rejected", 1))
    g.drop_constraint("U", "v")
    return spark.createDataFrame([*rows, ("dropped", g.show_constraints().count()), ("nodes", g.count_nodes())], "what string, c long")


@custom("indexes", "SELECT c_custkey AS k, 'Customer.custkey' AS i FROM customer WHERE c_custkey IN (5, 700)")
def indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sample_graph(spark, sf_dir)
    g.query("CREATE INDEX ON :Customer(custkey)").count()
    names = ",".join(f"{r['label']}.{r['property']}" for r in g.show_indexes().collect())
    return _tidy(g.query("MATCH (c:Customer) WHERE c.custkey IN [5, 700] RETURN c.custkey AS k")).withColumn("i", F.lit(names))


# --- storage and the imperative interface
@custom("save_load", "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON r_regionkey = n_regionkey")
def save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    sample_graph(spark, sf_dir).save(path)
    return _tidy(Graph.load(spark, path).query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r"))


@custom("relational", "SELECT r_name AS r, count(*) AS c FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def relational(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample_graph(spark, sf_dir).register("g_")
    return spark.sql(
        "SELECT get_json_object(n.properties, '$.name') AS r, count(*) AS c FROM g_edges e JOIN g_nodes n ON n.node_id = e.target_node_id WHERE e.rel_type = 'IN_REGION' GROUP BY 1"
    )


@custom("json_rows", "SELECT '{\"k\":' || r_regionkey || ',\"n\":\"' || r_name || '\",\"x\":null,\"l\":[1,2]}' AS row FROM region")
def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_graph(spark, sf_dir).query_json("MATCH (r:Region) RETURN r.regionkey AS k, r.name AS n, r.nothing AS x, [1, 2] AS l")


@custom("api_reads", "SELECT (SELECT count(*) FROM orders WHERE o_custkey = 7) AS hop, (SELECT count(*) FROM orders WHERE o_custkey = 7) AS edges, (SELECT c_name FROM customer WHERE c_custkey = 7) AS name, 'PLACED' AS type, 8::BIGINT AS labels")
def api_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = sample_graph(spark, sf_dir)
    node = g.find_nodes("Customer", {"custkey": 7}).first()["node_id"]
    edges = g.find_edges(source=node, type="PLACED")
    edge = edges.first()
    name = g.get_node(node)["properties"]["name"]
    kind = g.get_edge(edge["rel_id"])["type"] if edge else "PLACED"
    return spark.createDataFrame([(g.expand(node, "out", "PLACED").count(), edges.count(), name, kind, len(g.labels()))], "hop long, edges long, name string, type string, labels long")


@custom("api_counts", "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes, (SELECT count(*) FROM nation) AS edges, true AS ok")
def api_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = sample_graph(spark, sf_dir)
    g = Graph(spark)
    g.nodes, g.edges = {n: whole.nodes[n] for n in ("Nation", "Region")}, {"IN_REGION": whole.edges["IN_REGION"]}
    info = g.schema_info()
    return spark.createDataFrame([(g.count_nodes(), g.count_edges(), info["labels"] == ["Nation", "Region"] and info["edges"] == g.count_edges() and g.health_check()["ok"])], "nodes long, edges long, ok boolean")


@custom("api_writes", "SELECT 'b' AS name, 3::BIGINT AS age, ['P', 'Q'] AS labels, 1::BIGINT AS edges")
def api_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark)
    a, b, c = (g.create_node(["P"], {"name": n, "age": 1}) for n in "abc")
    g.create_edge(a, b, "R", {"w": 1})
    gone = g.create_edge(b, c, "R")
    g.delete_edge(gone)
    g.detach_delete_node(c)
    g.update_node(b, {"name": "b", "age": 3})
    g.add_label(b, "Q")
    return g.query("MATCH (x)-[r:R]->(y) RETURN y.name AS name, y.age AS age, labels(y) AS labels, count(r) AS edges")


@custom("explained", "SELECT true AS clauses, true AS estimate, true AS ran")
def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = sample_graph(spark, sf_dir).explain("MATCH (r:Region) RETURN r.name AS n", analyze=True)
    return spark.createDataFrame([("Match (Region)" in text, "Estimate:" in text, "Rows: " in text)], "clauses boolean, estimate boolean, ran boolean")


@custom("self_loops", "SELECT * FROM (VALUES ('out', 2::BIGINT), ('in', 2), ('both', 3)) AS v(d, c)")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = Graph(spark)
    g.query("CREATE (a:A)-[:R]->(a), (a)-[:R]->(:B)").count()
    return spark.createDataFrame([(d, g.query(f"MATCH (x){p}(y) RETURN count(*) AS c").first()["c"]) for d, p in (("out", "-[:R]->"), ("in", "<-[:R]-"), ("both", "-[:R]-"))], "d string, c long")


# --- views
def _views(spark: SparkSession, sf_dir: str):
    from skein.streaming.views import Views

    g = sample_graph(spark, sf_dir)
    return g, Views(g)


@custom("view_delta_rel", "SELECT n_name AS n, CASE n_regionkey WHEN 1 THEN 'moved' ELSE r_name END AS r FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 3 UNION ALL SELECT 'new', 'moved'")
def view_delta_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, views = _views(spark, sf_dir)
    assert views.create("pairs", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r").mode == "DIFFERENTIAL"
    g.query("MATCH (r:Region {regionkey: 1}) SET r.name = 'moved'").count()
    g.query("MATCH (n:Nation {nationkey: 3})-[x:IN_REGION]->() DELETE x").count()
    g.query("MATCH (r:Region {regionkey: 1}) CREATE (:Nation {name: 'new'})-[:IN_REGION]->(r)").count()
    views.refresh()
    return _tidy(views.read("pairs"))


@custom("view_delta_agg", "SELECT r_name AS r, count(*) AS c, max(n_name) AS m FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey NOT IN (0, 5) GROUP BY 1 UNION ALL SELECT 'x', 1, 'new'")
def view_delta_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, views = _views(spark, sf_dir)
    assert views.create("sizes", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS r, count(*) AS c, max(n.name) AS m").mode == "DIFFERENTIAL"
    g.query("MATCH (n:Nation) WHERE n.nationkey IN [0, 5] DETACH DELETE n").count()
    g.query("CREATE (:Nation {name: 'new'})-[:IN_REGION]->(:Region {name: 'x'})").count()
    views.refresh()
    return _tidy(views.read("sizes"))


@custom("view_dag", "SELECT * FROM (VALUES ('base', 0::BIGINT, 26::BIGINT), ('top', 1, 1)) AS v(name, place, n)")
def view_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, views = _views(spark, sf_dir)
    views.create("base", "MATCH (n:Nation) RETURN n.name AS n")
    views.create("top", "MATCH (n:Nation) RETURN count(*) AS c", reads=("base",))
    g.query("CREATE (:Nation {name: 'new'})").count()
    order = views.refresh()
    return spark.createDataFrame([(n, order.index(n), views.read(n).count()) for n in ("base", "top")], "name string, place long, n long")


@custom("view_rules", "SELECT * FROM (VALUES ('constraint', 'ConstraintViolated', 607::BIGINT), ('writes', 'UnsupportedClause', 601), ('delta', 'UnsupportedForDifferential', 601), ('twice', 'ViewExists', 602), ('missing', 'ViewNotFound', 603), ('mode', 'InvalidRefreshMode', 604)) AS v(name, code, number)")
def view_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, views = _views(spark, sf_dir)
    views.create("kept", "MATCH (r:Region) RETURN r.name AS n")
    views.create("never", "MATCH (r:Region) WHERE r.regionkey < 0 RETURN r.regionkey AS k", constraint=True)
    tries = {
        "constraint": lambda: g.query("CREATE (:Region {regionkey: -1})"),
        "writes": lambda: views.create("a", "CREATE (:A)"),
        "delta": lambda: views.create("b", "MATCH (r:Region) RETURN r.name AS n ORDER BY n LIMIT 1", mode="DIFFERENTIAL"),
        "twice": lambda: views.create("kept", "MATCH (r:Region) RETURN r.name AS n"),
        "missing": lambda: views.drop("nothing"),
        "mode": lambda: views.create("c", "MATCH (r:Region) RETURN r.name AS n", mode="NO"),
    }
    rows = []
    for name, attempt in tries.items():
        try:
            attempt()
            rows.append((name, "none", 0))
        except GraphError as e:
            rows.append((name, e.code, e.number))
    return spark.createDataFrame(rows, "name string, code string, number long")
