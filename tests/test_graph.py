"""Queries over small graphs, with results worked out by hand or by plain Python."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skein.errors import ArgumentError, ConstraintError, GraphError, ParameterMissing, ProcedureError, QuerySyntaxError, QueryTypeError, SemanticError
from skein.sources.graph import Graph

NODES = [(1, ["P"], "ann", 30, 1.5), (2, ["P", "Q"], "bob", None, float("nan")), (3, ["P"], "cid", 25, None), (4, ["Q"], None, 40, 2.0), (5, [], "eve", 7, 0.0)]
EDGES = [(1, "K", 1, 2, 10), (2, "K", 2, 3, 20), (3, "K", 3, 1, None), (4, "K", 1, 2, 11), (5, "L", 4, 4, 1), (6, "L", 1, 4, 2), (7, "K", 2, 1, 5)]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame(NODES, "node_id long, labels array<string>, name string, age long, score double")
    edges = spark.createDataFrame(EDGES, "rel_id long, rel_type string, source_node_id long, target_node_id long, w long")
    return Graph.from_frames(spark, nodes, edges)


def rows(g, text, **params):
    return [tuple(r) for r in g.query(text, params).collect()]


def one(g, text, **params):
    return rows(g, f"RETURN {text} AS x", **params)[0][0]


def test_scans(g):
    assert sorted(rows(g, "MATCH (n:P) RETURN id(n) AS i")) == [(1,), (2,), (3,)]
    assert rows(g, "MATCH (n:P:Q) RETURN n.name AS n") == [("bob",)]
    assert rows(g, "MATCH (n) RETURN count(*) AS c, count(n.name) AS d, count(n.nope) AS e") == [(5, 4, 0)]
    assert rows(g, "MATCH (n:Nope) RETURN n") == [] and rows(g, "MATCH (n:Nope) RETURN count(*) AS c") == [(0,)]
    assert rows(g, "MATCH (n:P {age: 25.0}) RETURN n.name AS n") == [("cid",)]


def test_hops(g):
    assert rows(g, "MATCH (a)-[r:K]->(b) WHERE a.name = 'ann' RETURN count(r) AS c") == [(2,)]
    assert rows(g, "MATCH (a {name: 'ann'})<-[r:K]-(b) RETURN id(r) AS r ORDER BY r") == [(3,), (7,)]
    assert rows(g, "MATCH (a)-[r]-(b) RETURN count(*) AS c") == [(13,)]  # a self-loop is one step
    assert rows(g, "MATCH (a)-[:L]-(a) RETURN id(a) AS a") == [(4,)]
    assert rows(g, "MATCH (a:P)-[r:K {w: 20}]->(b:P) RETURN a.name AS a, b.name AS b") == [("bob", "cid")]
    assert rows(g, "MATCH (a)-[:K]->(b)-[:K]->(c) RETURN count(*) AS c") == [(sum(x[3] == y[2] and x != y for x in EDGES for y in EDGES if x[1] == y[1] == "K"),)]
    assert rows(g, "MATCH (a)-[:NOPE]->(b) RETURN count(*) AS c") == [(0,)]
    assert rows(g, "MATCH (a)-[r:K|L]->(b:Q) RETURN type(r) AS t, count(*) AS c ORDER BY t") == [("K", 2), ("L", 2)]
    assert rows(g, "MATCH (a)-[r:K]->(b) MATCH (a)-[r]->(c) RETURN count(*) AS c") == [(5,)]


def test_optional_and_existence(g):
    assert rows(g, "MATCH (n) OPTIONAL MATCH (n)-[r:K]->(m:Q) WHERE r.w > 10 RETURN id(n) AS n, m.name AS m ORDER BY n") == [(1, "bob"), (2, None), (3, None), (4, None), (5, None)]
    assert rows(g, "OPTIONAL MATCH (n:Nope) RETURN n.x AS x") == [(None,)]
    assert rows(g, "MATCH (n) OPTIONAL MATCH (n)-[:K]->(m) OPTIONAL MATCH (m)-[:L]->(o) RETURN count(o) AS c") == [(2,)]
    assert rows(g, "MATCH (n) WHERE (n)-[:L]->() RETURN id(n) AS n ORDER BY n") == [(1,), (4,)]
    assert rows(g, "MATCH (n) WHERE NOT (n)--() RETURN id(n) AS n") == [(5,)]
    assert rows(g, "MATCH (n) WHERE EXISTS { (n)-[r:K]->(m) WHERE m.age < n.age } OR n.name = 'eve' RETURN id(n) AS n ORDER BY n") == [(5,)]
    assert rows(g, "MATCH (n) RETURN id(n) AS n, size([(n)-[r:K]->(m) WHERE r.w > 5 | m.name]) AS s ORDER BY n") == [(1, 2), (2, 1), (3, 0), (4, 0), (5, 0)]
    assert rows(g, "MATCH (n:P) WHERE EXISTS { MATCH (n)-[:K]->(m) WITH m, count(*) AS c WHERE c > 1 RETURN m } RETURN n.name AS n") == [("ann",)]


def paths(low, high, kinds=("K", "L"), both=False):
    out = []
    steps = [(e[0], e[2], e[3]) for e in EDGES if e[1] in kinds]
    if both:
        steps += [(i, t, s) for i, s, t in steps if s != t]

    def grow(at, used):
        if low <= len(used) <= high:
            out.append((used, at))
        if len(used) < high:
            for i, s, t in steps:
                if s == at and i not in used:
                    grow(t, [*used, i])

    for n in NODES:
        grow(n[0], [])
    return out


@pytest.mark.parametrize(("span", "low", "high"), [("*1..3", 1, 3), ("*0..2", 0, 2), ("*2", 2, 2), ("*", 1, 99), ("*3..", 3, 99)])
def test_paths_are_edge_unique(g, span, low, high):
    assert rows(g, f"MATCH (a)-[r{span}]->(b) RETURN count(*) AS c") == [(len(paths(low, high)),)]


def test_paths_both_ways_and_their_parts(g):
    assert rows(g, "MATCH (a)-[:K*1..3]-(b) RETURN count(*) AS c") == [(len(paths(1, 3, ("K",), True)),)]
    got = rows(g, "MATCH p = (a {name: 'ann'})-[r:K*2]->(b) RETURN [x IN r | id(x)] AS r, [n IN nodes(p) | n.name] AS n, length(p) AS l ORDER BY r")
    assert got == [([1, 2], ["ann", "bob", "cid"], 2), ([1, 7], ["ann", "bob", "ann"], 2), ([4, 2], ["ann", "bob", "cid"], 2), ([4, 7], ["ann", "bob", "ann"], 2)]
    assert rows(g, "MATCH p = (b)<-[:K*2]-(a {name: 'ann'}) WHERE b.name = 'cid' RETURN [n IN nodes(p) | n.name] AS n, [x IN relationships(p) | id(x)] AS r ORDER BY r") == [(["cid", "bob", "ann"], [2, 1]), (["cid", "bob", "ann"], [2, 4])]
    assert rows(g, "MATCH (a)-[r:K*1..2]->(b) WHERE all(x IN r WHERE x.w > 9) RETURN count(*) AS c") == [(5,)]
    assert rows(g, "MATCH (a)-[rs:K*2]->(b) WITH rs LIMIT 1 MATCH (x)-[rs*]->(y) RETURN count(*) AS c") == [(1,)]
    assert rows(g, "MATCH p = (n {name: 'eve'}) RETURN length(p) AS l, size(nodes(p)) AS s") == [(0, 1)]


def test_shortest_paths(g):
    assert rows(g, "MATCH p = shortestPath((a {name: 'ann'})-[:K*]->(b {name: 'cid'})) RETURN length(p) AS l") == [(2,)]
    assert rows(g, "MATCH p = allShortestPaths((a {name: 'ann'})-[:K*]->(b {name: 'cid'})) RETURN [r IN relationships(p) | id(r)] AS r ORDER BY r") == [([1, 2],), ([4, 2],)]
    assert rows(g, "MATCH p = shortestPath((a {name: 'eve'})-[:K*]->(b {name: 'cid'})) RETURN p") == []


def test_projection_order_and_limits(g):
    assert rows(g, "MATCH (n) RETURN n.age AS a ORDER BY a DESC") == [(None,), (40,), (30,), (25,), (7,)]
    assert rows(g, "MATCH (n) RETURN n.age ORDER BY n.age SKIP 1 LIMIT 2") == [(25,), (30,)]
    assert g.query("MATCH (n) RETURN n.age, count(DISTINCT n)").columns == ["n.age", "count(DISTINCT n)"]
    assert rows(g, "MATCH (n) RETURN n.name AS name ORDER BY n.age LIMIT $k", k=1) == [("eve",)]
    assert rows(g, "MATCH (n) WITH n ORDER BY n.age LIMIT 2 WHERE n.age > 7 RETURN n.age AS a") == [(25,)]
    assert rows(g, "UNWIND [3, 1, 3] AS x RETURN DISTINCT x ORDER BY x") == [(1,), (3,)]
    assert sorted(rows(g, "UNWIND [1, 2] AS x RETURN x UNION UNWIND [2, 3] AS x RETURN x")) == [(1,), (2,), (3,)]
    assert rows(g, "UNWIND [] AS x RETURN x") == rows(g, "UNWIND null AS x RETURN x") == rows(g, "MATCH (n) RETURN n LIMIT 0") == []
    assert len(rows(g, "MATCH (n:P), (m:Q) RETURN *")) == 6


def test_aggregates(g):
    assert rows(g, "MATCH (n) RETURN sum(n.age) AS s, avg(n.age) AS a, min(n.name) AS m, max(n.age) AS x") == [(102, 25.5, "ann", 40)]
    assert rows(g, "MATCH (n:Nope) RETURN sum(n.age) AS s, avg(n.age) AS a, collect(n.age) AS c, stDev(n.age) AS d") == [(0, None, [], 0.0)]
    assert rows(g, "UNWIND [1, 2, 2, 4] AS x RETURN sum(DISTINCT x) AS s, avg(DISTINCT x) AS a, percentileCont(x, 0.5) AS p, percentileDisc(x, 0.5) AS q, stDevP(x) AS d, max(DISTINCT x) AS m") == [(7, 7 / 3, 2.0, 2.0, math.sqrt(1.1875), 4)]
    assert rows(g, "UNWIND [7] AS x RETURN stDev(x) AS d") == [(0.0,)]
    assert rows(g, "MATCH (a)-[:K]->(b) RETURN b.name AS b, count(*) + size(b.name) AS v ORDER BY b") == [("ann", 5), ("bob", 5), ("cid", 4)]
    assert rows(g, "MATCH (a)-[:K]->(b) WITH b, count(DISTINCT a) AS c WHERE c > 1 RETURN b.name AS b") == [("ann",)]


def test_subqueries_and_procedures(g):
    assert rows(g, "MATCH (n:P) CALL { WITH n MATCH (n)-[:L]->(m) RETURN count(m) AS c } RETURN n.name AS n, c ORDER BY n") == [("ann", 1), ("bob", 0), ("cid", 0)]
    assert rows(g, "CALL { MATCH (n:Q) RETURN n.name AS q } RETURN count(*) AS c") == [(2,)]
    assert rows(g, "CALL { RETURN 1 AS x UNION RETURN 2 AS x } RETURN sum(x) AS s") == [(3,)]
    assert rows(g, "CALL db.labels() YIELD label RETURN label ORDER BY label") == [("P",), ("Q",)]
    assert rows(g, "CALL db.relationshipTypes") == [("K",), ("L",)] or sorted(rows(g, "CALL db.relationshipTypes")) == [("K",), ("L",)]
    mock = {"t.f": {"args": ["a"], "arg_types": ["INTEGER"], "yields": ["b"], "data": [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]}}
    assert rows(g, "UNWIND [1, 2, 3] AS i CALL t.f(i) YIELD b AS c RETURN i, c ORDER BY i", __procedures=mock) == [(1, "x"), (2, "y")]
    with pytest.raises(ProcedureError):
        rows(g, "CALL nope() YIELD x RETURN x")
    with pytest.raises(ProcedureError):
        rows(g, "CALL t.f('s') YIELD b RETURN b", __procedures=mock)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("-7 / 2", -3), ("-7 % 2", -1), ("1 / 0", None), ("1 % 0", None), ("1.0 / 0", None), ("2 ^ 2", 4.0), ("1 = 1.0", True), ("1 = 'a'", False), ("1 < 'a'", None), ("null = null", None), ("null IN []", False), ("null IN [1]", None), ("2 IN [1, null]", None),
        ("1 IN [1, null]", True), ("[1, 2] + 3", [1, 2, 3]), ("0 + [1]", [0, 1]), ("[1, 2] + [3]", [1, 2, 3]), ("'a' + 'b'", "ab"), ("[1, 2, 3][-1]", 3), ("[1, 2, 3][5]", None), ("[1, 2, 3][0..2]", [1, 2]), ("[1, 2, 3][-2..]", [2, 3]), ("[1, 2, 3][..null]", None),
        ("[1, null] = [1, null]", None), ("[1, 2] = [1]", False), ("[1] < [1, 2]", True), ("{a: 1, b: null}.b", None), ("{a: 1} = {a: 1}", True), ("NOT null", None), ("true XOR null", None), ("false AND null", False), ("true OR null", True),
        ("any(x IN [1, null] WHERE x = 2)", None), ("all(x IN [] WHERE x = 2)", True), ("none(x IN [1] WHERE x = 2)", True), ("single(x IN [1, 1] WHERE x = 1)", False), ("[x IN null | x]", []), ("reduce(s = 0, x IN [1, 2] | s + x)", 3),
        ("size('añb')", 3), ("size([1, null])", 2), ("head([])", None), ("tail([1, 2])", [2]), ("reverse('abc')", "cba"), ("range(5, 1)", []), ("range(5, 1, -2)", [5, 3, 1]), ("range(0, 3)", [0, 1, 2, 3]), ("substring('hello', 1, 3)", "ell"), ("split('a,b', ',')", ["a", "b"]),
        ("replace('aaa', 'a', 'b')", "bbb"), ("trim('\\t x ')", "x"), ("left('abc', 2)", "ab"), ("right('abc', 2)", "bc"), ("toInteger('12.7')", 12), ("toInteger('x')", None), ("toFloat('1e2')", 100.0), ("toBoolean('TRUE')", True), ("toString(1.0)", "1.0"), ("toString(1e20)", "100000000000000000000.0"), ("toString(0.00001)", "0.00001"),
        ("toString(true)", "true"), ("coalesce(null, 2)", 2), ("ceil(1.2)", 2.0), ("round(-2.5)", -3.0), ("sign(-3)", -1), ("abs(-3)", 3), ("log10(100)", 2.0), ("log(0)", float("-inf")), ("'abc' =~ 'b'", True), ("'abc' STARTS WITH 'ab'", True), ("1 STARTS WITH 'a'", None), ("CASE 2 WHEN 1 THEN 'a' ELSE 'b' END", "b"), ("CASE WHEN null THEN 1 END", None),
        ("keys({a: 1, b: 2})", ["a", "b"]), ("1 < 2 < 3", True), ("3 > 2 > 2", False), ("$p.a[1]", 5), ("[1, 2.5]", [1.0, 2.5]), ("valueType(1)", "INTEGER"), ("toStringOrNull(3)", "3"), ("size(split('', ','))", 1), ("exists({a: 1}.a)", True), ("pi() > 3", True),
    ],
)
def test_expressions(g, text, value):
    assert one(g, text, p={"a": [4, 5]}) == value


def test_nan(g):
    assert rows(g, "MATCH (n:Q) WHERE n.name = 'bob' RETURN n.score = n.score AS e, n.score <> n.score AS d, n.score < 1 AS l, n.score < 'a' AS t") == [(False, True, False, None)]
    assert math.isnan(one(g, "0.0 / 0.0"))
    assert [r[0] for r in rows(g, "MATCH (n) RETURN id(n) AS i ORDER BY n.score, i")] == [5, 1, 4, 2, 3]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("date('2015-07-21')", dt.date(2015, 7, 21)), ("date('2015-W30-2')", dt.date(2015, 7, 21)), ("date('2015202')", dt.date(2015, 7, 21)), ("date('201507')", dt.date(2015, 7, 1)), ("date({year: 2015, week: 30, dayOfWeek: 2})", dt.date(2015, 7, 21)), ("date({year: 1984, quarter: 3, dayOfQuarter: 45})", dt.date(1984, 8, 14)), ("date({year: 1984, ordinalDay: 202})", dt.date(1984, 7, 20)),
        ("toString(date('2020-01-31') + duration('P1M'))", "2020-02-29"), ("toString(localtime('21:40'))", "21:40"), ("toString(time('21:40:32.142+01:00'))", "21:40:32.142+01:00"), ("toString(localdatetime('2015-07-21T21:40:32'))", "2015-07-21T21:40:32"), ("toString(datetime('2015-07-21T21:40:00+01:00'))", "2015-07-21T21:40+01:00"), ("toString(duration('P1Y2M10DT2H30M'))", "P1Y2M10DT2H30M"),
        ("toString(duration({months: 0.75}))", "P22DT19H51M49.5S"), ("toString(duration({days: 14, hours: 16, minutes: 12}))", "P14DT16H12M"), ("duration('PT90M').minutes", 90), ("duration('PT90M').minutesOfHour", 30), ("duration.inDays(date('2020-01-01'), date('2020-03-01')).days", 60), ("toString(duration.between(date('2020-01-01'), date('2021-03-05')))", "P1Y2M4D"), ("duration.inMonths(date('2020-01-31'), date('2020-03-01')).months", 1),
        ("toString(duration.inSeconds(localtime('10:00'), localtime('11:30')))", "PT1H30M"), ("date('2020-02-10').week", 7), ("date('2020-02-10').dayOfWeek", 1), ("localdatetime('2020-01-01T10:11:12.345').millisecond", 345), ("toString(date.truncate('week', date('2020-02-12')))", "2020-02-10"), ("toString(date.truncate('decade', date('2017-05-01')))", "2010-01-01"), ("toString(date.truncate('month', date('2017-05-09'), {day: 3}))", "2017-05-03"), ("toString(localdatetime.truncate('hour', localdatetime('2017-05-09T10:31:00')))", "2017-05-09T10:00"),
        ("date('2020-01-01') < date('2020-01-02')", True), ("duration('P1D') < duration('P2D')", True), ("toString(duration('P1D') * 2)", "P2D"), ("toString(duration('P1D') + duration('PT1H'))", "P1DT1H"), ("toString(localtime('23:30') + duration('PT1H'))", "00:30"), ("datetime.fromepoch(0, 0).year", 1970), ("date(null)", None), ("toString(date({date: date('2020-05-06'), day: 1}))", "2020-05-01"), ("datetime({year: 2020, month: 7, day: 1, hour: 12, timezone: 'Europe/Paris'}).hour", 12),
    ],
)
def test_temporal(g, text, value):
    assert one(g, text) == value


def test_temporal_columns(g):
    assert rows(g, "UNWIND ['2015-07-21', '20150721', '2015-202', '2015-W30-2', '2015-07', '2015'] AS s RETURN toString(date(s)) AS d") == [("2015-07-21",), ("2015-07-21",), ("2015-07-21",), ("2015-07-21",), ("2015-07-01",), ("2015-01-01",)]
    assert rows(g, "UNWIND ['P1Y', 'PT36H', '-P1D'] AS s RETURN toString(duration(s)) AS d") == [("P1Y",), ("PT36H",), ("P-1D",)]


@pytest.mark.parametrize(
    ("text", "kind", "code"),
    [
        ("RETURN x AS y", QuerySyntaxError, "UndefinedVariable"), ("MATCH (n) WITH n.age RETURN 1 AS x", QuerySyntaxError, "NoExpressionAlias"), ("RETURN 1 AS a, 2 AS a", QuerySyntaxError, "ColumnNameConflict"), ("RETURN *", QuerySyntaxError, "NoVariablesInScope"), ("RETURN 1 AS a UNION RETURN 2 AS b", QuerySyntaxError, "DifferentColumnsInUnion"),
        ("MATCH (n)-[n]->() RETURN 1 AS x", QuerySyntaxError, "VariableTypeConflict"), ("MATCH (a)-[r]->()-[r]->() RETURN 1 AS x", QuerySyntaxError, "RelationshipUniquenessViolation"), ("MATCH (n) RETURN n.age + count(*) AS x", QuerySyntaxError, "AmbiguousAggregationExpression"), ("RETURN count(count(*)) AS x", QuerySyntaxError, "NestedAggregation"), ("RETURN count(rand()) AS x", QuerySyntaxError, "NonConstantExpression"),
        ("MATCH (n) RETURN n LIMIT -1", QuerySyntaxError, "NegativeIntegerArgument"), ("MATCH (n) RETURN n LIMIT 1.5", QuerySyntaxError, "InvalidArgumentType"), ("MATCH (n) RETURN n SKIP n.age", QuerySyntaxError, "NonConstantExpression"), ("RETURN nope(1) AS x", QuerySyntaxError, "UnknownFunction"), ("RETURN $q AS x", ParameterMissing, "MissingParameter"), ("MATCH (n) WHERE n RETURN 1 AS x", QuerySyntaxError, "InvalidArgumentType"),
        ("RETURN 1 AND true AS x", QueryTypeError, "InvalidArgumentType"), ("RETURN [1]['a'] AS x", QueryTypeError, "ListElementAccessByNonInteger"), ("RETURN 1 IN 2 AS x", QueryTypeError, "InvalidArgumentType"), ("RETURN (1).x AS y", QueryTypeError, "InvalidArgumentType"), ("RETURN percentileCont(1, 2) AS x", ArgumentError, "NumberOutOfRange"), ("RETURN toString([1]) AS x", QueryTypeError, "InvalidArgumentType"), ("MATCH (n) RETURN (n)-->() AS x", QuerySyntaxError, "UnexpectedSyntax"), ("MATCH (n) RETURN DISTINCT n.name AS a ORDER BY n.age", QuerySyntaxError, "UndefinedVariable"),
        ("MATCH p = (n) MATCH p = (m) RETURN 1 AS x", QuerySyntaxError, "VariableAlreadyBound"), ("MATCH (n) UNWIND [1] AS n RETURN n", QuerySyntaxError, "VariableAlreadyBound"), ("RETURN date('x') AS d", ArgumentError, "InvalidDate"), ("MATCH (n) WHERE (n)-->(zz) RETURN n", QuerySyntaxError, "UndefinedVariable"), ("MATCH (n) CREATE (n:X)", QuerySyntaxError, "VariableAlreadyBound"), ("MATCH (n) SET n.x = {a: 1}", QueryTypeError, "InvalidPropertyType"),
    ],
)
def test_error_codes(g, text, kind, code):
    with pytest.raises(kind) as e:
        g.snapshot().query(text)
    assert isinstance(e.value, GraphError) and e.value.code == code


def test_explain(g):
    text = g.explain("MATCH (n:P)-[:K]->(m) RETURN count(*) AS c", analyze=True)
    assert "Match (P)-[K out]-()" in text and "Rows: 1" in text and "Physical Plan" in text


def test_pushdown(spark):
    from skein.sources.tables import sample_graph

    plan = sample_graph(spark, "/root/testdata/sf0.001").explain("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 1000 RETURN c.name AS n, o.orderkey AS k")
    assert "GreaterThan(o_totalprice,1000" in plan and "c_mktsegment" not in plan and "o_orderpriority" not in plan


@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 5)), min_size=1, max_size=7), st.integers(0, 1), st.integers(1, 3))
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_random_paths(spark, pairs, low, high):
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(1, 6)], "node_id long, labels array<string>")
    edges = spark.createDataFrame([(k, "T", a, b) for k, (a, b) in enumerate(pairs)], "rel_id long, rel_type string, source_node_id long, target_node_id long")

    def count(at, used):
        n = low <= len(used) <= high
        if len(used) < high:
            n += sum(count(b if a == at else a, used | {k}) for k, (a, b) in enumerate(pairs) if k not in used and at in (a, b))
        return n

    want = sum(count(i, frozenset()) for i in range(1, 6))
    assert rows(Graph.from_frames(spark, nodes, edges), f"MATCH (a)-[*{low}..{high}]-(b) RETURN count(*) AS c") == [(want,)]


# --- writing


@pytest.fixture
def w(spark):
    return Graph(spark)


def test_create_set_remove_delete(w):
    assert rows(w, "CREATE (a:A {x: 1, n: null})-[r:R {w: 2}]->(b:B:A {x: 2}) RETURN a.x AS a, r.w AS w, labels(b) AS l") == [(1, 2, ["A", "B"])]
    assert rows(w, "MATCH (a:A) RETURN count(*) AS c") == [(2,)]
    assert rows(w, "UNWIND [1, 2] AS i CREATE (:C {v: i})") == []
    assert rows(w, "MATCH (c:C) SET c.v = c.v + 1, c.u = c.v, c:D RETURN c.v AS v, c.u AS u, c:D AS d ORDER BY v") == [(2, 2, True), (3, 3, True)]
    assert rows(w, "MATCH (c:D) SET c += {v: null, z: 9} RETURN c.v AS v, c.z AS z, c.u AS u ORDER BY u") == [(None, 9, 2), (None, 9, 3)]
    assert rows(w, "MATCH (c:D {u: 2}) SET c = {only: true} REMOVE c:C RETURN keys(c) AS k, labels(c) AS l") == [(["only"], ["D"])]
    assert rows(w, "MATCH ()-[r:R]->() SET r.w = 5 RETURN r.w AS w") == [(5,)]
    with pytest.raises(ConstraintError) as e:
        w.query("MATCH (a:A {x: 1}) DELETE a")
    assert e.value.code == "DeleteConnectedNode" and w.count_edges() == 1
    w.query("MATCH (a)-[r:R]->() DELETE r, a")
    assert (w.count_nodes(), w.count_edges()) == (3, 0)
    w.query("MATCH (n) DETACH DELETE n")
    assert w.count_nodes() == 0 and w.health_check()["ok"]


def test_unrelated_types_of_a_property_meet_as_text(w):
    w.query("CREATE (:A {x: 1}), (:A:B {x: 'two'})")
    assert sorted(rows(w, "MATCH (a:A) RETURN a.x AS x")) == [("1",), ("two",)]


def test_merge(w):
    assert rows(w, "UNWIND [1, 1, 2] AS i MERGE (m:M {k: i}) ON CREATE SET m.made = true ON MATCH SET m.seen = true RETURN count(DISTINCT m) AS c") == [(2,)]
    assert rows(w, "MERGE (m:M {k: 1}) ON MATCH SET m.seen = true RETURN m.seen AS s") == [(True,)]
    assert w.count_nodes() == 2
    w.query("MATCH (a:M {k: 1}), (b:M {k: 2}) MERGE (a)-[:T]->(b)")
    w.query("MATCH (a:M {k: 1}), (b:M {k: 2}) MERGE (a)-[:T]->(b)")
    assert w.count_edges() == 1
    with pytest.raises(SemanticError):
        w.query("MERGE (m:M {k: null})")


def test_constraints_and_indexes(w):
    w.query("CREATE CONSTRAINT ON (n:U) ASSERT n.k IS UNIQUE")
    w.query("CREATE (:U {k: 1})")
    with pytest.raises(ConstraintError):
        w.query("CREATE (:U {k: 1})")
    with pytest.raises(ConstraintError):
        w.create_node(["U"], {"k": 1})
    assert w.count_nodes() == 1
    w.query("CREATE CONSTRAINT FOR (n:V) REQUIRE n.k IS NOT NULL")
    with pytest.raises(ConstraintError):
        w.query("CREATE (:V)")
    w.query("CREATE INDEX ON :U(k)")
    assert rows(w, "SHOW INDEXES") == [("U", "k")] and len(rows(w, "SHOW CONSTRAINTS")) == 2
    w.query("DROP CONSTRAINT ON (n:V) ASSERT EXISTS(n.k)")
    w.query("CREATE (:V)")


def test_foreach(w):
    w.query("UNWIND ['a', 'b'] AS s FOREACH (i IN range(1, 2) | CREATE (:F {v: i, s: s}))")
    assert sorted(rows(w, "MATCH (f:F) RETURN f.s AS s, f.v AS v")) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_interface(w, tmp_path):
    a, b = w.create_node(["P"], {"name": "x", "n": 1}), w.create_node(["P", "Q"], {"name": "y"})
    r = w.create_edge(a, b, "R", {"w": 3})
    assert w.get_node(a) == {"id": a, "labels": ["P"], "properties": {"name": "x", "n": 1}} and w.get_edge(r)["properties"] == {"w": 3} and w.get_node(99) is None
    assert [x["other"] for x in w.neighbours(b, "in").collect()] == [a] and w.neighbours(b, "out").isEmpty() and w.neighbours(a, "both", "R").count() == 1
    assert [x["node_id"] for x in w.find_nodes("P", {"name": "y"}).collect()] == [b] and w.find_edges(a, None, "R").count() == 1 and w.find_edges(None, a).isEmpty()
    w.add_label(a, "Z")
    w.remove_label(b, "Q")
    w.update_node(b, {"other": 5})
    assert w.get_node(a)["labels"] == ["P", "Z"] and w.get_node(b) == {"id": b, "labels": ["P"], "properties": {"other": 5}}
    w.save(str(tmp_path / "g"))
    again = Graph.load(w.spark, str(tmp_path / "g"))
    assert again.get_node(a) == w.get_node(a) and again.create_node([]) == 3
    with pytest.raises(ConstraintError):
        w.delete_node(a)
    w.delete_edge(r)
    w.delete_node(a)
    w.detach_delete_node(b)
    assert w.count_nodes() == 0
    assert w.schema_info()["nodes"] == 0
    w.clear()
    assert w.create_node(["P"]) == 1
    with pytest.raises(ArgumentError):
        w.create_edge(1, 77, "R")


# --- views


def test_views(spark, tmp_path):
    from skein.errors import ViewError
    from skein.streaming.changes import ChangeFeed
    from skein.streaming.views import Views

    g = Graph(spark)
    g.query("UNWIND range(1, 6) AS i CREATE (:V {k: i, g: i % 2})")
    feed = ChangeFeed(g, str(tmp_path / "feed"))
    views = Views(g)
    assert views.create("rowwise", "MATCH (v:V) WHERE v.k > 2 RETURN v.k AS k").mode == "DIFFERENTIAL"
    assert views.create("grouped", "MATCH (v:V) RETURN v.g AS g, count(*) AS c", reads=("rowwise",)).mode == "DIFFERENTIAL"
    assert views.create("sorted", "MATCH (v:V) RETURN v.g AS g ORDER BY g").mode == "FULL"
    views.drop("sorted")
    views.create("now", "MATCH (v:V) RETURN count(*) AS c", mode="IMMEDIATE")
    for name, mode, code in (("rowwise", "AUTO", "ViewExists"), ("Bad", "AUTO", "InvalidViewName"), ("x", "NOPE", "InvalidRefreshMode")):
        with pytest.raises(ViewError) as e:
            views.create(name, "MATCH (v:V) RETURN v.k AS k", mode=mode)
        assert e.value.code == code
    steps = ["MATCH (v:V {k: 4}) SET v.k = 1", "MATCH (v:V {k: 6}) DETACH DELETE v", "CREATE (:V {k: 9, g: 1})", "MATCH (v:V {k: 2}) SET v.k = 7"]
    for text in steps:
        g.query(text)
        views.follow(feed, str(tmp_path / "seen"))
        fresh = sorted(rows(g, "MATCH (v:V) WHERE v.k > 2 RETURN v.k AS k"))
        assert sorted(tuple(r) for r in views.read("rowwise").collect()) == fresh
        assert sorted(tuple(r) for r in views.read("grouped").collect()) == sorted(rows(g, "MATCH (v:V) RETURN v.g AS g, count(*) AS c"))
        assert views.read("now").first()["c"] == g.count_nodes()
    ops = {r["op"]: r["c"] for r in feed.read().groupBy("op").count().withColumnRenamed("count", "c").collect()}
    assert ops == {"Begin": 4, "Commit": 4, "NodeUpdate": 2, "NodeDelete": 1, "NodeInsert": 1}
    assert views.dependencies("grouped") == {"labels": ["V"], "types": [], "views": ["rowwise"]} and views.order().index("rowwise") < views.order().index("grouped")
    views.create("never", "MATCH (v:V) WHERE v.k < 0 RETURN v.k AS k", constraint=True)
    before = g.count_nodes()
    with pytest.raises(ViewError):
        g.query("CREATE (:V {k: -1})")
    assert g.count_nodes() == before
    with pytest.raises(ViewError):
        views.drop("rowwise")
    views.drop("grouped")
    assert views.list().count() == 3
