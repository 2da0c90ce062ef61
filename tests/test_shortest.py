"""Shortest paths between many ends: components first, then a search only where nodes are not all linked."""

import random

import pytest
from test_oracles import duck  # noqa: F401

from skein.operators import shortest as operator
from skein.queries import ORACLE_SQL, QUERIES
from skein.sources.graph import Graph

SF = "/root/testdata/sf0.01"
ENDS = "MATCH p = shortestPath((a:P)-[:N%s]%s(b:P)) %s RETURN a.v AS a, b.v AS b, length(p) AS n"


@pytest.fixture
def g(spark):
    """Cliques, a chain, a star, a random part, parallel relationships, loops, nodes without any."""
    draw = random.Random(5)
    links = [(x, y) for group in (range(0, 5), range(5, 7)) for x in group for y in group if x < y]
    links += [(k + 1, k) if k % 3 else (k, k + 1) for k in range(10, 17)] + [(20, k) for k in range(21, 25)]
    links += [(draw.randrange(30, 40), draw.randrange(30, 40)) for _ in range(14)] + [(0, 1), (1, 0), (3, 3), (41, 41)]
    nodes = spark.createDataFrame([(v, ["P"], v) for v in range(44)], "node_id long, labels array<string>, v long")
    edges = spark.createDataFrame([(k, "N", x, y, k % 2) for k, (x, y) in enumerate(links)], "rel_id long, rel_type string, source_node_id long, target_node_id long, w long")
    return Graph.from_frames(spark, nodes, edges), links


def steps(links, out, most):
    """Lengths by source and target, plainly: breadth first, a source reached again by its first circle."""
    near = {}
    for x, y in links:
        near.setdefault(x, set()).add(y)
        if not out:
            near.setdefault(y, set()).add(x)
    found = {}
    for a in range(44):
        front, n = {a}, 0
        while front and n < most:
            n += 1
            front = {y for x in front for y in near.get(x, ()) if (a, y) not in found}
            found |= {(a, y): n for y in front}
    return found


@pytest.mark.parametrize("span,most,out", [("*", 99, False), ("*..2", 2, True)])
def test_many_ends_equal_a_plain_search(g, monkeypatch, out, span, most):
    monkeypatch.setattr(operator, "SOURCES", 2)
    graph, links = g
    rows = graph.query(ENDS % (span, "->" if out else "-", "WHERE a.v <> b.v")).collect()
    want = {(a, b): n for (a, b), n in steps(links, out, most).items() if a != b}
    assert len(rows) == len(want) and {(r["a"], r["b"]): r["n"] for r in rows} == want


def test_a_node_with_itself(g, monkeypatch):
    graph, links = g
    monkeypatch.setattr(operator, "SOURCES", 2)
    want = [(a, b, n) for (a, b), n in steps(links, True, 3).items()]
    assert sorted(map(tuple, graph.query(ENDS % ("*..3", "->", "")).collect())) == sorted(want)
    zero = sorted(map(tuple, graph.query(ENDS % ("*0..3", "->", "")).collect()))
    assert zero == sorted([x for x in want if x[0] != x[1]] + [(v, v, 0) for v in range(44)])


def test_parts_of_paths_between_many_ends(g, monkeypatch):
    graph, _ = g
    text = "MATCH p = allShortestPaths((a:P)-[:N*..3]-(b:P)) WHERE a.v < b.v RETURN a.v AS a, b.v AS b, [x IN nodes(p) | x.v] AS vs, [r IN relationships(p) | r.w] AS ws, length(p) AS n"
    both = []
    for sources in (2, 1000):
        monkeypatch.setattr(operator, "SOURCES", sources)
        both.append(sorted(map(repr, graph.query(text).collect())))
    assert both[0] == both[1] and len(both[0]) > 40


def test_cliques_need_no_search(spark, duck, monkeypatch):  # noqa: F811
    """All pairs of suppliers were paired and searched for, hop by hop, those of different nations too."""
    asked = []
    grow = operator._grow
    monkeypatch.setattr(operator, "_grow", lambda *a: asked.append(a) or grow(*a))
    got = sorted(tuple(r[c] for c in ("a", "b", "n")) for r in QUERIES["shortest"](spark, SF).collect())
    want = duck.execute(ORACLE_SQL["shortest"].replace("supplier", f"'{SF}/supplier.parquet'")).fetchall()
    assert got == sorted(want) and len(got) > 100 and not asked


def test_parallel_relationships_are_told_from_missing_ones(spark):
    """Each node has as many relationships as there are others, but two of them may be parallel."""
    pairs = [(0, 1), (0, 1), (2, 3), (2, 3), (0, 2)] + [(x, y) for x in (5, 6, 7) for y in (5, 6, 7) if x < y] + [(8, 9), (9, 8)]
    for edges, whole in ((pairs, {5, 6, 7}), (sorted(set(pairs) - {(9, 8)}), {5, 6, 7, 8, 9}), ([(0, 1), (0, 1), (1, 2), (1, 2), (2, 0), (2, 0)], set()), ([(0, 1), (0, 1), (1, 2), (2, 3), (2, 3), (3, 0)], set())):
        nodes, count = operator._linked(spark.createDataFrame([(x, y, k) for k, (x, y) in enumerate(edges)], "e_near long, e_far long, e_id long"), True)
        assert {r["id"] for r in nodes.collect() if r["whole"]} == whole and count == len({v for e in edges for v in e})
