"""Views kept by deltas equal their queries after every write."""

from skein.sources.graph import Graph
from skein.streaming.views import Views

VIEWS = {
    "hop": "MATCH (a:P)-[r:KNOWS]->(b) WHERE a.age > 1 RETURN a.name AS a, b.name AS b, r.w AS w",
    "two_hops": "MATCH (a:P)-[:KNOWS]->(b)-[:KNOWS]->(c) RETURN a.name AS a, b AS b, c.age AS c",
    "per_node": "MATCH (a:P)-[r:KNOWS]->(b) RETURN a.city AS city, count(*) AS c, sum(r.w) AS s, collect(DISTINCT b.age) AS ages, max(b.age) AS m",
    "either": "MATCH (a:P) RETURN a.city AS x UNION MATCH (a:P)-[:KNOWS]->(b) RETURN b.city AS x",
}
STEPS = [
    "MATCH (a:P {name: 'p1'}) SET a.city = 'z', a.age = 9",
    "MATCH (a:P {name: 'p2'}), (b:P {name: 'p5'}) CREATE (a)-[:KNOWS {w: 7}]->(b)",
    "MATCH (:P {name: 'p3'})-[r:KNOWS]->() DELETE r",
    "MATCH (a:P {name: 'p4'}) DETACH DELETE a",
    "CREATE (:P {name: 'new', age: 3, city: null})-[:KNOWS {w: 1}]->(:P {name: 'other', age: 2, city: 'y'})",
]


def canon(df):
    flat = lambda x: sorted(map(str, x)) if isinstance(x, list) else (x["id"], sorted((k, v) for k, v in x["p"].asDict().items() if v is not None)) if hasattr(x, "asDict") else x
    return sorted(str([flat(x) for x in r]) for r in df.collect())


def test_deltas(spark):
    g = Graph(spark)
    g.query("UNWIND range(0, 5) AS i CREATE (:P {name: 'p' + toString(i), age: i, city: ['x', 'y'][i % 2]})")
    g.query("MATCH (a:P), (b:P) WHERE b.age = (a.age + 1) % 6 OR b.age = (a.age * 2) % 6 CREATE (a)-[:KNOWS {w: a.age}]->(b)")
    views = Views(g)
    for name, text in VIEWS.items():
        assert views.create(name, text).mode == "DIFFERENTIAL"
    full = []
    views._full, whole = lambda v, graph: (full.append(v.name), whole(v, graph)), views._full
    for text in STEPS:
        g.query(text)
        views.refresh()
        for name, text in VIEWS.items():
            assert canon(views.read(name)) == canon(g.query(text)), (name, text)
    assert len(full) <= len(VIEWS)  # where a column changes its type, and no more
